"""Optional context-dependent rewrite rules over token sequences."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

MOST_PATHS = 256


@dataclass(frozen=True)
class Rewrite:
    """segment -> replacement / left _ right; fields are tokens split at blanks, with ., ?, .*, [abc], [^abc] inside a token."""

    segment: str
    replacement: str
    left: str = ""
    right: str = ""


def _tokens(field: str) -> str:
    """A field as a regular expression over tokens that each end in a blank; $ and an empty field match nothing much."""
    out = []
    for token in field.split():
        if token == "$":
            continue
        body = "".join(r"\S*" if part == ".*" else r"\S" if part == "." else part if part in "?" or part.startswith("[") else re.escape(part) for part in re.findall(r"\.\*|\[\^?[^\]]*\]|\.|\?|[^.\[?]+|\[", token))
        out.append(body + " ")
    return "".join(out)


def variants(tokens: Sequence[str], rules: Sequence[Rewrite], most: int = MOST_PATHS) -> list[tuple[str, ...]]:
    """The sequence and all that the cascade makes of it, each rule applied or not at each place."""
    found = {" ".join(tokens) + " " if tokens else "": None}
    for rule in rules:
        segment = _tokens(rule.segment)
        if not segment:
            continue
        pattern = re.compile(f"(?:(?<=^)|(?<= )){segment}(?={_tokens(rule.right)})")
        left = re.compile(f"(?:^|.* ){_tokens(rule.left)}$") if _tokens(rule.left) else None
        new = rule.replacement.strip()
        new = "" if new in ("", "$") else new + " "
        for text in list(found):
            made = [("", 0)]
            for m in pattern.finditer(text):
                if left is not None and not left.match(text[: m.start()]):
                    continue
                made = [(head + text[at : m.start()] + put, m.end()) for head, at in made for put in (m[0], new)][:most]
            for head, at in made:
                if len(found) < most:
                    found[head + text[at:]] = None
    return [tuple(t.split()) for t in found]


def pronunciations(words: Sequence[Sequence[Sequence[str]]], most: int = MOST_PATHS) -> list[tuple[str, ...]]:
    """All readings of a sequence of words with alternative pronunciations, without repeats, at most `most`."""
    paths: list[tuple[str, ...]] = [()]
    for alternatives in words:
        if alternatives:
            paths = list(dict.fromkeys(p + tuple(a) for p in paths for a in alternatives))[:most]
    return paths
