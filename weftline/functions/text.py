"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation as character ranges.
PUNCTUATION = r"!-/:-@\[-`{-~"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_word(word: Column | str) -> Column:
    """Delete hyphens and apostrophes, strip ASCII punctuation at both ends, lower-case."""
    bare = F.translate(_c(word), "-'’", "")
    return F.lower(F.regexp_replace(bare, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", ""))


def matching_text(text: Column | str) -> Column:
    """Lower case, hyphens to blanks, only letters, digits, underscores and single blanks; no NFKC, no number words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "-", " "), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def matching_words(text: Column | str) -> Column:
    """The words of matching_text; an empty text has none."""
    return F.array_remove(F.split(matching_text(text), " "), "")


def normalization_type(ref: Column | str, hyp: Column | str) -> Column:
    """case, hyphen-apostrophe, punctuation or normalization, the first that explains the difference."""
    ref, hyp = _c(ref), _c(hyp)
    joined = lambda x: F.lower(F.translate(x, "-'’", ""))
    stripped = lambda x: F.lower(F.regexp_replace(x, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", ""))
    return F.when(F.lower(ref) == F.lower(hyp), "case").when(joined(ref) == joined(hyp), "hyphen-apostrophe").when(stripped(ref) == stripped(hyp), "punctuation").otherwise("normalization")


def collapse(text: Column | str) -> Column:
    """All white space, no-break spaces too, to single blanks."""
    return F.trim(F.regexp_replace(_c(text), r"[\s\x{00A0}]+", " "))


def clean_text(text: Column | str) -> Column:
    """Unix line ends, single blanks, trimmed lines, at most one empty line in a row."""
    unix = F.regexp_replace(_c(text), r"\r\n?", "\n")
    narrow = F.regexp_replace(unix, r"[ \t\x0B\f\x{00A0}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(narrow, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def key_text(text: Column | str) -> Column:
    """A lookup key: lower case, plain quotes and dashes, everything else than a-z and 0-9 to single blanks."""
    folded = F.translate(F.lower(_c(text)), "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def roman_or_decimal(text: Column | str) -> Column:
    """The value of a decimal or Roman numeral, null for anything else."""
    text = F.upper(F.trim(_c(text)))
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair]), c)
    digits = F.reverse(F.split(text, ""))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        v = value(c)
        return F.struct(F.when(v < acc["last"], acc["sum"] - v).otherwise(acc["sum"] + v).alias("sum"), F.greatest(v, acc["last"]).alias("last"))

    roman = F.aggregate(digits, start, step, lambda acc: acc["sum"])
    return F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int")).when(text.rlike("^[IVXLCDM]+$"), roman)


def section_numbers(label: Column | str) -> Column:
    """(first, last) section numbers of a label such as `12-14: Title`; last is first if there is one number."""
    label = _c(label)
    first = F.regexp_extract(label, r"^\s*(\d+)", 1)
    last = F.regexp_extract(label, r"^\s*\d+\s*[-–]\s*(\d+)", 1)
    number = lambda x: F.when(x != "", x).cast("int")
    return F.struct(number(first).alias("first"), F.coalesce(number(last), number(first)).alias("last"))


def trailing_number(label: Column | str) -> Column:
    """The number, with one letter at most, that ends a label; null if there is none."""
    found = F.regexp_extract(_c(label), r"\b(\d+[A-Za-z]?)\b\s*$", 1)
    return F.when(found != "", found)


def section_label(label: Column | str) -> Column:
    """The number or range of numbers that ends a label; null if there is none."""
    found = F.regexp_extract(_c(label), r"\b(\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?)\b\s*$", 1)
    return F.when(found != "", found)


def label_variants(label: Column | str) -> Column:
    """The label, without a leading number, without section words, and what follows `from`."""
    label = collapse(label)
    bare = F.regexp_replace(label, r"^\d+\s*[:.]\s*", "")
    prefix = r"(?i)^(?:(?:chapter|section|part|book|volume|letter|act|scene)\s+(?:[ivxlcdm]+|\d+)\s*[:.,-]?\s*)+"
    rest = F.regexp_replace(bare, prefix, "")
    tail = F.regexp_extract(label, r"(?i)\bfrom\s+(.+)$", 1)
    return F.filter(F.array_distinct(F.array(label, bare, rest, tail)), lambda x: x != "")


def slug(text: Column | str, longest: int = 80) -> Column:
    """Runs of non-word characters to underscores, cut to a length."""
    return F.substring(F.regexp_replace(F.trim(_c(text)), r"[^\p{L}\p{N}_]+", "_"), 1, longest)


def sentences(text: Column | str) -> Column:
    """Split at white space after . ! or ?"""
    return F.split(F.trim(_c(text)), r"(?<=[.!?])\s+")


def ocr_tokens(text: Column | str) -> Column:
    """Words of ASCII letters, digits and apostrophes; accented letters split words."""
    return F.regexp_extract_all(_c(text), F.lit("[A-Za-z0-9'‘’‛]+"), F.lit(0))


def decoder_tokens(text: Column | str) -> Column:
    """Lower-case words without sentence punctuation at their ends."""
    words = F.filter(F.split(F.lower(F.trim(_c(text))), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.btrim(w, F.lit(".,!?;:")))


def ngrams(words: Column | str, n: int) -> Column:
    """All runs of n words, as arrays."""
    words = _c(words)
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))).otherwise(F.expr("cast(array() as array<array<string>>)"))


def reader_id(url: Column | str) -> Column:
    """The reader of a URL: /reader/<n>, else peopleid=<n>, else null."""
    found = [F.regexp_extract(_c(url), p, 1) for p in (r"/reader/(\d+)", r"peopleid=(\d+)")]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def url_basename(url: Column | str) -> Column:
    """The last path part, the MD5 of the URL if that is empty."""
    path = F.regexp_extract(_c(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)?([^?#]*)", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name != "", name).otherwise(F.md5(_c(url)))


def html_title(html: Column | str) -> Column:
    return collapse(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def clock(seconds: Column | str) -> Column:
    """m:ss.s"""
    s = _c(seconds)
    return F.format_string("%d:%04.1f", F.floor(s / 60).cast("long"), s - F.floor(s / 60) * 60)


def text_match_score(a: Column | str, b: Column | str, ratio: Column) -> Column:
    """0 if either is empty, 1 if equal, 0.9 if one holds the other, else the given similarity ratio."""
    a, b = _c(a), _c(b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.9).otherwise(ratio)
