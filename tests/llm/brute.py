"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def contamination(rows, items):
    windows = defaultdict(set)
    for i, text in items:
        w = plain_words(text)
        n = min(13, len(w))
        for at in range(len(w) - n + 1) if n else ():
            windows[tuple(w[at : at + n])].add(str(i))
    out = {}
    for i, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                ids = windows.get(tuple(w[at : at + n]))
                if ids:
                    hit.update(range(at, at + n))
                    found |= ids
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def word_repeats(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for at in range(len(w) - 12):
            if first.setdefault(tuple(w[at : at + 13]), i) < i:
                gone[at : at + 13] = [True] * 13
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


def byte_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\x01" * 100
            seen.add(window)
        out[i] = (len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(data, gone, strict=True) if not g)))
    return out


def licenses(text):
    w, places = plain_words(text), []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(at, label) for at in range(len(w) - len(p) + 1) if w[at : at + len(p)] == p]
    starts = [a for a, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def quality(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams, seen, again = Counter(zip(w, w[1:], w[2:])), set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    covered = {k for at in range(len(w) - 2) if grams[tuple(w[at : at + 3])] > 1 for k in range(at, at + 3)}
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), again, len(covered))


def components(rows):
    sets, parent = {}, {}
    for i, text in rows:
        w = words(lower(text))
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def targets(sizes):
    """Source targets by repeated resharing; sizes: source -> words."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        level = (total - sum(3 * sizes[s] for s in full)) / rest if rest else 0
        more = {s for s in names if s not in full and level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more
