"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


def simhash(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_classes(rows):
    """(id, text) -> [(id, hex, component)]"""
    prints = np.array([simhash(t) for _, t in rows], dtype=np.uint64)
    linked = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2)]
    roots, low = components(len(rows), linked), {}
    for (ident, _), r in zip(rows, roots):
        if ident is not None:
            low[r] = min(ident, low.get(r, ident))
    return [(ident, f"{int(p):016x}", low.get(r)) for (ident, _), p, r in zip(rows, prints, roots)]


def quality(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, rep, n < 50 or 100 * rep > 50 * n


def token_pieces(tokenizer, text, length=2048):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, s, len(ids[s : s + length]), zlib.crc32(np.array(ids[s : s + length], dtype="<u4").tobytes())) for k, s in enumerate(range(0, len(ids), length))]


def removed_words(rows, window=50):
    """(id, text) -> {row number: covered flags}"""
    first, found = {}, {}
    for ident, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(ident, first.get(g, ident))
    for k, (ident, text) in enumerate(rows):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < ident:
                gone[i : i + window] = [True] * window
        found[k] = gone
    return found


def word_edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return max(len(a), len(b)) - p - s <= 1


def kept_lines(rows, least=5):
    """(id, text) -> {row number: flags of the lines kept}; equal lines go however short, near ones from ``least`` words on"""
    earlier, seen, kept = defaultdict(list), set(), {}
    for k, (_, text) in sorted(enumerate(rows), key=lambda x: x[1][0]):
        kept[k] = []
        for line in (text or "").split("\n"):
            w = words(line)
            near = len(w) >= least and any(word_edit_at_most_one(w, x) for n in (-1, 0, 1) for x in earlier[len(w) + n])
            kept[k].append(not (near or (w and tuple(w) in seen)))
            seen.add(tuple(w))
            if len(w) >= least:
                earlier[len(w)].append(w)
    return kept


def similar_classes(rows, shingle=5):
    """(id, text) -> [(id, component)] at a Jaccard similarity of 4/5 or more"""
    sets = []
    for _, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or {" ".join(w)} - {""})
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    roots, low = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]), {}
    for (ident, _), r in zip(rows, roots):
        if ident is not None:
            low[r] = min(ident, low.get(r, ident))
    return [(ident, low.get(r)) for (ident, _), r in zip(rows, roots)]
