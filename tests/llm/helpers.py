"""Small tables and brute-force versions."""

from __future__ import annotations

from collections import defaultdict

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "a")), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def word_shingles(text, words):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        parts = parts.replace(space, " ")
    parts = [p for p in parts.split(" ") if p]
    if not parts:
        return set()
    width = min(words, len(parts))
    return {tuple(parts[i:i + width]) for i in range(len(parts) - width + 1)}


def near_classes(rows, words, percent=80):
    """doc_id -> smallest doc_id reachable, by comparing all pairs of different sets that share a shingle."""
    by_set = defaultdict(list)
    for doc_id, text in rows:
        by_set[frozenset(word_shingles(text, words))].append(doc_id)
    union = Union()
    sets = [s for s in by_set if s]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        ids = by_set[s]
        for i in ids:
            union.join(ids[0], i)
        near = defaultdict(int)
        for x in s:
            for j in where[x]:
                near[j] += 1
            where[x].append(k)
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                union.join(ids[0], by_set[sets[j]][0])
    return {doc_id: union.root(doc_id) for doc_id, _ in rows}
