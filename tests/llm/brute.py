"""Plain versions that the operators are held against."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, words):
    found = WORD.findall((text or "").encode().lower())
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def component_ids(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_classes(rows, words, num, den):
    sets = [(i, shingles(t, words)) for i, t in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a is not None and b is not None and s and t and den * len(s & t) >= num * len(s | t)]
    comp = component_ids([i for i, _ in sets if i is not None], links)
    return sorted((i, len(s), comp.get(i)) for i, s in sets if i is not None)


def removed_bytes(rows, width=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of documents without null or repeated ids."""
    first = {}
    data = sorted((i, (t or "").encode()) for i, t in rows)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for at in range(len(b) - width + 1):
            if first.setdefault(b[at : at + width], i) < i:
                gone[at : at + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for at, g in enumerate(gone) if g and not (at and gone[at - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
