"""Brute-force forms that several tests share."""

import re
from itertools import combinations


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def components(rows, size, similarity=80):
    """doc_id -> least doc_id reachable, over all pairs; ids are distinct."""
    sets = {doc: shingle_set(text, size) for doc, text in rows}
    at = {doc: doc for doc in sets}

    def find(a):
        while at[a] != a:
            a = at[a]
        return a

    for a, b in combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            at[y] = x
    return {doc: find(doc) for doc in sets}


def leaks(docs, items, window=5, coverage=0.8):
    """Plain case-blind windows: the test tables plant passages without slots."""
    words = lambda t: [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x).lower() for x in (t or "").split()) if w]
    out = set()
    at = {}
    total = {}
    for item, text in items:
        w = words(text)
        total[item] = len(w) - window + 1
        for k in range(total[item]):
            at.setdefault(tuple(w[k:k + window]), set()).add((item, k))
    for doc, text in docs:
        w = words(text)
        hit = {}
        for k in range(len(w) - window + 1):
            for item, j in at.get(tuple(w[k:k + window]), ()):
                hit.setdefault(item, set()).add(j)
        out |= {(doc, item) for item, s in hit.items() if len(s) >= coverage * total[item]}
    return out
