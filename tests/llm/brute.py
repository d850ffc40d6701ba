"""Plain versions of the operators' contracts."""

import hashlib
from collections import Counter


def repeats(docs, length):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, b in texts:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_repeats(docs, window):
    seen = Counter()
    texts = [(i, (t or "").encode().split()) for i, t in docs]
    for _, w in texts:
        seen.update(tuple(w[p : p + window]) for p in range(len(w) - window + 1))
    out = {}
    for i, w in texts:
        gone = [0] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [1] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest())
    return out


def jaccard_components(docs, size=5, num=75, den=100):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    ids = [i for i, _ in docs]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * (o := len(x & y)) >= num * (len(x) + len(y) - o):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}
