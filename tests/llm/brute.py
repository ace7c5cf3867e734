"""The contracts, straight from their words, for small tables."""

from __future__ import annotations

from tests.llm.conftest import alnum, sha, words


def near_duplicates(rows, percent):
    sets: dict = {}
    sizes = []
    for d, t in rows:
        w = words(t, lower=True)
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sizes.append((d, len(s)))
        if d is not None:
            sets.setdefault(d, []).append(s)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, n, None if d is None else find(d), d is None or find(d) == d) for d, n in sizes), key=repr)


def repeats(rows, window=13):
    least: dict = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                least[tuple(w[i : i + window])] = min(d, least.get(tuple(w[i : i + window]), d))
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def contamination(rows, items, window=10):
    of: dict = {}
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            of.setdefault(tuple(w[k : k + window]), set()).add(i)
    lengths = {len(x) for x in of}
    out = []
    for d, t in rows:
        w, hit, found = alnum(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := of.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids).encode()), bool(hit)))
    return sorted(out, key=repr)
