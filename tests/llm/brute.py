"""Brute-force versions of the operators, and small tables for them."""

import re


def words(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def shingles(text, n=2):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(ids, edges):
    """The groups of two or more that edges join: frozensets."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    out = {}
    for i in ids:
        out.setdefault(root(i), set()).add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def jaccard_groups(docs, threshold, n=2):
    sets = {i: shingles(t, n) for i, t in docs}
    sets = {i: s for i, s in sets.items() if s}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12]
    return groups(ids, pairs), pairs


def found_groups(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r["group_id"], set()).add(r[key])
        assert r["kept"] == (r[key] == r["group_id"])
    assert all(g == min(m) for g, m in out.items())
    return {frozenset(g) for g in out.values()}


def plan(counts, context):
    """Packing by trying every combination: the exact fills, as (times, lengths), and the gaps of the best-fit rest, sorted."""
    from itertools import combinations_with_replacement

    left, exact = dict(counts), []
    fits = lambda parts: min(left.get(p, 0) // parts.count(p) for p in set(parts))
    for n in range(context, 0, -1):
        while left.get(n):
            rest = None
            for k in range(4):
                found = [c for c in combinations_with_replacement(sorted(left, reverse=True), k) if n + sum(c) == context and fits((n, *c))]
                if found:
                    rest = max(found)
                    break
            if rest is None:
                break
            times = fits((n, *rest))
            for p in (n, *rest):
                left[p] -= times
            exact.append((times, (n, *rest)))
    room = []
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            fit = [g for g in room if g >= n]
            if fit:
                room.remove(min(fit))
            room.append((min(fit) if fit else context) - n)
    return exact, sorted(room)
