"""Plain versions of the operators, for small fixtures."""

from collections import defaultdict


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def groups(nodes, links):
    """Smallest reachable node of each."""
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_groups(docs, percent=85):
    sets, posts = {d: shingles(t) for d, t in docs}, defaultdict(list)
    for d, s in sets.items():
        for g in s:
            posts[g].append(d)
    same = defaultdict(int)
    for ds in posts.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                same[min(a, b), max(a, b)] += 1
    return sets, groups(sets, [p for p, c in same.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
