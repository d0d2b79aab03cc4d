"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def suffix(rows, size=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw, own = (text or "").encode(), set()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - size + 1):
            w = raw[p : p + size]
            if w in seen or w in own:
                gone[p : p + size] = True
            own.add(w)
        seen |= own
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def substring(rows, size=13):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        ws, own = words(text), set()
        gone = [False] * len(ws)
        for p in range(len(ws) - size + 1):
            w = tuple(ws[p : p + size])
            if w in seen:
                gone[p : p + size] = [True] * size
            own.add(w)
        seen |= own
        out[i] = (len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone) if not g).encode()).hexdigest())
    return out


def near(rows, size=5, percent=75):
    sets, holders = {}, defaultdict(list)
    for i, text in rows:
        ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(ws[k : k + size]) for k in range(max(len(ws) - size + 1, 1))} if ws else set()
        for s in sets[i]:
            holders[s].append(i)
    links = []
    for i, own in sets.items():
        common = Counter(j for s in own for j in holders[s] if j < i)
        links += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(own) + len(sets[j]) - n)]
    least = groups(sets, links)
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


def vectors(rows, cosine=0.98):
    by, degree, links = defaultdict(list), Counter(), []
    for i, v, label in rows:
        if label is not None and v and all(c is not None for c in v) and np.isfinite(np.array(v)).all() and np.any(v):
            by[label].append((i, np.array(v, float)))
    for own in by.values():
        for k, (i, x) in enumerate(own):
            for j, y in own[:k]:
                if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((i, j))
                    degree.update([i, j])
    least = groups([r[0] for r in rows], links)
    return {i: (degree[i], least[i], least[i] == i) for i, *_ in rows}
