"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def covered(seqs, size):
    """{id: flags}: units covered by windows that also start under a smaller id."""
    first = {}
    for d, s in sorted(seqs):
        for p in range(len(s) - size + 1):
            first.setdefault(tuple(s[p:p + size]) if isinstance(s, list) else s[p:p + size], d)
    out = {}
    for d, s in seqs:
        gone = bytearray(len(s))
        for p in range(len(s) - size + 1):
            if first[tuple(s[p:p + size]) if isinstance(s, list) else s[p:p + size]] < d:
                gone[p:p + size] = b"\x01" * size
        out[d] = gone
    return out


def substring_words(docs, size=50):
    seqs = [(d, [w.encode() for w in WORD.findall(t or "")]) for d, t in docs]
    gone = covered(seqs, size)
    return {d: (len(s), sum(gone[d]), hashlib.sha256(b" ".join(w for w, g in zip(s, gone[d], strict=True) if not g)).hexdigest()) for d, s in seqs}


def substring_bytes(docs, size=50):
    seqs = [(d, (t or "").encode()) for d, t in docs]
    gone = covered(seqs, size)
    return {d: (len(s), sum(gone[d]), len(re.findall(rb"\x01+", bytes(gone[d]))), hashlib.sha256(bytes(c for c, g in zip(s, gone[d], strict=True) if not g)).hexdigest())
            for d, s in seqs}


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_dups(docs, k, percent):
    sets = {d: shingle_set(t, k) for d, t in docs}
    groups, inverted = Union(sets), defaultdict(list)
    for d, s in sorted(sets.items()):
        seen = Counter(e for g in s for e in inverted[g])
        for e, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                groups.join(d, e)
        for g in s:
            inverted[g].append(d)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def near_vectors(rows, threshold):
    import numpy as np

    ok = [(i, np.asarray(v, float), lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))]
    groups, links = Union([r[0] for r in rows]), Counter()
    by = defaultdict(list)
    for i, v, lab in ok:
        by[lab, len(v)].append((i, v / np.linalg.norm(v)))
    for members in by.values():
        x = np.stack([v for _, v in members])
        near = np.argwhere(np.triu(x @ x.T >= threshold, 1))
        for a, b in near:
            links[members[a][0]] += 1
            links[members[b][0]] += 1
            groups.join(members[a][0], members[b][0])
    return {r[0]: (links[r[0]], groups.find(r[0])) for r in rows}


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if a == b:
        return 0
    return 1 if a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:] else 2


def near_lines(docs, min_chars):
    places = {}
    for d, t in sorted(docs):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if len(line) >= min_chars:
                places.setdefault(line, (d, k))
    by_half = defaultdict(set)
    for x in places:
        for m in (len(x) - 1, len(x)):
            by_half["a", m, x[: m // 2]].add(x)
            by_half["b", m, x[len(x) - (m - m // 2):]].add(x)
    bad = set()
    for xs in by_half.values():
        xs = sorted(xs, key=places.get)
        for i, x in enumerate(xs):
            if x not in bad and any(edits(x, y) == 1 for y in xs[:i]):
                bad.add(x)
    out = {}
    for d, t in docs:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if len(x) < min_chars or (places[x] == (d, k) and x not in bad)]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def leaks(docs, items, similarity=0.8, k=5):
    def toks(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def bag(w):
        return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))

    by = defaultdict(set)
    bags = {}
    for i, t in items:
        w = toks(t)
        if len(w) >= k:
            bags[i] = (len(w), bag(w))
            for g in bags[i][1]:
                by[g].add(i)
    out = {}
    for d, t in docs:
        w = toks(t)
        near = defaultdict(set)
        for p in range(len(w) - k + 1):
            for i in by.get(tuple(w[p:p + k]), ()):
                n = bags[i][0]
                near[i].update(range(max(0, p - n + k), min(p, len(w) - n) + 1))
        for i, starts in near.items():
            n, want = bags[i]
            for s in starts:
                c = sum((bag(w[s:s + n]) & want).values())
                sim = c / (2 * (n - k + 1) - c)
                if sim >= similarity - 1e-12 and sim > out.get((d, i), (0, 0))[0] + 1e-12:
                    out[d, i] = (sim, s)
    return out
