"""Plain versions of the operators for small tables of (doc_id, text)."""

import hashlib
import re


class Forest(dict):
    def root(self, i):
        while self.setdefault(i, i) != i:
            i = self[i]
        return i

    def tie(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def near(rows, percent, k=5):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    forest, ids = Forest(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                forest.tie(a, b)
    return {d: (len(s), forest.root(d)) for d, s in sets.items()}


def passages(rows, window=20):
    first, docs = {}, {}
    for d, t in sorted(rows):
        w = docs[d] = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in docs.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), len(w) - len(kept), b" ".join(kept).decode())
    return out


RULES = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(RULES) for m in p.finditer(text or "") if len(m[g]) >= least)
    return tuple(sum(f[1] == k for f in found) for k in range(3)), ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in found)


def exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    return sorted((d, min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
