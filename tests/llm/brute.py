"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import numpy as np
import xxhash


def roots(ids, linked):
    """Smallest reachable id of each item; ``linked`` lists index pairs."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    low = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None and (low.get(r) is None or i < low[r]):
            low[r] = i
        low.setdefault(r, None)
    return [low[find(k)] for k in range(len(ids))]


def simhash(text, words=3):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    hashes = [
        xxhash.xxh64_intdigest(" ".join(tokens[k : k + words]).encode(), seed=42) for k in range(n)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def simhash_classes(rows, bits=2):
    prints = [simhash(t) for _, t in rows]
    pairs = [
        (a, b)
        for a in range(len(rows))
        for b in range(a + 1, len(rows))
        if bin(prints[a] ^ prints[b]).count("1") <= bits
    ]
    return prints, roots([i for i, _ in rows], pairs)


def cosine(a, b):
    a, b = np.array(a, dtype=float), np.array(b, dtype=float)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def base_spans(text):
    out = []
    kinds = (
        (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        (r"(AKIA[A-Z0-9]+)", 20),
        (r"([0-9a-f]+)", 24),
    )
    for kind, (pattern, least) in enumerate(kinds):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return sorted(out)


def mix(rows, weights=(3, 1, 2), share=1.5, repeats=2, seed="mix-1"):
    """Copies of each ``(id, text, source)``, by its place in the list."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    key = [md5(f"{seed}:{'null' if i is None else i}:{md5(t or '')}") for i, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, full = share * sum(size), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            break
        level = (budget - sum(repeats * total[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if repeats * total[s] <= level * weight[s]}
        if not over:
            break
        full |= over
    target = {s: float(repeats * total[s]) if s in full else level * weight[s] for s in names}
    twins, items = {}, []
    upto = dict.fromkeys(names, 0)
    for k in sorted(range(len(rows)), key=lambda k: key[k]):
        s = rows[k][2]
        upto[s] += size[k]
        twin = twins[key[k], s] = twins.get((key[k], s), 0) + 1
        group = "n" if s is None else "s" + s
        for c in range(repeats if size[k] else 0):
            items.append(((upto[s] + c * total[s]) / target[s], group, key[k], twin, c, k))
    copies, taken = [0] * len(rows), 0
    for *_, k in sorted(items):
        taken += size[k]
        if taken > budget:
            break
        copies[k] += 1
    return size, total, target, copies
