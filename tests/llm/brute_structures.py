"""Plain Python versions of the trie, the clustering and the repeated strings."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def trie(rows):
    """Rows of (conv_id, turn, role, text) -> {(conv_id, depth): other columns}; turns of a conversation must differ."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        if p:
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    ends = {p: [str(c) for c in sorted(m) if len(whole[c]) == len(p)] for p, m in members.items()}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(ends[p]).encode()).hexdigest())
        for p, m in members.items()
    )


def clusters(rows, k=16, rounds=3, dims=64):
    """Rows of (vec_id, components) -> sorted rows of the query."""
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**900 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), [str(x) for x in r[1]]))
    centroids = [v for _, v in order[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (apart(v, centroids[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, j := nearest(v), apart(v, centroids[j])) for i, v in kept]
    fits = lambda x: x if x is not None and x < 2**63 else None
    sums = {j: sum(d for _, x, d in found if x == j) if all(fits(d) is not None for _, x, d in found if x == j) else None for _, j, _ in found}
    total = None if None in sums.values() else sum(sums.values())
    return [(i, j, fits(d), fits(sums[j]), fits(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found]


def repeats(rows, threshold):
    """Rows of (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept bytes) in their order."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = {}
    for _, b in texts:
        for k in range(len(b) - threshold + 1):
            w = b[k : k + threshold]
            times[w] = times.get(w, 0) + 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - threshold + 1):
            if times[b[k : k + threshold]] > 1:
                gone[k : k + threshold] = b"\1" * threshold
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out
