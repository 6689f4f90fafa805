"""Plain versions of operators, for comparison on small inputs."""

import hashlib


def repeats(rows, span=50):
    """rows: (doc_id, text). -> {index: (n_bytes, n_removed, n_spans, sha256)}"""
    first = {}
    data = [(i if i is not None else 1 << 63, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - span + 1):
            w = b[p:p + span]
            if w not in first or first[w] > i:
                first[w] = i
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p:p + span]] < i:
                gone[p:p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        n_spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def near_stay(rows, n=5):
    """Ids of rows (doc_id, text) that stay: no near copy (Jaccard similarity of word shingles, 4/5 or more) of one with a smaller id that stays."""
    def cut(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        return {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))}

    stay = []
    for i, t in sorted(rows):
        s = cut(t)
        if all(5 * len(s & o) < 4 * len(s | o) for _, o in stay):
            stay.append((i, s))
    return {i for i, _ in stay}


def mix_copies(rows, weights=(1, 2, 3), most=3, seed=17, bucket_docs=4096):
    """Times that each of the rows (doc_id, source, text) is taken whole."""
    import math

    size = [len((t or "").encode().split()) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total = {s: sum(n for n, (_, x, _) in zip(size, rows) if x == s) for s in sources}
    target, open_ = {}, set(sources)
    while open_:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * total[s]}
        target |= {s: most * total[s] for s in above} if above else share
        open_ = open_ - above if above else set()
    out = [0] * len(rows)
    for s in sources:
        own = [k for k, r in enumerate(rows) if r[1] == s]
        epochs = target[s] / total[s] if total[s] else 0.0
        key = {k: hashlib.md5(f"{seed}:{'null' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest() for k in own}
        buckets = {}
        for k in own:
            buckets.setdefault(int(key[k][:8], 16) % math.ceil(len(own) / bucket_docs), []).append(k)
        for members in buckets.values():
            owed = math.floor((epochs - math.floor(epochs)) * sum(size[k] for k in members) + 0.5)
            for k in sorted(members, key=lambda k: (key[k], size[k])):
                extra = max(0, min(size[k], owed))
                owed -= size[k]
                out[k] = (math.floor(epochs) + (2 * extra >= size[k])) if size[k] else 0
    return out
