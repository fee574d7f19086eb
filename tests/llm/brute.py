"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def contamination(docs, bench, width=10):
    words = lambda t: BENCH_WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out[d] = (len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit))
    return out


def spans(docs, least):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i : i + least] for _, t in texts for i in range(len(t) - least + 1))
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out[d] = (len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), sha(bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def groups(docs, width=5):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def lines(docs, least=10):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    owner = {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), d)
    out = {}
    for d, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < least or owner[key(x)] == d]
        out[d] = (len(every), len(every) - len(kept), sha("\n".join(kept)))
    return out


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def alike(docs, pairs, width=5, words=50, percent=80):
    """The pairs of texts that have, along some alignment, a run of enough shingles that agree to the similarity."""
    least = words - width + 1
    need = -(-2 * percent * least // (100 + percent))
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    out = []
    for a, b in pairs:
        x, y = sets[a], sets[b]
        for shift in range(-len(y), len(x)):
            hit = [0 <= i - shift < len(y) and x[i] == y[i - shift] for i in range(len(x))]
            if any(sum(hit[i : i + least]) >= need for i in range(len(hit) - least + 1)):
                out.append((a, b))
                break
    return out


def languages(rows, names, model, of):
    """Language fusion row by row: (text language, language, posterior, kept) by key."""
    import math

    k = len(names) + 1
    share = [math.log((1 - of.UND_SHARE) / max(1, k - 1))] * (k - 1) + [math.log(of.UND_SHARE)]
    labels = [*names, of.UND]

    def soft(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    scores, own, n = {}, {}, {}
    for key, text, *_ in rows:
        b = b" " + (text or "").encode().translate(of.TABLE) + b" "
        bins = [((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 2654435761 % (1 << 32)) >> 16 for i in range(1, len(b) - 1) if b[i] != 32]
        n[key], weight = len(bins), of.TEXT_WEIGHT / (len(bins) + of.TEXT_WEIGHT)
        scores[key] = [weight * sum(float(m[x]) for x in bins) for m in model] + [-len(bins) * math.log(of.BINS / 4) * weight]
        own[key] = soft([a + c for a, c in zip(scores[key], share, strict=True)])

    def total(test):
        some = [own[r[0]] for r in rows if test(r)]
        return [sum(x) for x in zip(*some, strict=True)] if some else None, len(some)

    every, _ = total(lambda r: True)
    prior = [(x + 1) / (sum(every) + k) for x in every]
    out = {}
    for key, _, declared, host, suffix in rows:
        mine = own[key]

        def lean(counts, base, weight):
            got, _ = counts
            if got is None:
                return base
            rest = max(sum(got) - 1, 0.0)
            return [(max(g - m, 0.0) + weight * p) / (rest + weight) for g, m, p in zip(got, mine, base, strict=True)]

        by_suffix = lean(total(lambda r: suffix is not None and r[4] == suffix), prior, of.SUFFIX_LEAN)
        by_host = lean(total(lambda r: host is not None and r[3] == host and r[4] == suffix), by_suffix, of.HOST_LEAN)
        said, _ = total(lambda r: declared is not None and r[2] == declared)
        fused = [s + math.log(p) for s, p in zip(scores[key], by_host, strict=True)]
        if said is not None:
            fused = [f + math.log((max(c - m, 0.0) + of.DECLARED_LEAN) / (max(t - m, 0.0) + of.DECLARED_LEAN * (k + 1))) for f, c, m, t in zip(fused, said, mine, every, strict=True)]
        post = soft(fused)
        best = max(range(k), key=lambda i: (post[i], -i))
        if n[key]:
            lang = labels[best]
            out[key] = (labels[max(range(k), key=lambda i: (mine[i], -i))], lang, round(post[best], 6), lang != of.UND and round(post[best], 6) >= 0.5)
        else:
            out[key] = (of.UND, of.UND, 1.0, False)
    return out
