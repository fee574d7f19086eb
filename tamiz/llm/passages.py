"""Near-duplicate passages by compact windows.

Each text is a sequence of word shingles.  The Cartesian tree over the hash values of grams (runs of shingles) cuts the text
into compact windows (l, c, r): every subsequence within l..r that holds c has the gram at c as its min-hash.  A passage of
the similarity has a run of ``least_run`` shingles word for word (21 of 46, at 80 percent), as every edit loses shingles
of both texts.  Windows of that run are built, so both texts have one around its min-hash, and no passage is missed:

1. equal texts are joined first, one goes on for all its copies; a window lives on if another text has a window of the same
   min-hash.  An exchange of the shingles around such windows then leaves only those where as many shingles as a passage
   must share stand in other texts, near enough to each other;
2. live windows of the same min-hash form a list.  Each list names two texts by hash order, its pivots.  A text meets the
   pivot that most of its windows name; windows inside a passage found there are done, and those that aren't meet their
   lists' pivots, where the windows, laid on each other at their min-hashes, have that run in common.  Only the shingles of
   those intervals are sent, to the block of the other text, and verified: passages of at least ``least`` shingles that
   agree, in a band around the alignment, to a similarity of ``percent`` or more.  Where there is none, what agrees is
   chained over all alignments nearby, so that a passage with words inserted or deleted is judged as one;
3. links join texts to classes.  In a list that still has several classes all its texts meet, done or not, as what stands
   around their windows: those that share a long run, or a shingle beyond a place where they differ, are verified, until
   they are of one class.  So a passage that very many share costs their number, not its square, nor does a shorter line
   that stands in very many texts; texts that stay apart are compared with those of the list that share more than the run.

The classes are those of all pairs; of the passages inside a class not every one is listed.  Shingles are compared by 32
bits of their hashes.  What repeats itself within some words can have other min-hash places in another text; one word over
and over is laid by the ends of the stretch.

Defined cases: null text has no passage; a text of fewer words has none; passages inside one text are not sought; equal rows
and rows that share an id are rows of their own; a very long text is a block of its own, with 14 bytes a window and 8 a shingle
in doubt kept; null doc_id is passed through, but is no class id if another row of the class has one; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import blocks as B
from tamiz.llm.jaccard import same_sets
from tamiz.llm.shared import id_and_text, settle, workspace
from tamiz.llm.shingles import merged, shingle_hashes, word_hashes, word_sequences

WIDTH, PERCENT, WORDS = 5, 80, 50
BAND = 3
#: Pairs that a task verifies at once against one block.
PAIRS = 1024
#: Windows of a block whose surroundings one task cuts out, and of lists that one task compares, at most or so; places compared at once.
CUTS, MEMBERS, ENTRIES = 1 << 13, 1 << 12, 1 << 20
WINDOWS = "sig long, node long, at int, l int, r int"
PASSAGE = "a long, a_start long, a_end long, b long, b_start long, b_end long"


def compact_windows(value: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), of ``least`` places at least, of the Cartesian tree over the values of each range.

    The trees are cut top-down, all ranges of a depth at once.  Equal values are ordered by a permutation of their
    places, so that a text that repeats itself still has a shallow tree.
    """
    bits = max(1, int(len(value)).bit_length())
    mask, odd = np.uint64((1 << bits) - 1), 0x9E3779B97F4A7C15 & ((1 << bits) - 1) | 1
    places = np.arange(len(value), dtype=np.uint64)
    key = np.append((value & ~mask) | (places * np.uint64(odd) & mask), ~np.uint64(0))
    back = np.uint64(pow(odd, -1, 1 << bits))
    out, a, b = [], np.asarray(start, np.int64), np.asarray(end, np.int64)
    while True:
        wide = b - a >= least
        a, b = a[wide], b[wide]
        if not len(a):
            break
        low = np.minimum.reduceat(key, np.stack([a, b], 1).ravel())[::2]
        c = ((low & mask) * back & mask).astype(np.int64)
        out.append((a, c, b - 1))
        a, b = np.concatenate([a, c + 1]), np.concatenate([c, b])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def shared_runs(a: np.ndarray, b: np.ndarray, shifts: list[int], least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(start, end, start in b, end in b) of the places of a in passages that agree with b along one of the shifts."""
    need = -(-2 * percent * least // (100 + percent))  # m / (2 * least - m) >= percent / 100
    out: list[tuple[int, int, int, int]] = []
    for d in sorted(set(shifts)):
        hit = np.zeros(len(a), bool)
        for e in range(d - BAND, d + BAND + 1):  # place i of a stands at i - e in b
            lo, hi = max(0, e), min(len(a), len(b) + e)
            if lo < hi:
                hit[lo:hi] |= a[lo:hi] == b[lo - e : hi - e]
        run = np.cumsum(np.concatenate([[0], hit]))
        full = np.flatnonzero(run[least:] - run[:-least] >= need) if len(run) > least else np.zeros(0, np.int64)
        if len(full):
            cut = np.flatnonzero(np.diff(full) > least)
            for s, e in zip(full[np.concatenate([[0], cut + 1])].tolist(), full[np.concatenate([cut, [len(full) - 1]])].tolist(), strict=True):
                inside = np.flatnonzero(hit[s : e + least])
                x, y = s + int(inside[0]), s + int(inside[-1]) + 1
                out.append((x, y, max(0, x - d), min(len(b), y - d)))
    return out


def _chain(j: list[int]) -> list[int]:
    """Places of a longest strictly ascending part of j."""
    tops, ends, back = [], [], []
    for k, x in enumerate(j):
        n = bisect_left(tops, x)
        tops[n : n + 1], ends[n : n + 1] = [x], [k]
        back.append(ends[n - 1] if n else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _rises(gain: np.ndarray, need: int, least: int) -> np.ndarray:
    """Places s from which some gain[t], t >= s + need - 1, is gain[s] + least or more."""
    if len(gain) < need:
        return np.zeros(0, np.int64)
    top = np.maximum.accumulate(gain[need - 1 :][::-1])[::-1]
    return np.flatnonzero(top - gain[: len(top)] >= least)


def joined_runs(a: np.ndarray, b: np.ndarray, shifts: list[int], found: list[tuple[int, int, int, int]], least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Passages as of ``shared_runs``, outside those already found, whose parts stand on several alignments.

    Hits up to ``least`` places off a shift form one ascending chain; a part of it is a passage if its places in a and
    in b, ``least`` each at least, agree to the similarity.  (A longer passage holds one that drifts less than that.)
    """
    need = -(-2 * percent * least // (100 + percent))
    kinds, kind_of_b = np.unique(b, return_inverse=True)
    kind = np.minimum(np.searchsorted(kinds, a), max(0, len(kinds) - 1))
    free = kinds[kind] == a if len(kinds) else np.zeros(len(a), bool)
    for x, y, _, _ in found:
        free[x:y] = False
    at = np.flatnonzero(free)
    if len(at) < need or min(len(a), len(b)) < least:
        return []
    places = np.sort(kind_of_b.astype(np.int64) * len(b) + np.arange(len(b)))
    out: set[tuple[int, int, int, int]] = set()
    seen: set[tuple[bytes, bytes]] = set()
    for d in sorted(set(shifts)):
        aim = kind[at] * len(b) + np.clip(at - d, 0, len(b) - 1)
        k = np.searchsorted(places, aim)
        near = np.stack([places[np.maximum(k - 1, 0)], places[np.minimum(k, len(places) - 1)]])
        off = np.where(near // len(b) == kind[at], np.abs(near % len(b) - (at - d)), len(a) + len(b))
        j = np.where(off[0] <= off[1], near[0], near[1]) % len(b)
        on = np.flatnonzero(off.min(0) <= least)
        # The part in b is no shorter than its hits, so percent of the places in a must be hit.
        if not len(_rises(100 * np.arange(len(on)) - percent * at[on], need, percent - 100)):
            continue
        if (hits := (on.tobytes(), j[on].tobytes())) in seen:
            continue
        seen.add(hits)
        on = on[_chain(j[on].tolist())]
        i, j = at[on], j[on]
        spans: list[list[int]] = []
        for s in _rises((100 + percent) * np.arange(len(i)) - percent * (i + j), need, percent - 100).tolist():
            size = np.maximum(i[s + need - 1 :] - i[s] + 1, least) + np.maximum(j[s + need - 1 :] - j[s] + 1, least)
            alike = (100 + percent) * (np.arange(len(size)) + need) >= percent * size
            if alike.any():
                t = s + need - 1 + int(alike.argmax())
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(t, spans[-1][1])
                else:
                    spans.append([s, t])
        out.update((int(i[s]), int(i[t]) + 1, int(j[s]), int(j[t]) + 1) for s, t in spans)
    return sorted(out)


def least_run(least: int, percent: int) -> int:
    """Shingles that every passage has in one run, word for word.

    Between two runs of equal shingles a word was replaced (WIDTH shingles of either text are lost), put in or left out
    (WIDTH of one, WIDTH - 1 of the other), so the similarity bounds the number of such gaps.
    """
    need, lost = -(-2 * percent * least // (100 + percent)), 2 * WIDTH - 1
    runs = [-(-need // (gaps + 1)) for gaps in range((least - need) // (WIDTH - 1) + 1)]
    if percent < 100:  # (100 - percent) * hits >= percent * lost shingles
        runs += [-(-max(need, -(-percent * lost * gaps // (100 - percent))) // (gaps + 1)) for gaps in range(1, need)]
    return max(1, min(runs))


def core_run(least: int, percent: int) -> int:
    """Shingles of that run without its ends, whose neighbours are the same in both texts too."""
    return max(1, least_run(least, percent) - 2)


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` shingles one after another."""
    m = max(0, len(h) - width + 1)
    out = np.zeros(m, np.uint64)
    for k in range(width):
        out += h[k : k + m] * B.mix64(np.uint64([0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF]))
    return B.mix64(out)


def gram_windows(g: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of each range; a stretch of equal grams (one word over and over) has its two ends as centres only.

    Two texts with such a stretch are laid on each other by its ends, or anyhow if the passage lies inside both.
    """
    inside = np.zeros(len(g) + 1, bool)  # places that have a place of their range before them
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        inside[a + 1 : b] = True
    before = inside[:-1] & np.concatenate([[False], g[1:] == g[:-1]])[: len(g)]
    after = np.append(before[1:], False)[: len(g)]
    lo, c, hi = compact_windows(np.where(before & after, ~np.uint64(0), g), start, end, least)
    on = ~(before & after)[c]
    first, last = np.flatnonzero(after & ~before), np.flatnonzero(before & ~after)
    long = last - first + 1 >= least
    first, last = first[long], last[long]
    return np.concatenate([lo[on], first, first]), np.concatenate([c[on], first, last]), np.concatenate([hi[on], last, last])


def signature(g: np.ndarray) -> np.ndarray:
    """Keys of windows with these grams at their centre, spread evenly."""
    return B.mix64(g + np.uint64(1))


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in [start, end) of any interval."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _live_windows(manifest: DataFrame, spark, root: str, size: int, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members, windows): each row's node, and the windows that may belong to a passage that two texts have."""
    least = words - WIDTH + 1
    need = -(-2 * percent * least // (100 + percent))
    # Places that hold ``need`` shingles of a passage beside its longest run: a passage in which no smaller one
    # lies has under 2 * least of them, which bounds those that are lost.
    span = need + 2 * least * (100 - percent) // max(1, percent) - (WIDTH - 1)
    run = core_run(least, percent)
    width = (run + 1) // 2
    reps, n_sets = same_sets(manifest, spark, root, WIDTH, size, word_sequences)
    n = B.buckets_for(size / 32, 1 << 20)

    def shingles_of(path: str, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(shingles, first shingle of each row, rows, words of every text) of those of the rows that are long enough."""
        texts = B.Block(path)
        w, text, _, _ = word_hashes(texts)
        h, at = shingle_hashes(w, text, WIDTH)
        cut = np.searchsorted(text[at], np.arange(texts.rows + 1))
        rows = rows[np.diff(cut)[rows] >= least]
        keep = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in rows.tolist()]) if len(rows) else np.zeros(0, np.int64)
        return h[keep], np.concatenate([[0], np.cumsum(np.diff(cut)[rows])]).astype(np.int64), rows, np.bincount(text, minlength=texts.rows)

    def send_windows(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        s = B.load_state(path, "sets")
        cut = np.searchsorted(B.bucket_of(s["key"][:, 0], n_sets), np.arange(n_sets + 1, dtype=np.uint64))
        reply = np.zeros((len(s["key"]), 2), np.uint64)
        for k, data in got.items():
            reply[cut[k] : cut[k + 1]] = np.frombuffer(data, np.uint64).reshape(-1, 2)
        node = reply[:, 0].astype(np.int64)
        own = np.flatnonzero((node >> B.ROW_BITS == block) & ((node & ((1 << B.ROW_BITS) - 1)) == s["first"]))
        rows = np.sort(s["first"][own])
        placed = s["place"] >= 0
        h, start, rows, n_words = shingles_of(path, rows)
        B.save_state(path, "nodes", node=np.where(placed, node[s["place"]], -1) if len(node) else np.full(len(placed), -1), n_words=n_words, rows=rows)
        g = grams(h, width)
        lo, c, hi = gram_windows(g, start[:-1], start[1:] - width + 1, run - width + 1)
        keys, place = np.unique(signature(g[c]), return_inverse=True)
        owner = np.searchsorted(start, c, "right") - 1
        first = np.full(len(keys), -1)
        first[place] = owner
        twice = np.zeros(len(keys), bool)
        twice[place[owner != first[place]]] = True  # another text of this block has it
        B.save_state(path, "windows", lo=lo.astype(np.int32), c=c.astype(np.int32), hi=(hi + width - 1).astype(np.int32), twice=twice)
        return pa.Table.from_batches([B.packets(block, keys, n, lambda k: keys[k].astype(np.uint32).tobytes())])

    def meet(bucket: int, sent: list[bytes]) -> list[bytes | None]:
        return [np.packbits(x).tobytes() if x.any() else None for x in B.shared_between([np.frombuffer(x, np.uint32) for x in sent])]

    def send_shingles(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        s = B.load_state(path, "windows")
        h, start, rows, _ = shingles_of(path, B.load_state(path, "nodes")["rows"])
        sig = signature(grams(h, width)[s["c"]])
        keys, place = np.unique(sig, return_inverse=True)
        live = np.flatnonzero((B.bits_back(keys, n, got) | s["twice"])[place])  # another text has it too
        lo, hi = s["lo"][live].astype(np.int64), s["hi"][live].astype(np.int64)
        owner = np.searchsorted(start, lo, "right") - 1
        inside = cover(len(h), np.maximum(lo - (span - run), start[owner]), np.minimum(hi + 1 + span - run, start[owner + 1]))
        at = np.flatnonzero(inside)
        keys, place = np.unique(h[at], return_inverse=True)
        owner = np.searchsorted(start, at, "right") - 1
        first = np.full(len(keys), -1)
        first[place] = owner
        twice = np.zeros(len(keys), bool)
        twice[place[owner != first[place]]] = True
        used = np.unique(owner)  # texts that may be verified: their shingles are kept, in 32 bits
        B.save_state(path, "texts", h=np.concatenate([np.zeros(0, np.uint32), *(h[start[k] : start[k + 1]].astype(np.uint32) for k in used.tolist())]), start=np.concatenate([[0], np.cumsum(np.diff(start)[used])]).astype(np.int64), rows=rows[used])
        B.save_state(path, "live", live=live.astype(np.int32), sig=sig[live], inside=np.packbits(inside), place=place.astype(np.int32), twice=twice, cut=B.cuts(keys, n), start=start, rows=rows)
        return pa.Table.from_batches([B.packets(block, keys, n, lambda k: keys[k].astype(np.uint32).tobytes())])

    def windows(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        s, u = B.load_state(path, "windows"), B.load_state(path, "live")
        live, start = u["live"], u["start"]
        size = int(start[-1])
        at = np.flatnonzero(np.unpackbits(u["inside"], count=size))
        shared = np.zeros(size + 1, np.int64)
        shared[at + 1] = (B.bits_at(u["cut"], got) | u["twice"])[u["place"]]
        shared = np.cumsum(shared)
        # A passage has ``need`` shingles that other texts have, among ``span`` places at most.
        text = np.searchsorted(start, np.arange(size), "right") - 1
        good = shared[np.minimum(np.arange(size) + span, start[text + 1])] - shared[:-1] >= need if size else np.zeros(0, bool)
        some = np.concatenate([[0], np.cumsum(good)])
        lo, hi = s["lo"][live].astype(np.int64), s["hi"][live].astype(np.int64)
        owner = np.searchsorted(start, lo, "right") - 1
        on = some[hi - run + 2] > some[np.maximum(lo - (span - run), start[owner])]
        live, lo, hi, owner = live[on], lo[on], hi[on], owner[on]
        place = lambda x: (x - start[owner]).astype(np.int32)
        return pa.table({"sig": u["sig"][on].view(np.int64), "node": (block << B.ROW_BITS) + u["rows"][owner], "at": place(s["c"][live].astype(np.int64)), "l": place(lo), "r": place(hi)})

    def members(block: int, path: str):
        b, s = B.Block(path), B.load_state(path, "nodes")
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(b.doc_id, mask=b.null_id), "n_words": s["n_words"], "node": pa.array(s["node"], mask=s["node"] < 0)})

    lists = B.at_buckets(B.at_blocks(manifest, reps, send_windows, B.PACKET), meet, n)
    shared = B.at_buckets(B.at_blocks(manifest, lists, send_shingles, B.PACKET), meet, n)
    found = settle(B.at_blocks(manifest, shared, windows, WINDOWS), f"{root}/windows")
    B.drop_states(spark, manifest, "sets", "windows", "live")
    return B.from_blocks(B.spread(spark, manifest), members, "doc_id long, n_words long, node long"), found


def _at_texts(rows: DataFrame, node: str, root: str, then, schema: str, most: int = PAIRS) -> DataFrame:
    """``then(rows, shingles of a node)`` where the texts of the rows' nodes are, ``most`` rows of a block in a task at most or so."""
    keyed = rows.withColumn("block", F.shiftright(node, B.ROW_BITS))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("m")).select("block", F.ceil(F.col("m") / most).alias("m"))

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        s = B.load_state(f"{root}/blocks/{block}.arrows", "texts")

        def text(node: int) -> np.ndarray:
            k = int(np.searchsorted(s["rows"], node & ((1 << B.ROW_BITS) - 1)))
            return s["h"][s["start"][k] : s["start"][k + 1]]

        return then(t, text)

    salted = keyed.join(sizes, "block").withColumn("salt", F.pmod(F.xxhash64(*rows.columns[:2]), F.col("m"))).drop("m")
    return salted.groupBy("block", "salt").applyInArrow(run, schema)


def _verify(pairs: DataFrame, root: str, least: int, percent: int) -> DataFrame:
    """Passages (a, a_start, a_end, b, b_start, b_end), in shingles, of pairs (a, b, shifts, s, e): s..e in a is where to look."""

    def cut(t: pa.Table, text) -> pa.Table:
        x = [text(a)[max(0, s - least) : e + least + 1].tobytes() for a, s, e in zip(*(t.column(c).to_pylist() for c in ("a", "s", "e")), strict=True)]
        return t.select(["a", "b", "shifts", "s", "e"]).append_column("x", pa.array(x, pa.binary()))

    def look(t: pa.Table, text) -> pa.Table:
        out = []
        for a, b, shifts, s, e, x in zip(*(t.column(c).to_pylist() for c in ("a", "b", "shifts", "s", "e", "x")), strict=True):
            x, y, first = np.frombuffer(x, np.uint32), text(b), max(0, s - least)
            skip = max(0, first - max(shifts) - least)
            y = y[skip : max(skip, e + 1 - min(shifts) + 2 * least)]
            moved = [d - first + skip for d in shifts]
            runs = shared_runs(x, y, moved, least, percent) or joined_runs(x, y, moved, [], least, percent)
            out += [(a, r[0] + first, r[1] + first, b, r[2] + skip, r[3] + skip) for r in runs]
        names = ("a", "a_start", "a_end", "b", "b_start", "b_end")
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, zip(*out, strict=True) if out else [[]] * 6, strict=True)})

    sent = _at_texts(pairs.select("a", "b", "shifts", "s", "e"), "a", root, cut, "a long, b long, shifts array<int>, s int, e int, x binary")
    return _at_texts(sent, "b", root, look, PASSAGE)


def _aligned(rows: DataFrame, run: int) -> DataFrame:
    """Windows laid on each other (node, at, l, r, pivot, pat, pl, pr) as pairs (a, b, shifts, s, e), a the node."""
    shift = F.col("at") - F.col("pat")
    rows = rows.select(F.col("node").alias("a"), F.col("pivot").alias("b"), shift.alias("shift"), F.greatest("l", F.col("pl") + shift).alias("s"), F.least("r", F.col("pr") + shift).alias("e"))
    rows = rows.where(F.col("e") - F.col("s") + 1 >= run)
    return rows.groupBy("a", "b").agg(F.sort_array(F.collect_set("shift")).alias("shifts"), F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("windows"))


def candidates(x: np.ndarray, of: np.ndarray, comp: np.ndarray, need: int):
    """Groups of rows of a list that may have a passage around their windows' centres, the middle of ``x``.

    x: shingles around the centres, a row each, where there is none a value that no other row has; of: the rows' lists;
    comp: their classes.  Yields (rows, kind of each): every two rows of a group that differ in kind may have one; all
    kinds are -1 where all of the group have one, word for word.  A passage around a centre either has ``need`` shingles
    in one run, or a shingle beyond a place where the texts differ.
    """
    middle, places = x.shape[1] // 2, np.arange(x.shape[1], dtype=np.uint64)
    value = B.mix64(x)
    weighed = value * B.mix64(places + np.uint64(1))

    def groups(key: np.ndarray, row: np.ndarray, kind: np.ndarray | None):
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        end = np.append(first, len(key))[1:]
        c = comp[row]
        differ = np.minimum.reduceat(c, first) < np.maximum.reduceat(c, first) if len(key) else np.zeros(0, bool)
        if kind is not None and len(key):
            kind = kind[order]
            differ &= np.minimum.reduceat(kind, first) < np.maximum.reduceat(kind, first)
        for s, e in zip(first[differ].tolist(), end[differ].tolist(), strict=True):
            yield row[s:e], np.full(e - s, -1) if kind is None else kind[s:e]

    # The hash of a run, whatever its place, from running sums with powers of an odd number.
    base, back = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    power = np.array([pow(base, k, 1 << 64) for k in range(x.shape[1])], np.uint64)
    total = np.concatenate([np.zeros((len(x), 1), np.uint64), np.cumsum(value * power, axis=1, dtype=np.uint64)], axis=1)
    lists = B.mix64(of.astype(np.uint64) + np.uint64(1))
    for s in range(max(0, middle - need + 1), min(middle, x.shape[1] - need) + 1):
        yield from groups(B.mix64((total[:, s + need] - total[:, s]) * np.uint64(pow(back, s, 1 << 64))) ^ lists, np.arange(len(x)), None)
    # What stands between the centre and a shingle, that included; it is the same where the texts agree up to there.
    reach = np.concatenate([np.cumsum(weighed[:, middle::-1], axis=1, dtype=np.uint64)[:, ::-1], np.cumsum(weighed[:, middle + 1 :], axis=1, dtype=np.uint64)], axis=1)
    # Of a stretch of equal shingles its first is enough; the centre's own stands for passages inside it.
    same = x[:, 1:] == x[:, :-1]
    some = np.concatenate([~same[:, :middle], np.zeros((len(x), 1), bool), ~same[:, middle:]], axis=1)
    some[:, middle] = np.cumprod(same[:, middle:], axis=1).sum(1) + np.cumprod(same[:, :middle][:, ::-1], axis=1).sum(1) + 1 >= need
    row, place = np.nonzero(some)
    key, reach = value[row, place] ^ lists[row], reach[row, place]
    parts = -(-len(key) // ENTRIES)
    part = (key >> np.uint64(40)) % np.uint64(max(1, parts))
    for k in range(parts):
        on = np.flatnonzero(part == k)
        yield from groups(key[on], row[on], reach[on])


def may_agree(x: np.ndarray, y: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Which rows of x may have a passage with y: bounds of what ``shared_runs`` and ``joined_runs`` ask for, for all rows at once."""
    need = -(-2 * percent * least // (100 + percent))
    out = np.zeros(len(x), bool)
    wide, band = x.shape[1], np.pad(y, BAND, constant_values=~np.uint64(0))
    ours, theirs = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    for e in range(2 * BAND + 1):
        same = x == band[e : e + wide]
        ours |= same
        lo, hi = max(0, e - BAND), min(wide, wide + e - BAND)  # the same places of y
        theirs[:, lo:hi] |= same[:, lo - (e - BAND) : hi - (e - BAND)]
    for hit in (ours, theirs):
        run = np.concatenate([np.zeros((len(x), 1), np.int32), np.cumsum(hit, axis=1, dtype=np.int32)], axis=1)
        out |= (run[:, least:] - run[:, :-least] >= need).any(1)
    # Chained hits: ``need`` of them, and ``percent`` of the places, so some 100 * need / percent places or more hold that share.
    run = np.concatenate([np.zeros((len(x), 1), np.int32), np.cumsum(np.isin(x, y), axis=1, dtype=np.int32)], axis=1)
    gain, span = 100 * run - percent * np.arange(wide + 1), min(wide, 100 * need // percent)
    return out | (gain[:, span:] >= np.minimum.accumulate(gain, axis=1)[:, : wide + 1 - span]).any(1)


def _meet_lists(rows: DataFrame, root: str, least: int, percent: int) -> DataFrame:
    """Passages that join classes, between the texts of each list; rows: sig, node, at, comp.

    Texts are brought together as what stands around their windows, and compared where they may have a passage, until
    they are of one class; so a list yields no more passages than it has texts.
    """
    need, wide = -(-2 * percent * least // (100 + percent)), 2 * least

    def cut(t: pa.Table, text) -> pa.Table:
        x, first = [], []
        for node, at in zip(t.column("node").to_pylist(), t.column("at").to_pylist(), strict=True):
            first.append(max(0, at - wide))
            x.append(text(node)[first[-1] : at + wide + 1].tobytes())
        return t.select(["sig", "node", "comp", "at"]).append_column("first", pa.array(first, pa.int32())).append_column("x", pa.array(x, pa.binary()))

    def meet(t: pa.Table) -> pa.Table:
        sig, node, comp, at, first = (t.column(c).to_numpy() for c in ("sig", "node", "comp", "at", "first"))
        x = t.column("x").to_pylist()
        # Of rows of one class that look the same one is enough.
        once = list({(s, c, v): i for i, (s, c, v) in enumerate(zip(sig.tolist(), comp.tolist(), x, strict=True))}.values())
        once.sort(key=sig.__getitem__)
        of = np.unique(sig[once], return_inverse=True)[1]
        size_of = np.bincount(of)
        comp, node, at, first = comp[once], node[once].tolist(), at[once].tolist(), first[once].tolist()
        text = [np.frombuffer(x[i], np.uint32) for i in once]

        def spread_out(s: int, e: int) -> np.ndarray:
            full = (np.arange((e - s) * (2 * wide + 1), dtype=np.uint64) + np.uint64(1 << 32)).reshape(e - s, -1)
            for i in range(s, e):
                k = first[i] - at[i] + wide
                full[i - s, k : k + len(text[i])] = text[i]
            return full

        names, comp = np.unique(comp, return_inverse=True)
        up = np.arange(len(names)).tolist()

        def top(c: int) -> int:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        out, klass, base = [], comp.tolist(), np.searchsorted(of, of)
        ends, s = np.append(0, np.cumsum(size_of)), 0
        while s < len(of):  # whole lists, as many as fit
            e = int(max(ends[np.searchsorted(ends, s, "right")], ends[np.searchsorted(ends, s + MEMBERS, "right") - 1]))
            full, tried = spread_out(s, e), {}
            for group, kind in candidates(full, of[s:e], comp[s:e], need):
                group = group + s
                tops = np.array([top(klass[i]) for i in group.tolist()])
                classes, counts = np.unique(tops, return_counts=True)
                if len(classes) < 2:
                    continue
                if kind[0] == -1:
                    turns = [(0, np.arange(1, len(group)))]
                else:
                    turns = ((n, np.flatnonzero(kind != kind[n])) for n in np.flatnonzero(tops != classes[counts.argmax()]).tolist())
                for n, others in turns:
                    i = int(group[n])
                    done = tried.setdefault(i, np.zeros(size_of[of[i]], bool))
                    others = group[others[tops[others] != tops[n]]]
                    others = others[~done[others - base[i]]]
                    for at_once in np.array_split(others, -(-len(others) // 1024)) if len(others) else []:
                        done[at_once - base[i]] = True
                        for j in at_once[may_agree(full[at_once - s], full[i - s], least, percent)].tolist():
                            if top(klass[i]) == top(klass[j]):
                                continue
                            shift = (at[i] - first[i]) - (at[j] - first[j])
                            there, back = (text[i], text[j], [shift]), (text[j], text[i], [-shift])
                            runs = shared_runs(*there, least, percent) or [(*r[2:], *r[:2]) for r in shared_runs(*back, least, percent)] or joined_runs(*there, [], least, percent)
                            for r in runs:
                                out.append((node[i], r[0] + first[i], r[1] + first[i], node[j], r[2] + first[j], r[3] + first[j]))
                                up[top(klass[i])] = top(klass[j])
            s = e
        names = ("a", "a_start", "a_end", "b", "b_start", "b_end")
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, zip(*out, strict=True) if out else [[]] * 6, strict=True)})

    n = max(1, -(-rows.count() // MEMBERS))
    around = _at_texts(rows.select("sig", "node", "at", "comp"), "node", root, cut, "sig long, node long, comp long, at int, first int, x binary", CUTS)
    return around.withColumn("task", F.pmod(F.xxhash64("sig"), F.lit(n))).repartition(min(n, B.MOST_TASKS), "task").groupBy("task").applyInArrow(lambda t: meet(t.drop(["task"])), PASSAGE)


def _open_windows(windows: DataFrame, links: DataFrame) -> DataFrame:
    """The windows, with ``open``: whether their place lies in no passage that has been found."""
    side = lambda x: links.select(F.col(x).alias("node"), F.col(f"{x}_start").alias("s"), F.col(f"{x}_end").alias("e"))
    spans = side("a").unionByName(side("b")).groupBy("node", "s").agg(F.max("e").alias("e"))  # one a place at most, however many texts share it
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    j = windows.drop("open").join(spans, "node", "left")
    inside = F.exists("spans", lambda x: (F.col("at") >= x["s"]) & (F.col("at") < x["e"]))
    return j.withColumn("open", ~F.coalesce(inside, F.lit(False))).drop("spans")


def passage_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, classes): every row's node, verified passages between the nodes' texts, and the class (node, comp) of these."""
    docs = id_and_text(docs)
    spark, root, least = docs.sparkSession, workspace(docs.sparkSession, "passages"), words - WIDTH + 1
    run = core_run(least, percent)
    manifest = B.write_blocks(docs, root)
    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    members, windows = _live_windows(manifest, spark, root, size, words, percent)
    # Each list's pivots, the first and the last by a hash of the node: plain longs, so that the aggregate need not sort.
    order = F.xxhash64("node", F.lit(0))
    spot = F.struct("at", "l", "r")
    lists = windows.groupBy("sig").agg(F.min_by("node", order).alias("lo"), F.max_by("node", order).alias("hi")).where("lo <> hi")
    live = settle(windows.join(lists, "sig"), f"{root}/lists")
    at_pivot = live.select("sig", F.explode(F.array("lo", "hi")).alias("p"), "node", spot.alias("w")).where("node = p").groupBy("sig", "p").agg(F.min("w").alias("w"))
    pivots = settle(at_pivot.select("sig", F.col("p").alias("pivot"), F.col("w.at").alias("pat"), F.col("w.l").alias("pl"), F.col("w.r").alias("pr")), f"{root}/pivots")
    live = live.drop("lo", "hi")
    links, label, tried = None, None, None

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Adds the passages of the pairs to the links, and joins their classes; pairs of one class are left out.

        A pair that was looked at before is looked at again only along new shifts.
        """
        nonlocal links, label, tried
        if label is not None:
            of = lambda x: label.select(F.col("node").alias(x), F.col("comp").alias(f"{x}c"))
            pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ac", "a") != F.coalesce("bc", "b"))
            pairs = pairs.join(tried, ["a", "b"], "left").withColumn("shifts", F.when(F.col("had").isNull(), F.col("shifts")).otherwise(F.array_except("shifts", "had"))).where("size(shifts) > 0")
        pairs = settle(pairs.select("a", "b", "shifts", "s", "e"), f"{root}/pairs-{name}")
        found = settle(_verify(pairs, root, least, percent), f"{root}/links-{name}")
        links = found if links is None else links.unionByName(found)
        label = merged(label, found.select("a", "b"), f"{root}/classes-{name}")
        had = pairs.select("a", "b", F.col("shifts").alias("had"))
        tried = had if tried is None else tried.unionByName(had).groupBy("a", "b").agg(F.array_distinct(F.flatten(F.collect_list("had"))).alias("had"))

    def undecided() -> DataFrame:
        """The windows of lists that have texts of several classes."""
        now = live.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = now.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("sig")
        return now.join(several, "sig", "left_semi")

    # First the pivot that most windows of a text name, then every pivot of the windows that are still open.
    star = lambda w: _aligned(w.join(pivots, "sig").where("node <> pivot"), run)
    top = star(live).groupBy("a").agg(F.max_by(F.struct("b", "shifts", "s", "e"), F.struct("windows", "b")).alias("p")).select("a", "p.*")
    verified(top, "best")
    live = settle(_open_windows(undecided().drop("comp"), links), f"{root}/open")
    verified(star(live.where("open")), "pivots")
    # Lists that still have several classes: all their texts meet, done or not.
    found = settle(_meet_lists(settle(undecided().select("sig", "node", "at", "comp"), f"{root}/rest"), root, least, percent), f"{root}/links-rest")
    links, label = links.unionByName(found), merged(label, found.select("a", "b"), f"{root}/classes-rest")
    turned = links.where("a > b").select(F.col("b").alias("a"), F.col("b_start").alias("a_start"), F.col("b_end").alias("a_end"), F.col("a").alias("b"), F.col("a_start").alias("b_start"), F.col("a_end").alias("b_end"))
    return settle(members, f"{root}/members"), links.where("a < b").unionByName(turned).distinct(), label


def repeated_passages(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document with a passage that another document has too.

    class_id: smallest doc_id that passages and copies connect it with; copy_of: smallest doc_id of the documents with
    the same words in the same order; spans: its passages in words, as found in the text that stands for its copies, with the
    doc_id of the other text.
    """
    members, links, label = passage_links(docs, words, percent)
    root = workspace(docs.sparkSession, "passage-classes")
    first = settle(members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.max("n_words").alias("long")), f"{root}/first")
    side = lambda x, y: links.select(F.col(x).alias("node"), F.col(y).alias("other"), F.struct(F.col(f"{x}_start").alias("start"), (F.col(f"{x}_end") + WIDTH - 1).alias("end")).alias("span"))
    both = settle(side("a", "b").unionByName(side("b", "a")).distinct(), f"{root}/links")
    named = label.join(first.select("node", "copy_of"), "node")
    named = named.join(named.groupBy("comp").agg(F.min("copy_of").alias("class_id")), "comp").select("node", "class_id")
    # Partners of a text are gathered per span, the smallest first: a passage that very many share stays one row each.
    spans = both.join(first.select(F.col("node").alias("other"), F.col("copy_of").alias("doc")), "other").groupBy("node", "span").agg(F.min("doc").alias("doc"), F.count("*").alias("texts"))
    spans = spans.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("span.start", "span.end", F.col("doc").alias("doc_id"), "texts"))).alias("spans"))
    row = members.where("node IS NOT NULL").join(first, "node").join(named, "node", "left").join(spans, "node", "left")
    row = row.where(F.col("class_id").isNotNull() | ((F.col("copies") > 1) & (F.col("long") >= words)) | F.col("spans").isNotNull())
    return row.select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", "copies", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long,doc_id:long,texts:long>>")).alias("spans"))


def op8_near_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["compact_windows", "joined_runs", "op8_near_passages", "passage_links", "repeated_passages", "shared_runs"]
