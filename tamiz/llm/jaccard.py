"""Jaccard self-join on sets of word shingles: size-aware, heavy and light.

Equal sets are joined first, by a 128-bit hash of the set; one of them goes on for all.  Shingles are then counted over
the distinct sets, so that each set can be ordered from rare to frequent, the same way everywhere.  Two sets A, B with
similarity t share at least t * |A| shingles, so

* (heavy) the first |A| - ceil(t |A|) + 1 shingles of A and of B have one in common: large sets scan the inverted
  lists of theirs;
* (light) with one shingle more they have two in common: small sets enumerate the subsets of two, which few other
  sets have.

A shingle that only one set has can match nothing and is never written; a set with too few shared shingles is out.

Only components are asked for, and groups of copies make long lists, so lists are first met by pivots: in each round a
set is checked against a few members of its lists, those that most of its lists name or that are nearest to it by the parities
of their hash bins; the members differ by round, and lists whose sets are all in one component are done.  So a group costs its size, not its square.  The sets of the lists that are
left open are then joined in full: sets smaller than the ``boundary`` by their subsets, larger ones by scanning their lists,
and sets small enough to match larger ones by both.  The boundary is the one with the least total cost: what is written, and
the pairs that meet, counted as second moments of the two streams of keys with linear sketches of all rows, one a size class.
Pairs of one component, of sizes too far apart, or whose hash bins' parities rule the similarity out, are left out; every
other pair is checked on the whole sets, and no link between components is lost.

Defined cases: a text without words has an empty set and is linked with nothing; a text of fewer words than a shingle is
one shingle; copies have links without a check; equal rows, and rows that share an id, are rows of their own; a very long text
is a block of its own, whose set is kept whole (8 bytes a shingle); a null doc_id is no smallest id (a component of such rows only has a null
id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import blocks as B
from tamiz.llm.shared import id_and_text, settle, workspace
from tamiz.llm.shingles import merged, shingle_sets

WIDTH, PERCENT = 5, 80
LAST = np.iinfo(np.int64).max
SURVIVOR = "node long, doc_id long, n long, ranked binary, toks binary, bits array<long>"
#: For each round, the pivots that a list names, and those of them that a set meets.
PIVOTS = ((1, 1), (8, 4))
WORDS = 8
EARLIER = 32
#: Counters of a sketch; sizes are taken in steps of an eighth of a doubling.
WIDE = 1024


def frequency_code(df: np.ndarray) -> np.ndarray:
    """One byte that grows with the frequency: exact below 128, then an eighth of a doubling a step; 0 for a single set."""
    df = np.maximum(df, 1)
    return np.where(df < 2, 0, np.where(df < 128, df, np.minimum(255, 128 + 8 * np.log2(df / 128)))).astype(np.uint8)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit hash of each set."""
    with np.errstate(over="ignore"):
        a = np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
        b = np.array([B.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return np.stack([B.mix64(a), b], 1)


def parities(tokens: np.ndarray) -> list[int]:
    """WORDS 64-bit words: for each bin of the shingles' hashes whether an odd number fell there.

    Bins that differ between two sets are no more than the shingles that only one of them has.
    """
    odd = np.bincount((tokens >> np.uint64(8)) & np.uint64(64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def same_sets(manifest: DataFrame, spark, root: str, width: int, size: int, sets_of=shingle_sets) -> DataFrame:
    """Join equal sets, or what ``sets_of`` tells of the texts; every block learns the node (first row) and smallest doc_id of its rows' sets."""
    n = B.buckets_for(size / 200, 1 << 18)

    def emit(block: int, path: str):
        texts = B.Block(path)
        sets = sets_of(texts, width)
        key = set_keys(sets)
        some = np.flatnonzero(np.array([len(s) > 0 for s in sets], bool)) if sets else np.zeros(0, np.int64)
        ids = np.where(texts.null_id, LAST, texts.doc_id)
        order = some[np.lexsort((ids[some], key[some, 1], key[some, 0]))]
        k = key[order]
        head = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]) if len(k) else np.zeros(0, bool)
        place = np.full(texts.rows, -1, np.int64)
        place[order] = np.cumsum(head) - 1
        B.save_state(path, "sets", place=place, key=k[head], first=order[head], n=np.array([len(s) for s in sets], np.int64))
        k, first = k[head], order[head]
        rows = np.stack([k[:, 0], k[:, 1], ids[first].astype(np.uint64), (block << B.ROW_BITS) + first.astype(np.uint64)], 1)
        yield B.packets(block, k[:, 0], n, lambda s: rows[s].tobytes())

    def answer(bucket: int, sent: list[bytes]) -> list[bytes | None]:
        parts = [np.frombuffer(x, np.uint64).reshape(-1, 4) for x in sent]
        rows = np.concatenate(parts)
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
        r = rows[order]
        head = np.concatenate([[True], (r[1:, :2] != r[:-1, :2]).any(axis=1)])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        out = np.empty((len(rows), 2), np.uint64)
        out[order] = r[first][:, [3, 2]]
        return [x.tobytes() for x in np.split(out, np.cumsum([len(p) for p in parts])[:-1])]

    return B.at_buckets(B.from_blocks(B.spread(spark, manifest), emit), answer, n), n


def survivors(docs: DataFrame, root: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, members, survivors): the blocks; each row's node; of each distinct set that may have a partner its ordered shingles."""
    spark = docs.sparkSession
    manifest = B.write_blocks(docs, root)
    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    reps, n_sets = same_sets(manifest, spark, root, width, size)
    n = B.buckets_for(size / 5, 1 << 20)

    def distinct_tokens(path: str, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        every = shingle_sets(B.Block(path), width)
        sets = [every[i] for i in rows.tolist()]
        keys, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        return sets, keys, count

    def send_tokens(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        s = B.load_state(path, "sets")
        cut = np.searchsorted(B.bucket_of(s["key"][:, 0], n_sets), np.arange(n_sets + 1, dtype=np.uint64))
        reply = np.zeros((len(s["key"]), 2), np.uint64)
        for k, data in got.items():
            reply[cut[k] : cut[k + 1]] = np.frombuffer(data, np.uint64).reshape(-1, 2)
        node, doc = reply[:, 0].astype(np.int64), reply[:, 1].astype(np.int64)
        own = np.flatnonzero(node >> B.ROW_BITS == block)
        own = own[(node[own] & ((1 << B.ROW_BITS) - 1)) == s["first"][own]]
        rows = s["first"][own]
        B.save_state(path, "nodes", node=np.where(s["place"] >= 0, node[s["place"]], -1) if len(node) else np.full(len(s["place"]), -1), rep=np.where(s["place"] >= 0, doc[s["place"]], LAST) if len(doc) else np.full(len(s["place"]), LAST), rows=rows, docs=doc[own])
        _, keys, count = distinct_tokens(path, rows)
        low, count = keys.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        return pa.Table.from_batches([B.packets(block, keys, n, lambda k: low[k].tobytes() + count[k].tobytes())])

    def count_tokens(bucket: int, sent: list[bytes]) -> list[bytes | None]:
        sizes = [len(x) // 5 for x in sent]
        keys = np.concatenate([np.frombuffer(x, np.uint32, m) for x, m in zip(sent, sizes, strict=True)])
        count = np.concatenate([np.frombuffer(x, np.uint8, m, 4 * m) for x, m in zip(sent, sizes, strict=True)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        head = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
        code = np.empty(len(keys), np.uint8)
        code[order] = frequency_code(np.add.reduceat(count[order], np.flatnonzero(head)))[np.cumsum(head) - 1]
        return [x.tobytes() if x.any() else None for x in np.split(code, np.cumsum(sizes)[:-1])]

    def rank(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        s = B.load_state(path, "nodes")
        sets, keys, _ = distinct_tokens(path, s["rows"])
        cut = np.searchsorted(B.bucket_of(keys, n), np.arange(n + 1, dtype=np.uint64))
        code = np.zeros(len(keys), np.uint8)
        for k, data in got.items():
            code[cut[k] : cut[k + 1]] = np.frombuffer(data, np.uint8)
        out = []
        for row, doc, t in zip(s["rows"].tolist(), s["docs"].tolist(), sets, strict=True):
            c = code[np.searchsorted(keys, t)]
            need = -(-percent * len(t) // 100)
            shared = np.flatnonzero(c)
            room = len(t) - need + 1 - (len(t) - len(shared))  # places of the prefix that shared shingles take
            if room <= 0:
                continue
            first = shared[np.lexsort((t[shared], c[shared]))][: room + 1]
            out.append(((block << B.ROW_BITS) + row, doc, len(t), t[first].tobytes(), t.tobytes(), parities(t)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("node", "doc_id", "n", "ranked", "toks", "bits"), cols, kinds, strict=True)})

    counts = B.at_buckets(B.at_blocks(manifest, reps, send_tokens, B.PACKET), count_tokens, n)
    live = settle(B.at_blocks(manifest, counts, rank, SURVIVOR), f"{root}/survivors")

    def member_rows(block: int, path: str):
        texts, s, sizes = B.Block(path), B.load_state(path, "nodes"), B.load_state(path, "sets")["n"]
        row = (block << B.ROW_BITS) + np.arange(texts.rows)
        yield pa.RecordBatch.from_pydict({"row": row, "doc_id": pa.array(texts.doc_id, mask=texts.null_id), "n_shingles": sizes, "node": pa.array(s["node"], mask=s["node"] < 0), "rep": pa.array(s["rep"], mask=s["rep"] == LAST)})

    return manifest, B.from_blocks(B.spread(spark, manifest), member_rows, "row long, doc_id long, n_shingles long, node long, rep long"), live


def list_entries(live: DataFrame) -> DataFrame:
    """(sig, node, n): the inverted lists of the sets' leading shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, len(rows), 256):
                part = rows.slice(at, 256)
                ranked = [np.frombuffer(x, np.int64) for x in part.column("ranked").to_pylist()]
                ranked = [t[: max(1, len(t) - 1)] for t in ranked]
                sizes = [len(t) for t in ranked]
                yield pa.RecordBatch.from_pydict({"sig": np.concatenate(ranked), "node": np.repeat(np.asarray(part.column("node")), sizes), "n": np.repeat(np.asarray(part.column("n")), sizes)})

    return live.select("node", "n", "ranked").mapInArrow(run, "sig long, node long, n long")


def _subsets(ranked: bytes) -> np.ndarray:
    t = np.frombuffer(ranked, np.uint64)
    i, j = np.triu_indices(len(t), 1)
    return B.mix64(np.minimum(t[i], t[j]) * np.uint64(0x9E3779B97F4A7C15) ^ np.maximum(t[i], t[j])).view(np.int64)


def subset_entries(sets: DataFrame) -> DataFrame:
    """(sig, node, n, comp): the subsets of two of the sets' leading shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for node, n, comp, ranked in zip(*(rows.column(c).to_pylist() for c in ("node", "n", "comp", "ranked")), strict=True):
                sig = _subsets(ranked)
                yield pa.RecordBatch.from_pydict({"sig": sig, "node": np.full(len(sig), node), "n": np.full(len(sig), n), "comp": np.full(len(sig), comp)})

    return sets.select("node", "n", "comp", "ranked").mapInArrow(run, "sig long, node long, n long, comp long")


def size_class(n):
    return F.floor(F.log2(n.cast("double")) * 8).cast("int")


def sketches(entries: DataFrame, expand: bool = False) -> dict[int, np.ndarray]:
    """A sketch of the stream of keys of each size class, from (class, sig) rows, or (class, ranked) rows of which the
    subsets are the keys.  Sketches add up, and the sum of a sketch's squares estimates that of the keys' frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for rows in batches:
            kind = np.asarray(rows.column("class"))
            if expand:
                keys = [_subsets(x) for x in rows.column("ranked").to_pylist()]
                kind, keys = np.repeat(kind, [len(k) for k in keys]), np.concatenate(keys) if keys else np.zeros(0, np.int64)
            else:
                keys = np.asarray(rows.column("sig"))
            h = B.mix64(keys.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
            sign = np.where(h >> np.uint64(63), 1, -1)
            for k in np.unique(kind).tolist():
                on = kind == k
                total[k] = total.get(k, 0) + np.bincount((h[on] & np.uint64(WIDE - 1)).astype(np.int64), sign[on], WIDE)
        if total:
            yield pa.RecordBatch.from_pydict({"class": pa.array(list(total), pa.int32()), "data": [x.astype(np.int64).tobytes() for x in total.values()]})

    def add(t: pa.Table) -> pa.Table:
        data = sum(np.frombuffer(x, np.int64) for x in t.column("data").to_pylist())
        return pa.table({"class": t.column("class").slice(0, 1), "data": [data.tobytes()]})

    # A row for each class and task: a hundred classes hold all sizes up to 2^13 words, and eight more each doubling.
    rows = entries.mapInArrow(run, "class int, data binary").groupBy("class").applyInArrow(add, "class int, data binary").collect()
    return {r["class"]: np.frombuffer(r["data"], np.int64).astype(np.float64) for r in rows}


def light_boundary(lists: DataFrame, sets: DataFrame, percent: int) -> float:
    """Sets under this size are light: the boundary with the least cost for open lists (sig, n) and sets (n, ranked)."""
    lists, sets = lists.select(size_class(F.col("n")).alias("class"), "sig"), sets.select(size_class(F.col("n")).alias("class"), "ranked")
    scan = sketches(lists)
    m = F.length("ranked") / 8
    written = {r["class"]: r["w"] for r in sets.groupBy("class").agg(F.sum(m * (m - 1) / 2).alias("w")).collect()}
    worst, size, classes = float((sum(scan.values()) ** 2).sum()) if scan else 0.0, 0.0, []
    for k in sorted(written):  # past the size where the subsets alone cost more than all lists, none can be light
        size += written[k]
        if size > worst:
            break
        classes.append(k)
    subsets = sketches(sets.where(F.col("class") <= max(classes)), expand=True) if classes else {}
    moment = lambda some: float((sum(some) ** 2).sum()) if some else 0.0
    best, boundary = worst, 0.0
    for k in classes:
        upto = 2 ** ((k + 1) / 8)
        listed = {c: x for c, x in scan.items() if 2 ** ((c + 1) / 8) > upto * percent / 100}  # light ones among them only meet heavy ones
        scanned = moment(list(listed.values())) - moment([x for c, x in listed.items() if c <= k])
        cost = sum(written[c] for c in classes if c <= k) + moment([x for c, x in subsets.items() if c <= k]) + scanned
        if cost < best:
            best, boundary = cost, upto
    return boundary


def verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    sets = live.select("node", "toks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for x, y in zip(rows.column("x"), rows.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                both = int((t[np.searchsorted(t, s).clip(max=len(t) - 1)] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(pa.array(keep, pa.bool_())), rows.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    j = pairs.join(sets.withColumnsRenamed({"node": "a", "toks": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "toks": "y"}), "b")
    return j.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _parted(percent: int) -> tuple:
    """(bins in which two sets differ in parity, whether these allow the similarity); no more shingles than that can differ."""
    apart = " + ".join(f"bit_count(b{k} ^ p{k})" for k in range(WORDS))
    return F.expr(apart), F.expr(f"{100 + percent} * ({apart}) <= {100 - percent} * (n + pn)")


def _bins(live: DataFrame, node: str = "node", name: str = "b") -> DataFrame:
    return live.select(F.col("node").alias(node), *(F.col("bits")[k].alias(f"{name}{k}") for k in range(WORDS)))


def _met_by_pivots(now: DataFrame, live: DataFrame, fits, percent: int, turn: int, named: int, most: int) -> DataFrame:
    """Pairs (a, b) of a set and a pivot of its lists in another component.

    A list names so many pivots, which differ by turn; a set meets those that are nearest by the parities of their bins, or,
    where a list names one only, the one that most of its lists name.
    """
    # Plain longs, so that the aggregate hashes and need not sort: the hash alone orders, and a node's values go with its hash.
    order = [F.xxhash64("node", F.lit(turn), F.lit(k)) for k in range(named)]
    picked = [F.min_by(c, h).alias(f"{c}{k}") for k, h in enumerate(order) for c in ("node", "n", "comp")]
    each = F.array(*(F.struct(F.col(f"node{k}").alias("pivot"), F.col(f"n{k}").alias("pn"), F.col(f"comp{k}").alias("pc")) for k in range(named)))
    star = now.groupBy("sig").agg(*picked).select("sig", F.explode(F.array_distinct(each)).alias("p")).select("sig", "p.pivot", "p.pn", "p.pc")
    if named == 1:
        met = now.join(star, "sig").where((F.col("comp") != F.col("pc")) & fits).groupBy("node", "pivot").agg((-F.count("*")).alias("far"))
    else:
        apart, near = _parted(percent)
        met = now.join(_bins(live), "node").join(star.join(_bins(live, "pivot", "p"), "pivot"), "sig").where((F.col("comp") != F.col("pc")) & fits & near)
        met = met.groupBy("node", "pivot").agg(F.min(apart).alias("far"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("far", "pivot"))), 1, most)  # as many as a set's lists name, at most
    met = met.groupBy("node").agg(best.alias("p")).select("node", F.explode("p.pivot").alias("pivot"))
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _met_in_full(now: DataFrame, live: DataFrame, fits, percent: int, boundary: float | None, root: str) -> DataFrame:
    """All pairs (a, b) of sets of open lists in different components that may be similar."""
    sets = settle(now.select("node", "n", "comp").distinct().join(live.select("node", "ranked", "bits"), "node"), f"{root}/sets")
    edge = light_boundary(now, sets, percent) if boundary is None else boundary
    # Sets that need one shared shingle only have no second one to share.
    light = (F.col("n") < edge) & (F.ceil(F.col("n") * percent / 100) >= 2)
    lists = now.where(F.col("n") >= edge * percent / 100).select("sig", "node", "n", "comp").withColumn("light", light)
    near, pairs = _parted(percent)[1], None
    for entries in (lists, subset_entries(sets.where(light)).withColumn("light", F.lit(False))):
        # A pair meets in the first entry that both sets have, as far as earlier ones are carried; elsewhere it would only be repeated.
        every = entries.groupBy("node", "n", "comp", "light").agg(F.sort_array(F.collect_list("sig")).alias("every"))
        entries = every.select("node", "n", "comp", "light", "every", F.posexplode("every").alias("place", "sig")).withColumn("earlier", F.slice("every", F.lit(1), F.least("place", F.lit(EARLIER)))).drop("every", "place")
        entries = settle(entries.join(entries.groupBy("sig").agg(F.count("*").alias("m"), F.min("light").alias("only")).where("m > 1 AND NOT only").select("sig"), "sig", "left_semi").join(_bins(sets), "node"), f"{root}/met{0 if pairs is None else 1}")
        other = entries.select("sig", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("comp").alias("pc"), F.col("light").alias("pl"), F.col("earlier").alias("pe"), *(F.col(f"b{k}").alias(f"p{k}") for k in range(WORDS)))
        met = entries.join(other, "sig").where((F.col("node") < F.col("pivot")) & (F.col("comp") != F.col("pc")) & ~(F.col("light") & F.col("pl")) & fits & near & ~F.arrays_overlap("earlier", "pe"))
        met = met.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs


def grouped(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, boundary: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, members, named) of (doc_id, text) rows: the blocks; each row with its node; each node with its component."""
    root = workspace(docs.sparkSession, "jaccard")
    manifest, members, live = survivors(docs, root, width, percent)
    sigs = list_entries(live)
    # Only entries that two sets have matter from here on.
    sigs = settle(sigs.join(sigs.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "sig", "left_semi"), f"{root}/entries")
    fits = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")
    tried, label = None, None
    for turn, (named, most) in enumerate((*PIVOTS, (0, 0))):
        now = sigs.withColumn("comp", F.col("node")) if label is None else sigs.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if label is not None:  # lists whose sets are all in one component are done
            open_ = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
            now = settle(now.join(open_, "sig", "left_semi"), f"{root}/open{turn}")
            if now.isEmpty():
                break
        pairs = _met_by_pivots(now, live, fits, percent, turn, named, most) if named else _met_in_full(now, live, fits, percent, boundary, f"{root}/full")
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs, f"{root}/pairs{turn}")
        links = settle(verified(pairs, live, percent), f"{root}/links{turn}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        label = merged(label, links, f"{root}/components{turn}")
    smallest = label.join(live.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("least"))
    named = settle(label.join(smallest, "comp").select("node", "comp", F.nullif("least", F.lit(int(LAST))).alias("least")), f"{root}/named")
    return manifest, members, named


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, boundary: float | None = None) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id.  ``boundary`` is chosen by cost if it isn't given."""
    _, members, named = grouped(id_and_text(docs), width, percent, boundary)
    out = members.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "rep")).alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which each group of similar ones keeps one row.

    That is the row with the smallest doc_id, the first written of those that share it; a null doc_id comes last.
    Groups are of rows: a repeated doc_id does not bring the groups of its rows together.
    """
    manifest, members, named = grouped(B.whole_rows(docs))
    group = F.coalesce("comp", "node", "row").alias("g")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = members.join(named.select("node", "comp"), "node", "left").groupBy(group).agg(first.alias("f")).select("f.row")
    return B.chosen_rows(manifest, kept, docs)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
