"""Benchmark decontamination by training suffix arrays.

Documents are taken in shards of some megabytes, where they stand; nothing is shuffled.  A shard gets a
suffix array over its words, of the suffixes that begin with a word of the benchmark (any other suffix
matches no test suffix) and sorted as deep as the longest test suffix goes.  Every test suffix is binary
searched in it, which gives its longest verbatim match and, for the width of a window, the range of all
places where the window occurs.  Hit words and items are then read off per document.

The test side is read in blocks: items are cut into overlapping pieces of at most ``PIECE`` words, equal ones count once,
and are dealt into groups of about ``GROUP_BYTES``, each built by a task and written as a file in the shared folder, so a
benchmark of any size is built and searched block by block in bounded memory.  A long text is split and coded part by part,
so a shard costs four bytes a word besides its text.

Defined cases: null text has no words; an item without words has no window; an item under ``width`` words is
one window; items with the same id count once; a null item_id marks words but is not counted as an item; equal
rows are treated alike; null doc_id is passed through; a text longer than a shard is a shard of its own; without documents
there are no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.shared import column_of, get_bytes, id_and_text, numbered, put_bytes, settle, workspace

WIDTH = 10
PIECE = 4096
GROUP_BYTES = 8 << 20
SHARD_BYTES = 6 << 20
PART_BYTES = 1 << 20
BREAK = b"\x00"
#: ASCII letters lowered, digits kept, other ASCII blank; bytes of longer characters kept.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCH = "item_id string, item_word long, n_words long, doc_id long, doc_word long"


def words_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(TABLE).split()


class TestSide:
    """Windows and suffixes of one group of benchmark items."""

    def __init__(self, pieces: list[tuple[str | None, int, list[bytes]]], width: int):
        self.ids: dict[bytes, int] = {}
        flat, self.of = [], []  # all words, and for each suffix (item, word in item, window width)
        at, suffix, wide, left = 0, [], [], []
        for item, first, words in pieces:
            flat += [self.ids.setdefault(w, len(self.ids) + 1) for w in words] + [0]
            n = len(words)
            for k in range(max(1, n - width + 1) if n else 0):
                suffix.append(at + k)
                wide.append(min(width, n))
                left.append(n - k)
                self.of.append((item, first + k))
            at += n + 1
        self.ids[BREAK] = -1  # between documents
        self.tok = np.array(flat + [0], np.int32)
        self.suffix, self.wide, self.left = (np.array(x, np.int64) for x in (suffix, wide, left))
        self.least = int(self.wide.min()) if suffix else 0
        self.deepest = int(self.left.max()) if suffix else 0


def pieces_of(bench: DataFrame, width: int) -> DataFrame:
    """(item_id, first, words) pieces; neighbours overlap so that each window is whole in one of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for item, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                words = words_of(text)
                step = PIECE - width + 1
                for a in range(0, max(1, len(words) - width + 1) if words else 0, step):
                    part = b" ".join(words[a : a + PIECE])
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array([item], pa.string()), "first": [a], "words": [part], "size": [len(part)]})

    return bench.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(cut, "item_id string, first long, words binary, size long")


def write_test_side(bench: DataFrame, root: str, width: int) -> list[str]:
    """Files of the benchmark's groups, each built by a task from about GROUP_BYTES of pieces."""
    pieces = settle(pieces_of(bench, width).distinct(), f"{root}/pieces")
    groups = -(-int(pieces.agg(F.sum("size")).first()[0] or 0) // GROUP_BYTES)

    def build(t: pa.Table) -> pa.Table:
        rows = zip(t.column("item_id").to_pylist(), t.column("first").to_pylist(), t.column("words").to_pylist(), strict=True)
        side = TestSide(sorted(((i, a, w.split()) for i, a, w in rows), key=lambda r: (r[0] or "", r[1], r[2])), width)
        put_bytes(path := f"{root}/test/{t.column('g')[0].as_py()}", pickle.dumps(side))
        return pa.table({"path": [path]})

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("item_id", "first", "words"), F.lit(max(1, groups))))
    return sorted(r.path for r in dealt.groupBy("g").applyInArrow(build, "path string").collect())


@lru_cache(2)
def load_test_side(path: str) -> TestSide:
    return pickle.loads(get_bytes(path).to_pybytes())


class Shard:
    """Documents of one shard as numbered words; 0 stands between documents."""

    def __init__(self, doc_ids: list[int | None], texts: list[bytes]):
        self.doc_ids = doc_ids
        self.raw = b" \x00 ".join([*(t.translate(TABLE) for t in texts), b""])

    def coded(self, side: TestSide) -> np.ndarray:
        """The test side's word numbers; 0 for any other word.  Sets start, doc and n_words of the documents."""
        get, at, parts = side.ids.get, 0, []
        while at < len(self.raw):
            end = self.raw.find(b" ", at + PART_BYTES)
            end = len(self.raw) if end < 0 else end
            words = self.raw[at:end].split()
            parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            at = end
        tok = np.concatenate([*parts, np.zeros(1, np.int32)])
        breaks = np.flatnonzero(tok < 0)
        tok[breaks] = 0
        self.start = np.concatenate([[0], breaks + 1])
        self.n_words = np.diff(self.start) - 1
        return tok

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1


def suffix_array(tok: np.ndarray, least: int, deepest: int, n_ids: int) -> np.ndarray:
    """Sorted starts of the runs of coded words that are ``least`` long at least, compared up to a run's end."""
    zero = np.flatnonzero(tok == 0)
    ends = zero[np.searchsorted(zero, np.arange(len(tok)))]
    at = np.flatnonzero((tok > 0) & (ends - np.arange(len(tok)) >= max(1, least)))
    end, bits = ends[at], max(1, int(n_ids).bit_length())
    each = max(1, 63 // bits)

    def key(which: np.ndarray, depth: int) -> np.ndarray:
        k = np.zeros(len(which), np.uint64)
        for j in range(each):
            p = np.minimum(at[which] + depth + j, end[which])
            k = (k << np.uint64(bits)) | tok[p].astype(np.uint64)
        return k

    order = np.argsort(key(np.arange(len(at)), 0), kind="stable")
    k = key(order, 0)
    lo, depth = np.arange(len(order)), each
    tied = np.zeros(len(order), bool)
    if len(order):
        group = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        size = np.bincount(group)
        tied = (size[group] > 1) & (end[order] - at[order] > depth)
    while depth < deepest and tied.any():
        lo = np.flatnonzero(tied)
        some = order[lo]
        k = key(some, depth)
        sub = np.lexsort((k, group[lo]))
        order[lo] = some[sub]
        k = k[sub]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (group[lo][1:] != group[lo][:-1])])
        group_lo = np.cumsum(fresh) - 1
        depth += each
        size = np.bincount(group_lo)
        group[lo] = lo[np.flatnonzero(fresh)][group_lo]
        tied[lo] = (size[group_lo] > 1) & (end[order[lo]] - at[order[lo]] > depth)
    return at[order]


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common run of words of a at i and b at j, up to ``most``."""
    n = np.zeros(len(i), np.int64)
    on = np.arange(len(i))
    while len(on):
        on = on[n[on] < most[on]]
        x = a[i[on] + n[on]]
        on = on[(x == b[j[on] + n[on]]) & (x > 0)]
        n[on] += 1
    return n


def _place(side: TestSide, tok: np.ndarray, sa: np.ndarray, which: np.ndarray, depth: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of test suffixes, compared up to ``depth`` words: first place not below (or above, if ``after``)."""
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(sa), np.int64)
    q = side.suffix[which]
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        n = _common(side.tok, q[open_], tok, sa[mid], depth[open_])
        same = n == depth[open_]
        x, y = side.tok[q[open_] + n], tok[sa[mid] + n]
        right = np.where(same, after, y < x)
        low[open_] = np.where(right, mid + 1, low[open_])
        high[open_] = np.where(right, high[open_], mid)
    return low


def search(side: TestSide, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, and for each test suffix its longest match, where it is, and the place it sorts to."""
    sa = suffix_array(tok, side.least, side.deepest, len(side.ids))
    every = np.arange(len(side.suffix))
    best, where = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    at = _place(side, tok, sa, every, side.left, False)
    for neighbour in (at - 1, at):
        ok = np.flatnonzero((neighbour >= 0) & (neighbour < len(sa)))
        n = _common(side.tok, side.suffix[ok], tok, sa[neighbour[ok]], side.left[ok])
        longer = n > best[ok]
        best[ok[longer]], where[ok[longer]] = n[longer], sa[neighbour[ok[longer]]]
    return sa, best, where, at


def _shards(batches: Iterator[pa.RecordBatch], doc_id: str = "doc_id", text: str = "text") -> Iterator[tuple[Shard, list[pa.RecordBatch]]]:
    """Shards, each with the rows that it is made of."""
    ids, texts, size, held = [], [], 0, []
    for rows in batches:
        first = 0
        for k, (i, t) in enumerate(zip(rows.column(doc_id).to_pylist(), rows.column(text).cast(pa.large_binary()), strict=True)):
            ids.append(i)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= SHARD_BYTES:
                yield Shard(ids, texts), [*held, rows.slice(first, k + 1 - first)]
                ids, texts, size, held, first = [], [], 0, [], k + 1
        if first < len(rows):
            held.append(rows.slice(first))
    if ids:
        yield Shard(ids, texts), held


def hits(shard: Shard, files: list[str]) -> tuple[np.ndarray, list[list[str]]]:
    """(hit words, items) of each document of a shard."""
    no_items = TestSide([], 1)
    tok, found_items = shard.coded(load_test_side(files[0]) if files else no_items), [set() for _ in shard.doc_ids]
    hit = np.zeros(len(tok) + 1, np.int32)
    for file in files:
        side = load_test_side(file)
        tok = tok if file == files[0] else shard.coded(side)
        sa, best, _, _ = search(side, tok)
        found = np.flatnonzero(best >= side.wide) if len(sa) else np.empty(0, np.int64)
        low, high = (_place(side, tok, sa, found, side.wide[found], after) for after in (False, True))
        done: dict[tuple[int, int, int], np.ndarray] = {}  # a short item may have the places of a longer one that it begins
        for k, a, b, wide in zip(found.tolist(), low.tolist(), high.tolist(), side.wide[found].tolist(), strict=True):
            if (a, b, wide) not in done:
                np.add.at(hit, sa[a:b], 1)
                np.add.at(hit, sa[a:b] + wide, -1)
                done[a, b, wide] = np.unique(shard.doc_of(sa[a:b]))
            if (item := side.of[k][0]) is not None:
                for d in done[a, b, wide].tolist():
                    found_items[d].add(item)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
    return inside[shard.start[1:] - 1] - inside[shard.start[:-1]], [sorted(x) for x in found_items]


def contamination(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the item ids."""
    files = write_test_side(bench, workspace(docs.sparkSession, "decontaminate"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _ in _shards(batches):
            n_hit, lists = hits(shard, files)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(shard.doc_ids, pa.int64()), "n_words": shard.n_words, "n_hit": n_hit, "n_items": [len(x) for x in lists], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists],
                "contaminated": n_hit > 0, "items": pa.array(lists, pa.list_(pa.string())),
            })

    return id_and_text(docs).mapInArrow(run, RESULT + ", items array<string>")


def longest_matches(docs: DataFrame, bench: DataFrame, least: int = WIDTH) -> DataFrame:
    """For each test suffix its longest verbatim match in each shard, if ``least`` words or its whole item long."""
    files = write_test_side(bench, workspace(docs.sparkSession, "decontaminate"), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _ in _shards(batches):
            for file in files:
                side = load_test_side(file)
                _, best, where, _ = search(side, shard.coded(side))
                k = np.flatnonzero((best >= side.wide) & (side.wide > 0))
                d = shard.doc_of(where[k])
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([side.of[x][0] for x in k.tolist()], pa.string()), "item_word": pa.array([side.of[x][1] for x in k.tolist()], pa.int64()), "n_words": best[k],
                    "doc_id": pa.array([shard.doc_ids[x] for x in d.tolist()], pa.int64()), "doc_word": where[k] - shard.start[d],
                })

    return id_and_text(docs).mapInArrow(run, MATCH)


def clean_documents(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark; every row is judged by itself."""
    files, d = write_test_side(bench, workspace(docs.sparkSession, "decontaminate"), width), numbered(docs)
    key, text = column_of(docs, "doc_id"), column_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches, key, text):
            clean, at = hits(shard, files)[0] == 0, 0
            for part in rows:
                yield part.filter(pa.array(clean[at : at + len(part)]))
                at += len(part)

    return d.mapInArrow(run, d.schema).toDF(*docs.columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).drop("items")
