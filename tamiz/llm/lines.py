"""Line deduplication with levelled sorted runs of line hashes.

The lines seen so far are kept in a store: per bucket of the hash range, sorted runs in levels.  Documents come in
batches of ascending doc_id.  A batch sends the distinct line hashes of each block to their buckets; there
they are merge-anti-joined with the bucket's runs (a hit was seen in an earlier batch), new hashes get the
smallest doc_id of the batch as owner, and are added as a run of level 0.  After every ``FANOUT`` runs of a
level they are merged into one run of the next level, so a batch meets at most FANOUT - 1 runs per level.

A run is a folder of its own, named anew whenever a batch or a merge is begun, with a file per bucket and a bitmap of
the buckets that have one: a file that is missing although the bitmap names it is an error, never an empty run.  The driver
makes a batch count by replacing the store's list of runs; until then its runs stand for nothing, and runs that were merged
stay until ``vacuum``, so a task that is late, repeated or run twice reads and writes the same.

Defined cases: a null or empty text is one empty line; a null doc_id counts as larger than any other, and
never owns a line that another document has; rows with the same doc_id are one document; lines whose key
has under ten code points are left alone; a very long text is a block of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm import blocks as B
from tamiz.llm.shared import filesystem, get_bytes, id_and_text, put_bytes, settle, workspace

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FANOUT = 3
BATCHES = 4
LAST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def line_keys(block: B.Block, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a key of enough code points: 128-bit hash (two halves), row, and number of the line in its text."""
    lowered, start = block.raw.translate(LOWER), block.start
    hashes, rows, numbers = [], [], []
    digest = xxhash.xxh3_128_digest
    for i in range(block.rows):
        for k, line in enumerate(lowered[start[i] : start[i + 1]].split(b"\n")):
            if len(line) >= least and len(key := line.strip(SPACE)) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                hashes.append(digest(key))
                rows.append(i)
                numbers.append(k)
    h = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)
    return h[:, 0], h[:, 1], np.array(rows, np.int64), np.array(numbers, np.int64)


def in_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    order = np.argsort(high, kind="stable")
    h = high[order]
    if len(h) and ((h[1:] == h[:-1]) & (low[order[1:]] != low[order[:-1]])).any():
        order = np.lexsort((low, high))
    return order


def distinct(block: B.Block, least: int):
    """Sorted distinct keys of a block with the smallest doc_id, and for each line its key's place."""
    high, low, row, number = line_keys(block, least)
    ids = np.where(block.null_id, LAST, block.doc_id)[row] if len(row) else row
    order = in_order(high, low)
    h, lo = high[order], low[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
    heads = np.flatnonzero(first)
    owner = np.minimum.reduceat(ids[order], heads) if len(heads) else ids
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(first) - 1
    return h[heads], lo[heads], owner, place, row, number, ids


def _seen(runs: list[np.ndarray], h: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Merge of sorted keys with sorted runs of (high, low) pairs."""
    seen = np.zeros(len(h), bool)
    for run in runs:
        at = np.searchsorted(run[:, 0], h)
        alive = np.arange(len(h))
        while len(alive):  # more than one step only where two keys agree in their first 64 bits
            alive = alive[(at[alive] < len(run))]
            alive = alive[run[at[alive], 0] == h[alive]]
            seen[alive[run[at[alive], 1] == lo[alive]]] = True
            at[alive] += 1
    return seen


class LineStore:
    """The runs of the lines seen so far, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """Opens the store in ``root``, or begins one with so many buckets."""
        self.spark, self.root = spark, root
        if buckets is None:
            head = json.loads(get_bytes(f"{root}/store.json").to_pybytes())
            self.buckets, self.batches, self.runs = head["buckets"], head["batches"], [tuple(r) for r in head["runs"]]
        else:
            self.buckets, self.batches, self.runs = buckets, 0, []
            self._commit()

    def _commit(self) -> None:
        put_bytes(f"{self.root}/store.json", json.dumps({"buckets": self.buckets, "batches": self.batches, "runs": self.runs}).encode())

    def _folder(self, level: int) -> str:
        return f"{self.root}/runs/{level}-{uuid.uuid4().hex}"

    def add(self, sent: DataFrame, uri: str) -> DataFrame:
        """Replies to the packets of a batch, written at ``uri``; its new lines become part of the store."""
        folders, mine, n = [f for _, f in self.runs], self._folder(0), self.buckets

        def run(t: pa.Table) -> pa.Table:
            bucket, block, data = t.column("bucket")[0].as_py(), np.asarray(t.column("block")), t.column("data").to_pylist()
            order = np.argsort(block, kind="stable")
            replies = _answer(bucket, [data[i] for i in order.tolist()], folders, mine)
            keep = [(b, r) for b, r in zip(block[order].tolist(), replies, strict=True) if r is not None] + [(-1, b"")]  # -1: this bucket has a file
            return pa.table({"bucket": pa.array([bucket] * len(keep), pa.int64()), "block": pa.array([k[0] for k in keep], pa.int64()), "data": pa.array([k[1] for k in keep], pa.binary())})

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            has = np.zeros(n, bool)
            for rows in batches:
                has[np.asarray(rows.column("bucket"))] = True
            put_bytes(f"{mine}/buckets", np.packbits(has).tobytes())
            yield pa.RecordBatch.from_pydict({"n": [int(has.sum())]})

        out = settle(sent.repartition(min(n, B.MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(run, B.PACKET), uri)
        out.where("block = -1").select("bucket").coalesce(1).mapInArrow(index, "n long").collect()  # a bit per bucket
        self.runs.append((0, mine))
        self.batches += 1
        self._compact()
        self._commit()
        return out.where("block >= 0")

    def _compact(self) -> None:
        """Merge the runs of every level that is full, a task for some buckets each."""
        level = 0
        while len(some := [f for k, f in self.runs if k == level]) >= FANOUT:
            target, n = self._folder(level + 1), self.buckets
            put_bytes(f"{target}/buckets", np.packbits(np.logical_or.reduce([_index(f, n) for f in some])).tobytes())

            def merge(batches: Iterator[pa.RecordBatch], some=some, target=target, n=n) -> Iterator[pa.RecordBatch]:
                has = _index(target, n)
                for rows in batches:
                    for bucket in rows.column(0).to_pylist():
                        if has[bucket]:
                            merge_bucket(some, target, bucket)
                    yield pa.RecordBatch.from_pydict({"n": [len(rows)]})

            self.spark.range(0, n, 1, min(n, B.MOST_TASKS)).mapInArrow(merge, "n long").agg(F.sum("n")).collect()
            self.runs = [r for r in self.runs if r[1] not in some] + [(level + 1, target)]
            level += 1

    def vacuum(self) -> None:
        """Remove the folders of runs that no longer count, when no batch is under way."""
        fs, path = filesystem(f"{self.root}/runs")
        live = {f.rpartition("/")[2] for _, f in self.runs}
        for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if x.base_name not in live:
                fs.delete_dir(x.path)


@lru_cache(64)
def _bitmap(folder: str) -> np.ndarray:
    """A bit per bucket: whether the run has a file for it.  A run's bitmap is written once."""
    return np.frombuffer(get_bytes(f"{folder}/buckets"), np.uint8)


def _index(folder: str, n: int) -> np.ndarray:
    return np.unpackbits(_bitmap(folder), count=n).view(bool)


def load_run(folder: str, bucket: int) -> np.ndarray:
    if not _bitmap(folder)[bucket >> 3] >> (7 - (bucket & 7)) & 1:
        return np.empty((0, 2), np.uint64)
    return np.frombuffer(get_bytes(f"{folder}/{bucket}"), np.uint64).reshape(-1, 2)


def merge_bucket(sources: list[str], target: str, bucket: int) -> None:
    run = np.concatenate([load_run(f, bucket) for f in sources])
    put_bytes(f"{target}/{bucket}", run[in_order(run[:, 0], run[:, 1])].tobytes())


def _answer(bucket: int, sent: list[bytes], folders: list[str], mine: str) -> list[bytes | None]:
    """Bits of the lines to drop, for each packet; the new lines are written as a run of ``mine``."""
    parts = [np.frombuffer(x, np.uint64).reshape(-1, 3) for x in sent]
    rows = np.concatenate(parts)
    order = in_order(rows[:, 0], rows[:, 1])
    h, lo, owner = rows[order, 0], rows[order, 1], rows[order, 2].view(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
    heads = np.flatnonzero(first)
    old = _seen([load_run(f, bucket) for f in folders], h[heads], lo[heads])
    group = np.cumsum(first) - 1
    drop = np.empty(len(h), bool)
    drop[order] = old[group] | (owner > np.minimum.reduceat(owner, heads)[group])
    fresh = heads[~old]
    put_bytes(f"{mine}/{bucket}", np.stack([h[fresh], lo[fresh]], 1).tobytes())
    return [np.packbits(x).tobytes() if x.any() else None for x in np.split(drop, np.cumsum([len(p) for p in parts])[:-1])]


def buckets_for(docs_bytes: int) -> int:
    return B.buckets_for(docs_bytes / 40, 1 << 18)


def _kept(manifest: DataFrame, replies: DataFrame, least: int, n: int) -> DataFrame:
    def keep(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        texts = B.Block(path)
        h, lo, owner, place, row, number, ids = distinct(texts, least)
        drop_key = B.bits_back(h, n, got)
        drop = (ids > owner[place]) | drop_key[place] if len(row) else np.zeros(0, bool)
        gone: dict[int, set[int]] = {}
        for i, k in zip(row[drop].tolist(), number[drop].tolist(), strict=True):
            gone.setdefault(i, set()).add(k)
        n_lines, n_dropped, sha, kept = [], [], [], []
        for i in range(texts.rows):
            lines = texts.text(i).split(b"\n")
            out = b"\n".join(x for k, x in enumerate(lines) if k not in gone[i]) if i in gone else texts.text(i)
            n_lines.append(len(lines))
            n_dropped.append(len(gone.get(i, ())))
            sha.append(hashlib.sha256(out).hexdigest())
            kept.append(out.decode("utf-8", "replace"))
        return pa.table({"doc_id": pa.array(texts.doc_id, mask=texts.null_id), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.string())})

    return B.at_blocks(manifest, replies, keep, RESULT)


def _packets(spark: SparkSession, manifest: DataFrame, least: int, n: int) -> DataFrame:
    def emit(block: int, path: str):
        h, lo, owner, *_ = distinct(B.Block(path), least)
        yield B.packets(block, h, n, lambda s: np.stack([h[s], lo[s], owner[s].view(np.uint64)], 1).tobytes())

    return B.from_blocks(B.spread(spark, manifest), emit)


def add_batch(store: LineStore, docs: DataFrame, least: int = 10) -> DataFrame:
    """One more batch, after all before it: lines that the store has are dropped, the others become part of it.

    Per document: doc_id, n_lines, n_dropped, kept_sha256 and kept_text, as of ``dedup_lines``.
    """
    root = workspace(store.spark, "lines")
    manifest = B.write_blocks(id_and_text(docs), root)
    return _kept(manifest, store.add(_packets(store.spark, manifest, least, store.buckets), f"{root}/replies"), least, store.buckets)


def dedup_lines(docs: DataFrame, least: int = 10, n_batches: int = BATCHES) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 and kept_text."""
    spark, docs = docs.sparkSession, id_and_text(docs)
    root = workspace(spark, "lines")
    cuts = [c for c in (docs.selectExpr(f"percentile_approx(doc_id, array({', '.join(str(k / n_batches) for k in range(1, n_batches))}), 1000) q").first()[0] or [])] if n_batches > 1 else []
    batch_of = "+".join(f"(CASE WHEN doc_id > {c} OR doc_id IS NULL THEN 1 ELSE 0 END)" for c in cuts) or "0"
    manifest = B.write_blocks(docs, root, batch_of)
    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    store, replies = LineStore(spark, f"{root}/store", buckets_for(size)), None
    for batch in range(len(cuts) + 1):
        part = store.add(_packets(spark, manifest.where(F.col("batch") == batch), least, store.buckets), f"{root}/replies/{batch}")
        replies = part if replies is None else replies.unionByName(part)
    store.vacuum()
    return _kept(manifest, replies, least, store.buckets)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


__all__ = ["LineStore", "add_batch", "dedup_lines", "op9_line_dedup"]
