"""Text blocks in the shared folder, and exchanges of fingerprints between blocks and key buckets.

Operators that compare every passage with every other would have to shuffle the texts several times.
Instead the texts are written once, without a shuffle, as *blocks* of some megabytes.  A block then sends
only fingerprints, each to the bucket that owns its value range (packed arrays, distinct within the block,
so that a value that a third of all rows share arrives once per block); the bucket answers with one small
code per fingerprint, in the order it got them.  Blocks and buckets are both bounded in size, and any task
can be run again: files are named by what they hold and replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.shared import column_of, filesystem, get_bytes, numbered, put_bytes, settle

BLOCK_BYTES = 6 << 20
BLOCK_ROWS = 1 << 17
#: A row's number is its block's, then its place in the block in so many bits.
ROW_BITS = 20
MOST_TASKS = 20_000
MANIFEST = "block long, path string, batch int, docs long, bytes long"
PACKET = "bucket long, block long, data binary"


class Block:
    """Texts of one block as one byte array: text i is ``data[start[i]:start[i + 1]]``; null is empty."""

    def __init__(self, path: str):
        t = pa.ipc.open_stream(get_bytes(path)).read_all().combine_chunks()
        self.rows = len(t)
        ids = t.column("doc_id").combine_chunks() if self.rows else pa.array([], pa.int64())
        self.null_id = np.asarray(ids.is_null())
        self.doc_id = np.asarray(ids.fill_null(0))
        text = (t.column("text").combine_chunks() if self.rows else pa.array([], pa.large_binary())).fill_null(b"")
        buffers = text.buffers()
        self.start = np.frombuffer(buffers[1], np.int64, self.rows + 1, text.offset * 8).copy() if self.rows else np.zeros(1, np.int64)
        self.raw = buffers[2].to_pybytes()[self.start[0] : self.start[-1]] if self.rows and buffers[2] else b""
        self.start -= self.start[0]
        self.data = np.frombuffer(self.raw, np.uint8)

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.start[i + 1]]


def write_blocks(docs: DataFrame, root: str, batch_of: str = "0", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write (doc_id, text) rows, and any other column they carry, as blocks; returns the manifest, one row per block.

    ``batch_of`` is a SQL expression over doc_id; a block holds rows of one batch.  Null texts are
    stored as empty.  A text longer than ``block_bytes`` makes a block of its own, and no block has
    more than twice ``BLOCK_ROWS`` rows.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, {}

        def flush(b: int) -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held.pop(b)[1])
            number, made = part << 24 | made, made + 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t.combine_chunks())
            put_bytes(path := f"{root}/blocks/{number}.arrows", sink.getvalue())
            size = int(pa.compute.sum(pa.compute.binary_length(t.column("text"))).as_py() or 0)
            return pa.RecordBatch.from_pydict({"block": [number], "path": [path], "batch": pa.array([b], pa.int32()), "docs": [len(t)], "bytes": [size]})

        for rows in batches:
            text = rows.column("text").cast(pa.large_binary()).fill_null(b"")
            ids, tag = rows.column("doc_id"), np.asarray(rows.column("batch").fill_null(0))
            for b in np.unique(tag).tolist():
                take = np.flatnonzero(tag == b)
                sizes = np.cumsum(np.asarray(pa.compute.binary_length(text.take(pa.array(take)))))
                at = 0
                while at < len(take):
                    size, parts = held.get(b, (0, []))
                    base = sizes[at - 1] if at else 0
                    end = min(max(at + 1, int(np.searchsorted(sizes, base + block_bytes - size, "right"))), at + BLOCK_ROWS)
                    index = pa.array(take[at:end])
                    parts.append(pa.RecordBatch.from_pydict({"doc_id": ids.take(index), "text": text.take(index)} | {c: rows.column(c).take(index) for c in more}))
                    held[b] = (size + int(sizes[end - 1] - base), parts)
                    at = end
                    if held[b][0] >= block_bytes * 0.95 or at < len(take) or sum(map(len, parts)) + len(take) >= BLOCK_ROWS:
                        yield flush(b)
        for b in list(held):
            yield flush(b)

    tagged = docs.select("doc_id", "text", *more, F.expr(batch_of).cast("int").alias("batch"))
    return settle(tagged.mapInArrow(write, MANIFEST), f"{root}/manifest")


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, c0, c1, ...): what an operator reads, and all columns of the table under numbers, the text once."""
    d = numbered(docs)
    text = column_of(docs, "text")
    once = [c for c in d.columns if c != text or d.schema[c].dataType.simpleString() != "string"]
    return d.select(F.col(column_of(docs, "doc_id")).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(text).isNull().alias("bare"), *once)


def chosen_rows(manifest: DataFrame, chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, which was written as blocks of ``whole_rows``, that ``chosen`` (row: block and place) names."""
    text, schema = column_of(docs, "text"), numbered(docs).schema
    names = schema.names

    def run(t: pa.Table) -> pa.Table:
        path = next(x for x in t.column("path").to_pylist() if x is not None)
        rows = pa.array(np.sort(np.asarray(t.column("row").drop_null())) & ((1 << ROW_BITS) - 1))
        block = pa.ipc.open_stream(get_bytes(path)).read_all().take(rows)
        if text not in block.column_names:
            back = pa.compute.if_else(block.column("bare"), pa.scalar(None, pa.large_binary()), block.column("text"))
            block = block.append_column(text, back.cast(pa.string()))
        return block.select(names)

    head = manifest.select("block", F.lit(None).cast("long").alias("row"), "path")
    named = chosen.select(F.shiftright("row", ROW_BITS).alias("block"), "row", F.lit(None).cast("string").alias("path"))
    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return head.unionByName(named).repartition(tasks, "block").groupBy("block").applyInArrow(run, schema).toDF(*docs.columns)


def spread(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The blocks dealt out evenly: a task per block, up to MOST_TASKS; beyond that a task takes several, one after another."""
    n = manifest.count()
    return manifest.select("block", "path").repartition(max(1, min(n, MOST_TASKS)))


def buckets_for(items: float, each: int = 1 << 20) -> int:
    return int(max(8, -(-items // each)))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Value range of each 64-bit key: its upper 32 bits scaled to n buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def packets(block: int, keys: np.ndarray, n: int, pack: Callable[[slice], bytes]) -> pa.RecordBatch:
    """Rows for all buckets, from sorted keys."""
    cut = np.searchsorted(bucket_of(keys, n), np.arange(n + 1, dtype=np.uint64))
    full = [k for k in range(n) if cut[k] < cut[k + 1]]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int64()), "block": pa.array([block] * len(full), pa.int64()), "data": pa.array([pack(slice(cut[k], cut[k + 1])) for k in full], pa.binary())})


def from_blocks(blocks: DataFrame, emit: Callable[[int, str], Iterator[pa.RecordBatch]], schema: str = PACKET) -> DataFrame:
    """Run ``emit(block, path)`` for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block, path in zip(rows.column("block").to_pylist(), rows.column("path").to_pylist(), strict=True):
                yield from emit(block, path)

    return blocks.mapInArrow(run, schema)


def at_buckets(sent: DataFrame, answer: Callable[[int, list[bytes]], list[bytes | None]], n: int) -> DataFrame:
    """Run ``answer(bucket, packets)`` where all packets of a bucket meet; gives one reply per packet (None: no reply)."""

    def run(t: pa.Table) -> pa.Table:
        bucket, block, data = t.column("bucket")[0].as_py(), t.column("block").to_pylist(), t.column("data").to_pylist()
        order = sorted(range(len(block)), key=block.__getitem__)
        replies = answer(bucket, [data[i] for i in order])
        keep = [(block[i], r) for i, r in zip(order, replies, strict=True) if r is not None]
        return pa.table({"bucket": pa.array([bucket] * len(keep), pa.int64()), "block": pa.array([k[0] for k in keep], pa.int64()), "data": pa.array([k[1] for k in keep], pa.binary())})

    # A fixed number of partitions: answers are small, so by their bytes the tasks would be merged into a few.
    return sent.repartition(min(n, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(run, PACKET)


def at_blocks(blocks: DataFrame, replies: DataFrame, then: Callable[[int, str, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Run ``then(block, path, replies by bucket)`` for every block, with or without replies."""
    head = blocks.selectExpr("-1L AS bucket", "block", "encode(path, 'utf-8') AS data")

    def run(t: pa.Table) -> pa.Table:
        got = dict(zip(t.column("bucket").to_pylist(), t.column("data").to_pylist(), strict=True))
        path = got.pop(-1).decode()
        return then(t.column("block")[0].as_py(), path, got)

    tasks = max(1, min(blocks.count(), MOST_TASKS))
    return head.unionByName(replies).repartition(tasks, "block").groupBy("block").applyInArrow(run, schema)


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the buckets' parts of sorted keys begin."""
    return np.searchsorted(bucket_of(keys, n), np.arange(n + 1, dtype=np.uint64))


def bits_at(cut: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
    """Replies of packed bits, put back in the order of the keys that were cut so."""
    out = np.zeros(int(cut[-1]), bool)
    for k, data in got.items():
        out[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=int(cut[k + 1] - cut[k])).view(bool)
    return out


def bits_back(keys: np.ndarray, n: int, got: dict[int, bytes]) -> np.ndarray:
    """Replies of packed bits, put back in the order of the sorted keys."""
    return bits_at(cuts(keys, n), got)


def shared_between(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For arrays of distinct keys: which keys also stand in another array."""
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    return np.split(flag, np.cumsum([len(p) for p in parts])[:-1])


def save_state(path: str, name: str, **arrays: np.ndarray) -> None:
    sink = pa.BufferOutputStream()
    fields = {k: pa.array([v.tobytes()], pa.large_binary()) for k, v in arrays.items()}
    schema = pa.schema([pa.field(k, pa.large_binary(), metadata={"dtype": arrays[k].dtype.str, "shape": ",".join(map(str, arrays[k].shape))}) for k in fields])
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(pa.RecordBatch.from_arrays(list(fields.values()), schema=schema))
    put_bytes(f"{path}.{name}", sink.getvalue())


def load_state(path: str, name: str) -> dict[str, np.ndarray]:
    t = pa.ipc.open_stream(get_bytes(f"{path}.{name}")).read_all()
    out = {}
    for f, c in zip(t.schema, t.columns, strict=True):
        shape = tuple(int(x) for x in f.metadata[b"shape"].decode().split(","))
        out[f.name] = np.frombuffer(c[0].as_buffer(), np.dtype(f.metadata[b"dtype"].decode())).reshape(shape)
    return out


def drop_states(spark: SparkSession, manifest: DataFrame, *names: str) -> None:
    """Remove states that no later step reads; the tables made from them must be written by then."""

    def drop(block: int, path: str) -> Iterator[pa.RecordBatch]:
        for name in names:
            fs, file = filesystem(f"{path}.{name}")
            try:
                fs.delete_file(file)
            except FileNotFoundError:  # an earlier attempt of this task removed it
                pass
        yield pa.RecordBatch.from_pydict({"block": [block]})

    from_blocks(spread(spark, manifest), drop, "block long").agg(F.count("*")).collect()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
