"""Exact substring deduplication: blockwise suffix sorting with a difference cover.

A byte goes if a string of ``least`` bytes that covers it also starts elsewhere.  Suffixes are told apart
only up to ``least`` bytes, and are sorted one bucket of leading fingerprints at a time, so that no task
holds more than one block of text or one bucket of suffixes:

1. Cover samples.  Positions whose offset in their document is in a perfect difference set D modulo v are
   samples.  For any two positions i, j there is d < v such that i + d and j + d are both samples, and
   those share at least ``m - v + 1`` bytes if the suffixes at i and j share m.  Sorting the samples' prefixes of
   that length for m of three quarters of ``least``, bucket by bucket, gives their ranks; a suffix without a repeated
   sample among its first v positions is unique and takes no further part.  The samples tied here also tell the
   shorter repeats: ``longest_tie`` is the longest stretch of a document that they cover, at least what their prefixes
   are long; no repeat of m bytes or more is without one.  Nothing is removed for it.
2. Long ties.  Sample suffixes are ranked again at depth ``least + v - 1`` (or to the end of the document).
   Where that prefix repeats, the v suffixes behind the sample are repeated too: long copies are resolved
   by their samples' ranks, however many there are.  One copy of each class stays in as its representative.
3. Buckets.  The suffixes left (edges of copies, representatives) are sorted by their ``least`` bytes, one
   bucket at a time; equal neighbours are repeats.

Order inside a bucket is that of 64-bit fingerprints of the prefixes, which have the same ties as the bytes.

Defined cases: null text is empty; matches never cross documents; a document under ``least`` bytes loses
nothing; equal rows are different documents; a very long text is a block of its own (some 30 bytes of memory a byte); null
doc_id is passed through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import blocks as B
from tamiz.llm.shared import id_and_text, workspace

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_tie long, spans array<struct<start: long, end: long>>"


@lru_cache
def difference_cover(at_most: int) -> tuple[int, tuple[int, ...]]:
    """Singer's perfect difference set: (v, D), v = q * q + q + 1 <= at_most for the largest prime q."""
    for q in range(int(at_most**0.5), 1, -1):
        v = q * q + q + 1
        if v > at_most or any(q % p == 0 for p in range(2, q)):
            continue
        for a in range(q):
            for b in range(q):
                for c in range(1, q):
                    x, found = (1, 0, 0), []  # powers of t in GF(q)[t] / (t^3 - a t^2 - b t - c)
                    for k in range(v):
                        if x[2] == 0:
                            found.append(k)
                        x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                    if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
                        return v, tuple(found)
    return 1, (0,)


def prints(data: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """64-bit fingerprints of ``data[i:i + length]``; all lengths are at least 8."""
    words = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    h = np.empty(len(at), np.uint64)
    for s in range(0, len(at), 1 << 18):
        i = at[s : s + (1 << 18)]
        n = length if isinstance(length, int) else length[s : s + (1 << 18)]
        x = np.full(len(i), 0x9E3779B97F4A7C15, np.uint64) ^ np.asarray(n).astype(np.uint64)
        for k in range(0, int(np.max(n)) - 7 if len(i) else 0, 8):
            if isinstance(n, int):
                x = (x ^ words[i + k]) * np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
            else:
                on = np.flatnonzero(n >= k + 8)
                y = (x[on] ^ words[i[on] + k]) * np.uint64(0xD6E8FEB86659FD93)
                x[on] = y ^ (y >> np.uint64(32))
        if len(i):
            x = (x ^ words[i + n - 8]) * np.uint64(0xD6E8FEB86659FD93)
        h[s : s + (1 << 18)] = B.mix64(x)
    return h


def cover_mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in [start, end) of any interval."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


class Suffixes:
    """The samples and document ends of one block."""

    def __init__(self, path: str, least: int):
        self.v, cover = difference_cover(max(1, least // 3))
        self.block, self.least = B.Block(path), least
        self.prefix, self.deep = least * 3 // 4 - self.v + 1, least + self.v - 1
        start = self.block.start
        size = np.diff(start)
        turns = -(-size // self.v)  # of the cover, for each text
        first = np.repeat(start[:-1], turns) + self.v * (np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns))
        at = (first[:, None] + np.array(cover)).ravel()
        end = np.repeat(np.repeat(start[1:], turns), len(cover))
        fits = at + self.prefix <= end
        self.at, self.end = at[fits], end[fits]
        self.first = np.repeat(np.repeat(start[:-1], turns), len(cover))[fits]

    def ranked(self, at: np.ndarray, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct fingerprints in order, each position's place among them, and how many share each."""
        return np.unique(prints(self.block.data, at, length), return_inverse=True, return_counts=True)


def repeated_spans(docs: DataFrame, least: int = 400) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_tie and the removed spans."""
    spark, docs = docs.sparkSession, id_and_text(docs)
    root = workspace(spark, "suffixes")
    manifest = B.write_blocks(docs, root)
    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n = B.buckets_for(size / 12, 1 << 20)

    def reply(parts: list[np.ndarray]) -> list[bytes | None]:
        return [np.packbits(x).tobytes() if x.any() else None for x in B.shared_between(parts)]

    def send_samples(block: int, path: str):
        s = Suffixes(path, least)
        keys = np.unique(prints(s.block.data, s.at, s.prefix))
        yield B.packets(block, keys, n, lambda k: keys[k].astype(np.uint32).tobytes() + (keys[k] >> np.uint64(32)).astype(np.uint8).tobytes())

    def rank_samples(bucket: int, sent: list[bytes]) -> list[bytes | None]:
        sizes = [len(x) // 5 for x in sent]  # 40 bits beside those that chose the bucket
        return reply([np.frombuffer(x, np.uint32, m) | np.frombuffer(x, np.uint8, m, 4 * m).astype(np.uint64) << np.uint64(32) for x, m in zip(sent, sizes, strict=True)])

    def deep_samples(s: Suffixes, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the repeated samples those to rank at depth, with their lengths."""
        length = np.minimum(s.end[hit] - s.at[hit], s.deep)
        able = length >= least
        on = np.searchsorted(s.at[hit], s.at[hit] + s.v).clip(max=max(0, len(hit) - 1))
        able &= (s.at[hit][on] == s.at[hit] + s.v) | (length < s.v + s.prefix) if len(hit) else able
        return hit[able], length[able]

    def send_deep(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        s = Suffixes(path, least)
        keys, place, count = s.ranked(s.at, s.prefix)
        hit = np.flatnonzero((B.bits_back(keys, n, got) | (count > 1))[place])
        B.save_state(path, "samples", hit=hit.astype(np.uint32))
        deep, length = deep_samples(s, hit)
        keys = np.unique(prints(s.block.data, s.at[deep], length))
        return pa.Table.from_batches([B.packets(block, keys, n, lambda k: keys[k].tobytes())])

    def rank_deep(bucket: int, sent: list[bytes]) -> list[bytes | None]:
        """Bits of what repeats, then bits of what this block, as the first that has it, represents."""
        parts = [np.frombuffer(x, np.uint64) for x in sent]
        shared = B.shared_between(parts)
        seen, heads = np.unique(np.concatenate(parts), return_index=True)
        head = np.zeros(sum(map(len, parts)), bool)
        head[heads] = True
        own = np.split(head, np.cumsum([len(p) for p in parts])[:-1])
        return [(np.packbits(a).tobytes() + np.packbits(b).tobytes()) if a.any() else None for a, b in zip(shared, own, strict=True)]

    def open_suffixes(s: Suffixes, path: str, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(mask of suffixes known to repeat, positions of the suffixes to sort)."""
        hit = B.load_state(path, "samples")["hit"].astype(np.int64)
        total = len(s.block.data)
        deep, length = deep_samples(s, hit)
        keys, place, count = s.ranked(s.at[deep], length)
        shared = B.bits_back(keys, n, {k: x[: len(x) // 2] for k, x in got.items()})
        heads = B.bits_back(keys, n, {k: x[len(x) // 2 :] for k, x in got.items()}) | ~shared
        first = np.zeros(len(deep), bool)
        first[np.unique(place, return_index=True)[1]] = True  # in the block the first occurrence represents
        tied = (shared | (count > 1))[place]
        behind = s.at[deep] + length - least + 1
        known = cover_mask(total, s.at[deep][tied], behind[tied])
        speaks = tied & first & heads[place]
        spoken = cover_mask(total, s.at[deep][speaks], behind[speaks])
        room = cover_mask(total, s.block.start[:-1], np.maximum(s.block.start[:-1], s.block.start[1:] - least + 1)) if s.block.rows else known
        near = cover_mask(total, np.maximum(s.at[hit] - s.v + 1, s.first[hit]), s.at[hit] + 1)
        return known & room, np.flatnonzero(room & ((near & ~known) | spoken))

    def send_suffixes(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        s = Suffixes(path, least)
        known, left = open_suffixes(s, path, got)
        tied = cover_mask(len(s.block.data), s.at[hit := B.load_state(path, "samples")["hit"].astype(np.int64)], s.at[hit] + s.prefix)
        open_ = np.zeros(len(known), bool)
        open_[left] = True
        B.save_state(path, "known", known=np.packbits(known), left=np.packbits(open_), tied=np.packbits(tied))
        keys = np.unique(prints(s.block.data, left, least))
        return pa.Table.from_batches([B.packets(block, keys, n, lambda k: keys[k].tobytes())])

    def sort_suffixes(bucket: int, sent: list[bytes]) -> list[bytes | None]:
        return reply([np.frombuffer(x, np.uint64) for x in sent])

    def cut(block: int, path: str, got: dict[int, bytes]) -> pa.Table:
        texts, state = B.Block(path), B.load_state(path, "known")
        total = len(texts.data)
        left = np.flatnonzero(np.unpackbits(state["left"], count=total))
        again = np.unpackbits(state["known"], count=total).view(bool)
        keys, place, count = np.unique(prints(texts.data, left, least), return_inverse=True, return_counts=True)
        again[left[(B.bits_back(keys, n, got) | (count > 1))[place]]] = True
        starts = np.flatnonzero(again)
        gone = cover_mask(total, starts, starts + least)
        edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
        rows = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "spans", "longest_tie")}
        rises, falls = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        edge = np.diff(np.unpackbits(state["tied"], count=total).view(np.int8), prepend=0, append=0)
        tie_from, tie_to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for i in range(texts.rows):
            a, b = int(texts.start[i]), int(texts.start[i + 1])
            lo, hi = np.searchsorted(falls, a, "right"), np.searchsorted(rises, b, "left")
            spans = [(max(x, a) - a, min(y, b) - a) for x, y in zip(rises[lo:hi].tolist(), falls[lo:hi].tolist(), strict=True)]
            lo, hi = np.searchsorted(tie_to, a, "right"), np.searchsorted(tie_from, b, "left")
            rows["longest_tie"].append(int((np.minimum(tie_to[lo:hi], b) - np.maximum(tie_from[lo:hi], a)).max(initial=0)))
            rows["n_removed"].append(sum(y - x for x, y in spans))
            rows["n_spans"].append(len(spans))
            rows["kept_sha256"].append(hashlib.sha256(texts.data[a:b][~gone[a:b]].tobytes() if spans else texts.text(i)).hexdigest())
            rows["spans"].append([{"start": x, "end": y} for x, y in spans])
        return pa.table({
            "doc_id": pa.array(texts.doc_id, mask=texts.null_id), "n_bytes": pa.array(np.diff(texts.start)), "n_removed": pa.array(rows["n_removed"], pa.int64()), "n_spans": pa.array(rows["n_spans"], pa.int64()),
            "kept_sha256": pa.array(rows["kept_sha256"], pa.string()), "longest_tie": pa.array(rows["longest_tie"], pa.int64()), "spans": pa.array(rows["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    blocks = B.spread(spark, manifest)
    ranks = B.at_buckets(B.from_blocks(blocks, send_samples), rank_samples, n)
    ties = B.at_buckets(B.at_blocks(manifest, ranks, send_deep, B.PACKET), rank_deep, n)
    repeats = B.at_buckets(B.at_blocks(manifest, ties, send_suffixes, B.PACKET), sort_suffixes, n)
    return B.at_blocks(manifest, repeats, cut, RESULT)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
