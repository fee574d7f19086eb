"""Word and shingle hashes of whole blocks of texts, and connected components over links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import blocks as B
from tamiz.llm.shared import settle

PART_BYTES = 1 << 20
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = B.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_COEFFICIENT = B.mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _powers(base: int, n: int) -> np.ndarray:
    return _table(base, 1 << max(n - 1, 0).bit_length())[:n]


@lru_cache(4)
def _table(base: int, n: int) -> np.ndarray:
    out, have = np.ones(max(n, 1), np.uint64), 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


def _parts(block: B.Block) -> Iterator[tuple[int, int]]:
    """The block's bytes in parts of about PART_BYTES, each from a text's start or a blank on, so that no word is cut."""
    a, n = 0, len(block.data)
    while a < n:
        b = min(n, a + PART_BYTES)
        text = int(block.start[np.searchsorted(block.start, b)])
        while b < text:
            blank = np.flatnonzero(SPACE[block.data[b : min(text, b + PART_BYTES)]])
            if len(blank):
                b += int(blank[0])
                break
            b = min(text, b + PART_BYTES)
        yield a, b
        a = b


def word_hashes(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start byte, end byte) of each word, ASCII letters lowered, parted by ASCII white space."""
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edge = np.zeros(len(block.data) + 1, bool)
    edge[block.start] = True  # a text's first byte
    for a, b in _parts(block):
        data = LOWER[block.data[a:b]]
        blank, first = SPACE[data], edge[a : b + 1]
        start = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | first[:-1]))
        end = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | first[1:])) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
        h = (total[end] - total[start]) * _powers(_INVERSE, len(data) + 1)[start]
        hashes.append(B.mix64(h ^ (end - start).astype(np.uint64)))
        starts.append(start + a)
        ends.append(end + a)
    h, start, end = map(np.concatenate, (hashes, starts, ends))
    return h, np.searchsorted(block.start, start, "right") - 1, start, end


def shingle_hashes(words: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of each run of ``width`` words of a text; a shorter text is one run."""
    m = max(0, len(words) - width + 1)
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h += words[k : k + m] * _COEFFICIENT[k]
    at = np.flatnonzero(text[:m] == text[width - 1 : width - 1 + m]) if m else np.zeros(0, np.int64)
    h = B.mix64(h[at])
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(text)))
    short = np.flatnonzero(size < width)
    if len(short):
        brief = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            on = size[short] > k
            brief[on] += words[first[short[on]] + k] * _COEFFICIENT[width + k]
        h, at = np.concatenate([h, B.mix64(brief ^ size[short].astype(np.uint64))]), np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def shingle_sets(block: B.Block, width: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    words, text, _, _ = word_hashes(block)
    h, at = shingle_hashes(words, text, width)
    cut = np.searchsorted(text[at], np.arange(block.rows + 1))
    return [np.unique(h[cut[i] : cut[i + 1]]) for i in range(block.rows)]


def word_sequences(block: B.Block, width: int = 1) -> list[np.ndarray]:
    """Two hashes of the words of each text in their order, none of a text without words; in place of ``shingle_sets``."""
    words, text, _, _ = word_hashes(block)
    cut = np.searchsorted(text, np.arange(block.rows + 1))
    power = _powers(_BASE, int(np.diff(cut).max(initial=0)))
    place = np.arange(len(words)) - cut[text]
    some = np.flatnonzero(np.diff(cut))
    out = [np.zeros(0, np.uint64)] * block.rows
    if len(some):
        both = [B.mix64(np.add.reduceat(x * power[place], cut[some]) ^ np.diff(cut)[some].astype(np.uint64)) for x in (words, B.mix64(words ^ np.uint64(_INVERSE)))]
        for i, a, b in zip(some.tolist(), *both, strict=True):
            out[i] = np.array([a, b], np.uint64)
    return out


#: Links that one task joins in memory (16 bytes each); more are joined by all.
FEW_LINKS = 1 << 18


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) over links a - b."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = place[: len(a)], place[len(a) :], np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        was = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == was).all():
            return node, node[label]


def components(links: DataFrame, root: str) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the smallest node that it reaches.

    Labels take the smallest label of a neighbour, then that label's own label, until none changes; each
    round is a written table, unless there are few links.
    """
    links = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{root}/component-links")
    if links.count() <= FEW_LINKS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(np.asarray(r.column("a")), np.asarray(r.column("b"))) for r in batches]
            if rows:
                node, comp = joined(*(np.concatenate(x) for x in zip(*rows, strict=True)))
                yield pa.RecordBatch.from_pydict({"node": node, "comp": comp})

        return settle(links.coalesce(1).mapInArrow(run, "node long, comp long"), f"{root}/round0")
    edges = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{root}/edges")
    label = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), f"{root}/round0")
    step = 0
    while True:
        step += 1
        near = edges.join(label.withColumnsRenamed({"node": "b", "comp": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        low = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        label = settle(low.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), f"{root}/round{step}")
        if label.where("was <> comp").isEmpty():
            return label.select("node", "comp")
        label = label.select("node", "comp")


def merged(label: DataFrame | None, links: DataFrame, root: str) -> DataFrame:
    """The components (node, comp) of what was joined before and of new links; only their components are joined again."""
    if label is None:
        return components(links, root)
    of = lambda x: label.select(F.col("node").alias(x), F.col("comp").alias(f"{x}c"))
    both = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    top = components(both.where("a <> b"), root)
    old = label.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return settle(old.unionByName(top.join(label, "node", "left_anti").select("node", "comp")), f"{root}/merged")
