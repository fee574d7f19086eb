"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are counted once; from there on only (row, source, size, hash) rows move.  Per source the documents
are counted by exact size, and a plan says how many of each size to take one time more than the whole
rounds that the target holds:

* whole rounds: ``target // source_size`` copies of every document;
* the remaining budget is first met in proportion, with whole documents of every size, then by the largest
  sizes that fit while it is over ``DP_WORDS``, and at last by a bounded-knapsack dynamic programme over the
  documents still there, which finds the sum nearest to what is left (every sum up to twice the rest is
  weighed, so the end may lie a little above or below the target).  If that misses the target by more than
  the sizes' common divisor forces, the programme gets back part of what was taken before, and at last all of it,
  so that the end is the nearest sum there is (``MOST_WORDS`` bounds the programme's table).

Which documents of a size are taken is decided by a seeded hash of id and text, so reruns agree.  Documents of a
source and size are cut by the leading bits of the hash: whole ranges are taken or left, and only the range on the
boundary is put in order, so no task holds a whole group.

Defined cases: null text has size 0; a null source is a source of its own, after all others; sources are
weighed 1, 2, 3, 1, ... in the order of their code points; documents of size 0 are taken 0 words (and as many
copies as whole rounds); an empty table gives no rows; rows with the same id, or equal rows, are separate documents;
of rows without an id, and of equal ones, the choice follows the order in which they were read; a very long text is
counted in one pass, without a copy of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.shared import column_of, numbered, settle, workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_ROUNDS = 3
DP_WORDS, MOST_WORDS = 1 << 15, 1 << 22
FINE = 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS) -> DataFrame:
    """(source, source_size, target, weight) from (source, source_size): shares by weight, capped at ``most`` times
    the source's size, the excess reshared by weight until no target is above its cap.

    That end is min(cap, level * weight) for one level; sorted by cap / weight, the capped sources come
    first, so the level follows from running sums over the (small) table of sources.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    w = sizes.withColumn("weight", weight)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.select("*", F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"), F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)).alias("capped"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("capped_weight"))
    # a source is capped if the level that holds when all before it are capped lifts it to its cap
    w = w.withColumn("is_capped", (F.col("total") - F.col("capped")) * F.col("weight") > F.lit(most) * F.col("source_size") * (F.col("weights") - F.col("capped_weight")))
    level = w.withColumn("capped", F.coalesce(F.sum(F.when(F.col("is_capped"), F.lit(most) * F.col("source_size"))).over(everything), F.lit(0))).withColumn("capped_weight", F.coalesce(F.sum(F.when(F.col("is_capped"), F.col("weight"))).over(everything), F.lit(0)))
    target = F.when(F.col("is_capped"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise((F.col("total") - F.col("capped")).cast("double") * F.col("weight") / (F.col("weights") - F.col("capped_weight")))
    return level.select("source", "source_size", target.alias("target"), "weight")


def nearest_subset(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size (at most its count) to take for the sum nearest to ``budget``; bounded knapsack.

    A size's count is split into parts of 1, 2, 4, ...  Bit s of ``reach`` says whether the parts so far can make the
    sum s, up to twice the budget.  Only every ``step``-th state is kept; the others are made again on the way back.
    """
    limit, mask = 2 * budget, (1 << (2 * budget + 1)) - 1
    parts = []
    for i, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        count, take = min(count, limit // size if size else 0), 1
        while count > 0:
            parts.append((i, min(take, count)))
            count, take = count - min(take, count), take * 2
    step = max(1, int(len(parts) ** 0.5))
    with_part = lambda reach, part: (reach | (reach << (part[1] * sizes[part[0]]))) & mask
    reach, kept, used = 1, [], 0
    for k, part in enumerate(parts):
        if k % step == 0:
            kept.append(reach)
        reach, used = with_part(reach, part), k + 1
        if reach >> budget & 1:
            break
    low, high = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1, reach >> budget
    up = (high & -high).bit_length() - 1 if high else limit
    total = low if budget - low <= up else budget + up
    out = [0] * len(sizes)
    for first in range((used - 1) // step * step if used else -1, -1, -step):
        states = [kept[first // step]]
        for part in parts[first : min(first + step, used)]:
            states.append(with_part(states[-1], part))
        for (i, take), before in zip(reversed(parts[first : min(first + step, used)]), reversed(states[:-1]), strict=True):
            if not before >> total & 1:
                out[i] += take
                total -= take * sizes[i]
    return out


def _fit(sizes: np.ndarray, counts: np.ndarray, taken: np.ndarray, left: int, window: int) -> np.ndarray:
    """``taken`` and what fills the rest: the largest that fit while it is over the window, then the programme."""
    taken = taken.copy()
    for k in np.argsort(-sizes, kind="stable").tolist():
        if left <= window:
            break
        if sizes[k]:
            more = min(int(counts[k] - taken[k]), (left - window // 2) // int(sizes[k]))
            if more > 0:
                taken[k] += more
                left -= more * int(sizes[k])
    spare = counts - taken
    if left > window:
        # All sizes still there are over left - window / 2, so any two are more than left: none, one, or the two smallest.
        able = np.flatnonzero((sizes > 0) & (spare > 0))
        able = able[np.argsort(sizes[able], kind="stable")].tolist()
        two = [k for k in able[:2] for _ in range(min(2, int(spare[k])))][:2]
        best = min([[], *([k] for k in able), two], key=lambda ks: abs(left - sum(int(sizes[k]) for k in ks)))
        for k in best:
            taken[k] += 1
    elif left > 0:
        able = np.flatnonzero((sizes > 0) & (spare > 0) & (sizes <= 2 * left))
        able = able[np.argsort(sizes[able], kind="stable")]
        if len(able):
            taken[able] += np.array(nearest_subset(sizes[able].tolist(), spare[able].tolist(), left), np.int64)
    return taken


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to about ``budget``."""
    budget, total = int(budget + 0.5), int((sizes * counts).sum())
    share = min(1.0, budget / total) if total else 0.0
    level = np.floor(counts * share).astype(np.int64)
    divisor = int(np.gcd.reduce(sizes[(sizes > 0) & (counts > 0)])) if total else 1
    forced = min(budget % max(1, divisor), -budget % max(1, divisor))
    miss = lambda t: abs(budget - int((sizes * t).sum()))
    best = None
    for back in (0, 4, 64, None):
        taken = np.zeros_like(level) if back is None else np.maximum(level - back, 0)
        left = budget - int((sizes * taken).sum())
        now = _fit(sizes, counts, taken, left, min(left, MOST_WORDS) if back != 0 else DP_WORDS)
        best = now if best is None or miss(now) < miss(best) else best
        if miss(best) <= forced or budget >= total:
            break
    return best


def _plan(t: pa.Table) -> pa.Table:
    sizes, counts = (np.asarray(t.column(c).combine_chunks()) for c in ("size", "n"))
    order = np.argsort(sizes, kind="stable")
    source_size, target = t.column("source_size")[0].as_py(), t.column("target")[0].as_py()
    rounds = int(target // source_size) if source_size else 0
    rest = target - rounds * source_size
    extra = np.zeros(len(sizes), np.int64)
    extra[order] = fit_budget(sizes[order], counts[order], rest) if rest >= 0.5 else 0
    return pa.table({"source": t.column("source"), "size": sizes, "source_size": t.column("source_size"), "target": t.column("target"), "rounds": np.full(len(sizes), rounds), "extra": extra})


def mixture(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_ROUNDS, row: str | None = None) -> DataFrame:
    """Per document row: row number, doc_id, source, size, source_size, target, copies and taken (= copies * size).

    ``row`` names a column of unique numbers; rows are numbered as they are read where there is none.
    """
    root = workspace(docs.sparkSession, "mixing")
    doc_id, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(number.alias("row"), doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("row")), "text")).drop("text")
    rows = settle(rows.withColumn("slot", F.shiftrightunsigned("h", 64 - FINE)), f"{root}/sizes")
    slots = settle(rows.groupBy("source", "size", "slot").agg(F.count("*").alias("m")), f"{root}/slots")
    counts = settle(slots.groupBy("source", "size").agg(F.sum("m").alias("n")), f"{root}/counts")
    targets = settle(source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most).drop("weight"), f"{root}/targets")
    planned = counts.join(targets, counts.source.eqNullSafe(targets.source)).select(counts.source, "size", "n", "source_size", "target")
    plan = planned.groupBy("source").applyInArrow(_plan, "source string, size long, source_size long, target double, rounds long, extra long")
    plan = settle(plan, f"{root}/plan").withColumnsRenamed({"source": "_s", "size": "_z"})
    # Of a size's slots the first are taken one time more, up to the one where the plan's number ends.
    run = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("m").over(run), F.lit(0)))
    slots = slots.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    slots = slots.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("slot").alias("_k"), "m", "source_size", "target", "rounds", (F.col("extra") - F.col("before")).alias("room"))
    j = rows.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("slot") == F.col("_k"))).drop("_s", "_z", "_k")
    j = settle(j, f"{root}/rows")
    edge = (F.col("room") > 0) & (F.col("room") < F.col("m"))
    place = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("h", "row"))
    named = ["row", "doc_id", "source", "size", "source_size", "target"]
    copies = lambda more: (F.col("rounds") + more.cast("int")).cast("long").alias("copies")
    out = j.where(~edge).select(*named, copies(F.col("room") >= F.col("m"))).unionByName(j.where(edge).withColumn("place", place).select(*named, copies(F.col("place") <= F.col("room"))))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, with all their columns; a document taken twice is there twice."""
    d = settle(numbered(docs).withColumn("row", F.monotonically_increasing_id()), f"{workspace(docs.sparkSession, 'mixed')}/documents")
    own = d.select("row", *(F.col(column_of(docs, c)).alias(c) for c in ("doc_id", "text", "source")))
    mix = mixture(own, seed, row="row").where("copies > 0").select(F.col("row").alias("taken_row"), "copies")
    both = d.join(mix, F.col("row") == F.col("taken_row"))
    return both.select(*(c for c in d.columns if c != "row"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy").toDF(*docs.columns)


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


__all__ = ["fit_budget", "mixed_documents", "mixture", "nearest_subset", "op10_source_mix", "source_targets"]
