"""Undeclared relationships: candidate columns on metadata, inclusion and coverage for all of them in one join."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.names import name_similarity, token_overlap
from tamiz.functions.text import normalise
from tamiz.operators.profile import Column, form_of
from tamiz.operators.scoring import cardinality, classify, score

CANDIDATES, KEPT = 12, 3
SAID = {"exact": "", "basic": " when case, accents and punctuation are left out", "digits": " when only digits are compared"}
LIMITS = {"exact": [], "basic": ["the spellings differ; write them alike at the source"], "digits": ["only the digits agree; write the codes alike at the source"]}
NUMBER = re.compile(r"^9+(\.9+)?$")


@dataclass
class Candidate:
    id: int
    a: Column
    b: Column
    chain: str
    compat: float


def _shape(c: Column) -> str:
    return c.patterns[0][0] if c.patterns else ""


def chains_for(a: Column, b: Column) -> list[tuple[str, float]]:
    """Normalisations worth trying, with how well the types fit."""
    if a.group == b.group and a.group != "other":
        out = [("exact", 1.0)]
        if a.group == "text":
            out.append(("basic", 1.0))
            if token_overlap(a.name, b.name, True) >= 0.3 and "9" in _shape(a) and "9" in _shape(b):
                out.append(("digits", 0.8))
        return out
    if {a.group, b.group} == {"numeric", "text"}:
        shape = _shape(a if a.group == "text" else b)
        return [("exact", 0.6)] * bool(NUMBER.match(shape)) + [("digits", 0.6)] * (token_overlap(a.name, b.name) >= 0.3 and "9" in shape)
    return []


def candidates(profiles: dict[str, list[Column]]) -> list[Candidate]:
    out: list[Candidate] = []
    able = {s: [c for c in cs if c.distinct > 1 and c.kind not in ("free_text", "boolean_coded")] for s, cs in profiles.items()}
    for s, t in combinations(profiles, 2):
        pairs = []
        for a in able[s]:
            for b in able[t]:
                chains, likeness = chains_for(a, b), name_similarity(a.name, b.name)
                if not chains or (a.group == b.group == "numeric" and (a.low > b.high or b.low > a.high)):
                    continue
                if max(a.uniqueness, b.uniqueness) < 0.9 and likeness < 0.75:
                    continue
                if min(a.distinct, b.distinct) < 20 and token_overlap(a.name, b.name) < 0.4:
                    continue
                pairs.append((likeness, a, b, chains))
        for _, a, b, chains in sorted(pairs, key=lambda p: -p[0])[:CANDIDATES]:
            out += [Candidate(0, a, b, k, w) for k, w in chains]
    for i, c in enumerate(out):
        c.id = i
    return out


def inclusion(freq: DataFrame, wanted: list[tuple[int, str, str, str, str, str]]) -> DataFrame:
    """Per wanted (id, source, column, source, column, chain): id, na, nb, inter, rows_a, covered_a, rows_b, covered_b.

    ``freq`` has (source, column, value, far, cnt).  Values are normalised, not rows; the wanted list is metadata.
    """
    spark = freq.sparkSession
    sides = spark.createDataFrame([(i, side, *(w if side == "a" else v), chain) for i, *rest in wanted for w, v, chain in [((rest[0], rest[1]), (rest[2], rest[3]), rest[4])] for side in "ab"], "id long, side string, source string, column string, chain string")
    norm = F.when(F.col("chain") == "basic", form_of("basic")).when(F.col("chain") == "digits", form_of("digits")).otherwise(F.col("value"))
    rows = freq.join(F.broadcast(sides), ["source", "column"]).select("id", "side", norm.alias("v"), "cnt")
    both = rows.groupBy("id", "v").agg(*(F.sum(F.when(F.col("side") == s, F.col("cnt"))).alias(s) for s in "ab"))
    a, b, ok = F.col("a"), F.col("b"), F.col("v").isNotNull()
    hit = ok & a.isNotNull() & b.isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    worst = F.max_by(F.struct("v", "a", "b"), F.when(hit, F.struct((a * b).alias("p"), F.col("v"))))
    return both.groupBy("id").agg(
        F.count_if(ok & a.isNotNull()).alias("na"), F.count_if(ok & b.isNotNull()).alias("nb"), F.count_if(hit).alias("inter"), zero(F.sum("a")).alias("rows_a"), zero(F.sum(F.when(hit, a))).alias("covered_a"),
        zero(F.sum("b")).alias("rows_b"), zero(F.sum(F.when(hit, b))).alias("covered_b"), zero(F.sum(F.when(hit, a * b))).alias("joined"), worst.alias("worst"),
    )


def orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str, chain: str = "exact") -> DataFrame:
    """Rows of the child whose value, if it has one, is not among the parent's."""
    have = parent.select(normalise(parent[f"`{parent_column}`"], chain).alias("_v")).where("_v IS NOT NULL").distinct()
    rows = child.withColumn("_c", normalise(child[f"`{child_column}`"], chain)).where("_c IS NOT NULL")
    return rows.join(have, F.col("_c") == F.col("_v"), "left_anti").drop("_c")


def discover(freq: DataFrame, profiles: dict[str, list[Column]]) -> list[dict]:
    """Relationships, three per pair of sources at most, best first."""
    found = candidates(profiles)
    if not found:
        return []
    stats = {r["id"]: r for r in inclusion(freq, [(c.id, c.a.source, c.a.name, c.b.source, c.b.name, c.chain) for c in found]).collect()}
    best: dict[tuple, tuple] = {}
    for c in found:
        r = stats.get(c.id)
        if r is None or not (r.na and r.nb and r.inter):
            continue
        parent_is_b = c.b.uniqueness > c.a.uniqueness
        included = r.inter / (r.na if parent_is_b else r.nb)
        at = (c.a.source, c.a.name, c.b.source, c.b.name)
        if at not in best or (best[at][0] < 0.98 and included > best[at][0] + 0.01):
            best[at] = (included, c, r, parent_is_b)
    out: dict[tuple, list[dict]] = {}
    for included, c, r, parent_is_b in best.values():
        child, parent = (c.a, c.b) if parent_is_b else (c.b, c.a)
        rows, covered, n_parent = (r.rows_a, r.covered_a, r.nb) if parent_is_b else (r.rows_b, r.covered_b, r.na)
        coverage = covered / rows if rows else 0.0
        if included < 0.2 or coverage < 0.3:
            continue
        dense = (c.chain == "digits" or (child.integer and parent.integer)) and token_overlap(child.name, parent.name) < 0.3
        s = score(c.compat, name_similarity(child.name, parent.name), coverage, parent.uniqueness, child.null_ratio, c.chain == "exact" and child.group == parent.group == "text" and _shape(child) != _shape(parent), r.inter / n_parent, parent.distinct, dense, parent.uniqueness == 1 and not parent.nulls)
        kind = classify(coverage, s.pop("domain_coincidence"))
        confidence = s["confidence"] if kind != "partial" or s["confidence"] != "high" else "medium"
        text = {"exact": "{}::VARCHAR", "basic": "basic({})", "digits": "digits({})"}[c.chain]
        sql = f'SELECT COUNT(*) FROM "{child.source}" WHERE {text.format(child.name)} IN (SELECT {text.format(parent.name)} FROM "{parent.source}")'
        out.setdefault((c.a.source, c.b.source), []).append({
            "leftSourceId": child.source, "leftColumns": [child.name], "rightSourceId": parent.source, "rightColumns": [parent.name], "status": "inferred", "classification": kind, "cardinality": cardinality(child.uniqueness, parent.uniqueness),
            **s, "confidence": confidence, "inclusion": included, "coverage": coverage, "orphans": rows - covered, "normalizations": [] if c.chain == "exact" else [c.chain], "viaPath": [], "sampleSize": None, "limitations": LIMITS[c.chain],
            "explanation": f"{coverage:.0%} of the rows of {child.source} with a {child.name} find it in {parent.source}.{parent.name}{SAID[c.chain]}.", "userDecision": "pending", "userComment": None, "evidence": [{"label": "coverage", "sql": sql, "result": {"rows": rows, "covered": covered}, "totalRows": rows}],
        })
    kept = [r for group in out.values() for r in sorted(group, key=lambda r: -r["score"])[:KEPT]]
    for i, r in enumerate(kept):
        r["id"] = f"rel_{i + 1}"
    return kept
