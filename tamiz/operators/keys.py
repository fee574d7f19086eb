"""Keys: simple, composite of two columns, or the best imperfect one."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.operators.profile import Column

MEASURES = {"currency", "percentage", "number"}
CHECKS, WIDE = 12, 6


def _rank(c: Column) -> tuple:
    n = c.name.lower()
    named = 2 if re.search(r"(^|_)(id|cod|codigo|key|uuid)(_|$)", n) else 1 if "id" in n or "cod" in n else 0
    return (-named, -(2 if c.integer or c.kind == "identifier" else 0), c.position, c.length[2] or 0)


def pair_ratios(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Distinct pairs by row; each pair is grouped by itself, so no row is copied for the others."""
    if not pairs:
        return {}
    parts = [df.groupBy(df[f"`{a}`"].alias("a"), df[f"`{b}`"].alias("b")).agg(F.count("*").alias("n")).agg(F.lit(i).alias("i"), F.count("*").alias("d"), F.sum("n").alias("n")) for i, (a, b) in enumerate(pairs)]
    rows = {r["i"]: r for r in reduce(DataFrame.unionByName, parts).collect()}
    return {p: rows[i]["d"] / rows[i]["n"] if rows[i]["n"] else 0.0 for i, p in enumerate(pairs)}


def find_key(df: DataFrame, columns: list[Column]) -> dict | None:
    out = lambda names, kind, ratio, nulls, exact: {"sourceId": columns[0].source, "columns": names, "kind": kind, "uniquenessRatio": ratio, "nullCount": nulls, "isExact": exact}
    free = [c for c in columns if c.rows and c.kind not in MEASURES | {"free_text"}]
    if simple := sorted((c for c in free if c.uniqueness == 1 and not c.nulls), key=_rank):
        return out([simple[0].name], "simple", 1.0, 0, True)
    able = sorted((c for c in free if c.distinct > 1 and not c.nulls and c.kind != "datetime" and c.group != "other"), key=lambda c: (-c.uniqueness, c.position))[:WIDE]
    pairs = [(a.name, b.name) for a, b in combinations(able, 2) if a.distinct * b.distinct >= a.rows][:CHECKS]
    ratios = pair_ratios(df, pairs)
    if ratios and (best := max(ratios, key=ratios.get)) and ratios[best] > 0.99:
        return out(list(best), "composite", ratios[best], 0, ratios[best] == 1)
    if rest := sorted((c for c in free if c.uniqueness > 0.5), key=lambda c: (*_rank(c)[:2], -c.uniqueness, c.position)):
        return out([rest[0].name], "simple", rest[0].uniqueness, rest[0].nulls, False)
    return None
