"""Bridge tables: lists packed in a column, and entities repeated by a many-to-many relation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.operators.profile import Column

SEPARATORS = (",", ";", "|")
LIST_SHARE, LIST_LENGTH, ATTRIBUTES = 0.15, 80, 8


def list_share(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Share of non-null cells that hold a separator, all columns in one pass."""
    if not columns:
        return {}
    at = [(c, s) for c in columns for s in SEPARATORS]
    r = df.agg(*(F.avg(df[f"`{c}`"].contains(s).cast("double")).alias(f"x{i}") for i, (c, s) in enumerate(at))).first()
    return {k: r[f"x{i}"] or 0.0 for i, k in enumerate(at)}


def explode_list(df: DataFrame, key: str, column: str, separator: str) -> DataFrame:
    """Distinct (key, item)."""
    cells = df.select(df[f"`{key}`"].alias(key), F.explode(F.split(df[f"`{column}`"], re.escape(separator))).alias("item"))
    return cells.select(f"`{key}`", F.trim("item").alias("item")).where("item <> ''").distinct()


def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(f"`{a}`", f"`{b}`").dropna().distinct()


def degree(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.avg("n").alias("avg_degree"), F.max("n").alias("max_degree"))


def determines(df: DataFrame, tests: list[tuple[str, str]]) -> dict[tuple[str, str], bool]:
    """Which x decide their y (a null y counts as empty, a null x not at all).

    One grouping per x, with map-side partial results, serves all its y: x decides y if the least and the greatest
    128-bit hash of y agree in every group.
    """
    if not tests:
        return {}
    parts, ys = [], {}
    for a, b in tests:
        ys.setdefault(a, []).append(b)
    for i, (a, bs) in enumerate(ys.items()):
        y = [F.coalesce(df[f"`{b}`"].cast("string"), F.lit("")) for b in bs]
        edge = [f(h).alias(f"{n}{k}{s}") for k, c in enumerate(y) for s, h in enumerate((F.xxhash64(c), F.xxhash64(F.lit(1), c))) for n, f in (("lo", F.min), ("hi", F.max))]
        one = df.where(df[f"`{a}`"].isNotNull()).groupBy(df[f"`{a}`"]).agg(*edge)
        apart = [F.count_if((F.col(f"lo{k}0") != F.col(f"hi{k}0")) | (F.col(f"lo{k}1") != F.col(f"hi{k}1"))) for k in range(len(bs))]
        parts.append(one.agg(F.lit(i).alias("i"), F.array(*apart).alias("apart")))
    got = {r["i"]: r["apart"] for r in reduce(DataFrame.unionByName, parts).collect()}
    return {(a, b): got[i][k] == 0 for i, (a, bs) in enumerate(ys.items()) for k, b in enumerate(bs)}


def _metrics(bridge: DataFrame, a: str, b: str) -> dict:
    r = bridge.agg(F.count("*").alias("rows"), F.count_distinct(a).alias("da"), F.count_distinct(b).alias("db")).first()
    left, right = degree(bridge, a).first(), degree(bridge, b).first()
    return {"rows": r.rows, "distinctLeft": r.da, "distinctRight": r.db, "orphansLeft": 0, "orphansRight": 0, "avgDegreeLeft": left.avg_degree, "avgDegreeRight": right.avg_degree, "maxDegreeLeft": left.max_degree, "maxDegreeRight": right.max_degree}


def _proposal(kind: str, source: str, a: str, b: str, sql: str, df: DataFrame, **more) -> dict:
    name = f"bridge_{source}_{b}"
    ddl = f'CREATE TABLE {name} ("{a}" VARCHAR, "{b}" VARCHAR, PRIMARY KEY ("{a}", "{b}"))'
    m = _metrics(df, *df.columns)
    return {"kind": kind, "resolution": "association", "proposedTableName": name, "ddl": ddl, "populateSql": sql, "sourceIds": [source], "meaning": None, "resultMetrics": m, "evidence": [{"label": kind, "sql": sql, "result": m}], **more}


def find_bridges(source: str, df: DataFrame, columns: list[Column], key: dict | None) -> list[dict]:
    out = []
    lists = [c.name for c in columns if c.group == "text" and not c.personal and (c.length[2] or 0) <= LIST_LENGTH]
    share = list_share(df, lists)
    own = key["columns"][0] if key and key["kind"] == "simple" and key["isExact"] else columns[0].name
    for c in lists:
        sep = next((s for s in SEPARATORS if share[c, s] >= LIST_SHARE), None)
        if sep and c != own:
            sql = f"SELECT DISTINCT \"{own}\", trim(item) AS item FROM \"{source}\", UNNEST(string_split(\"{c}\", '{sep}')) AS t(item)"
            out.append(_proposal("embedded_list", source, own, "item", sql, explode_list(df, own, c, sep), column=c, separator=sep))
    if key and key["kind"] == "composite" and key["isExact"]:
        a, b = key["columns"]
        by = {c.name: c for c in columns}
        rest = [c.name for c in columns if c.name not in key["columns"]][:ATTRIBUTES]
        dep = determines(df, [(k, x) for k in (a, b) if by[k].distinct > 1 for x in rest if by[x].distinct > 1])
        if any(dep.get((a, x), False) != dep.get((b, x), False) for x in rest):
            out.append(_proposal("n_m", source, a, b, f'SELECT DISTINCT "{a}", "{b}" FROM "{source}"', pairs(df, a, b), columns=[a, b]))
    return out
