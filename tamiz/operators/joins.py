"""What a join would give, predicted from value frequencies; indicators; execution; indirect routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.names import name_similarity
from tamiz.functions.text import csv_safe, mask_value, normalise
from tamiz.operators.profile import Column, group_of
from tamiz.operators.relationships import inclusion

PREDICTED, DATE_PROBES, INDICATORS = 8, 2, 6


def arithmetic(r, rows_left: int, rows_right: int) -> dict | None:
    """Expected rows of inner, left and full joins, match rates and fan-out; None if nothing matches."""
    if not r["joined"]:
        return None
    inner, lost_l, lost_r = r["joined"], rows_left - r["covered_a"], rows_right - r["covered_b"]
    times = round(inner / rows_left, 1)
    return {"inner": inner, "left": inner + lost_l, "full": inner + lost_l + lost_r, "matchLeft": r["covered_a"] / rows_left, "matchRight": r["covered_b"] / rows_right, "unmatchedLeft": lost_l, "unmatchedRight": lost_r, "multiplier": times, "risk": times > 3 and inner > max(rows_left, rows_right)}


def mostly_null(right: list[Column], key: str, match_left: float) -> list[str]:
    return [c.name for c in right if c.name != key and 1 - match_left * (1 - c.null_ratio) > 0.6][:6]


def indicators(left: list[Column], right: list[Column], keys: tuple[str, str], match: float) -> list[dict]:
    out = []
    for metric_side, dim_side in ((left, right), (right, left)):
        metrics = [c for c in metric_side if c.kind in ("currency", "number", "integer", "percentage") and not c.personal and c.name not in keys][:3]
        dims = [c for c in dim_side if c.kind in ("category", "geo_admin", "boolean_coded") and 3 <= c.distinct <= 50 and not c.personal][:3]
        time = next((c for c in [*metric_side, *dim_side] if c.kind in ("date", "datetime") and not c.risks), None)
        for m in metrics:
            for d in dims:
                if (cover := match * (1 - m.null_ratio)) >= 0.1:
                    bucket = f", date_trunc('quarter', \"{time.name}\"::DATE) AS quarter" if time else ""
                    sql = f'SELECT "{d.name}"{bucket}, SUM("{m.name}") AS total, COUNT(*) AS n FROM "{left[0].source}" l JOIN "{right[0].source}" r ON l."{keys[0]}" = r."{keys[1]}" GROUP BY ALL ORDER BY total DESC'
                    out.append({"title": f"{m.name} by {d.name}", "metricColumn": m.name, "dimensionColumn": d.name, "timeColumn": time and time.name, "coverage": cover, "sql": sql})
    return sorted(out, key=lambda x: (-x["coverage"], x["timeColumn"] is None))[:INDICATORS]


def run_indicator(left: DataFrame, right: DataFrame, keys: tuple[str, str], metric: str, dimension: str, time: str | None = None) -> DataFrame:
    j = left.join(right, left[keys[0]] == right[keys[1]])
    by = [F.col(dimension)] + ([F.to_date(F.date_trunc("quarter", F.col(time))).alias("quarter")] if time else [])
    return j.groupBy(*by).agg(F.sum(metric).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"))


def predict(freq: DataFrame, profiles: dict[str, list[Column]], relationships: list[dict]) -> list[dict]:
    usable = sorted((r for r in relationships if r["confidence"] != "low" and r["userDecision"] != "rejected" and r["classification"] != "domain_coincidence"), key=lambda r: -r["score"])[:PREDICTED]
    jobs = [(r["leftSourceId"], r["leftColumns"][0], r["rightSourceId"], r["rightColumns"][0], (r["normalizations"] or ["exact"])[0], r["id"]) for r in usable]
    taken = {frozenset((j[:2], j[2:4])) for j in jobs}
    dates = [c for cs in profiles.values() for c in cs if c.kind in ("date", "datetime")]
    probes = [(a.source, a.name, b.source, b.name, "exact", None) for i, a in enumerate(dates) for b in dates[i + 1 :] if a.source != b.source and name_similarity(a.name, b.name) >= 0.5 and frozenset(((a.source, a.name), (b.source, b.name))) not in taken]
    jobs += probes[:DATE_PROBES]
    if not jobs:
        return []
    stats = {r["id"]: r for r in inclusion(freq, [(i, *j[:5]) for i, j in enumerate(jobs)]).collect()}
    out = []
    for i, (ls, lc, rs, rc, chain, rel) in enumerate(jobs):
        left, right = profiles[ls], profiles[rs]
        r = stats.get(i)
        a = r and arithmetic(r, left[0].rows, right[0].rows)
        if not a:
            continue
        personal = any(c.personal for c in (*left, *right) if c.name in (lc, rc))
        worst = {"value": mask_value(r["worst"]["v"]) if personal else r["worst"]["v"], "leftCount": r["worst"]["a"], "rightCount": r["worst"]["b"]}
        out.append({
            "id": f"join_{len(out) + 1}", "leftSourceId": ls, "rightSourceId": rs, "relationshipId": rel, "keys": [{"left": lc, "right": rc}], "normalizations": [] if chain == "exact" else [chain], "expectedRows": {k: {"value": a[k], "exact": True} for k in ("inner", "left", "full")},
            "matchRate": {"leftInRight": a["matchLeft"], "rightInLeft": a["matchRight"]}, "unmatchedLeft": a["unmatchedLeft"], "unmatchedRight": a["unmatchedRight"], "mostlyNullColumnsAfterJoin": mostly_null(right, rc, a["matchLeft"]),
            "fanOut": {"risk": a["risk"], "multiplier": a["multiplier"], "worstKey": worst}, "indicators": indicators(left, right, (lc, rc), a["matchLeft"]), "evidence": [{"label": "frequencies", "sql": f'SELECT SUM(l.n * r.n) FROM (SELECT "{lc}" v, COUNT(*) n FROM "{ls}" GROUP BY 1) l JOIN (SELECT "{rc}" v, COUNT(*) n FROM "{rs}" GROUP BY 1) r USING (v)', "result": a}],
        })
    return out


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, chain: str = "exact") -> DataFrame:
    """Left join on normalised keys; names that both sides have get a suffix on the right."""
    renamed = right.toDF(*(f"{c}_right" if c in left.columns else c for c in right.columns))
    key = f"{right_key}_right" if right_key in left.columns else right_key
    return left.join(renamed, normalise(left[f"`{left_key}`"], chain) == normalise(renamed[f"`{key}`"], chain), "left")


def sanitised(df: DataFrame) -> DataFrame:
    return df.select(*(csv_safe(df[f"`{f.name}`"]).alias(f.name) if group_of(f.dataType) == "text" else df[f"`{f.name}`"] for f in df.schema.fields))


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> int:
    """Write with formula-like texts quoted; returns the number of rows.  One file only on request."""
    safe = sanitised(df)
    (safe.coalesce(1) if single_file else safe).write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).option("multiLine", True).csv(path).count()


def routes(relationships: list[dict], hops: int = 3) -> list[dict]:
    """Best path of two or more hops for each pair of sources without a direct relationship; a score is the product."""
    links: dict[str, dict[str, float]] = {}
    for r in relationships:
        if r["confidence"] != "low" and r["userDecision"] != "rejected":
            for a, b in ((r["leftSourceId"], r["rightSourceId"]), (r["rightSourceId"], r["leftSourceId"])):
                links.setdefault(a, {})[b] = max(r["score"], links.get(a, {}).get(b, 0))
    best: dict[tuple, tuple[float, list[str]]] = {}
    for start in sorted(links):
        paths = [(1.0, [start])]
        for _ in range(hops):
            paths = [(s * w, [*p, t]) for s, p in paths for t, w in sorted(links[p[-1]].items()) if t not in p]
            for s, p in paths:
                pair = tuple(sorted((p[0], p[-1])))
                if len(p) > 2 and p[-1] not in links[p[0]] and s > best.get(pair, (0, []))[0]:
                    best[pair] = (s, p)
    return sorted(({"from": p[0], "to": p[-1], "via": p, "score": s} for s, p in best.values()), key=lambda r: (-r["score"], r["via"]))
