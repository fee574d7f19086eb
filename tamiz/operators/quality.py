"""Findings about the data's quality."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.names import cluster_variants
from tamiz.operators.bridges import determines
from tamiz.operators.profile import Column

VALUES, MIRRORS, DETERMINANTS = 500, 20, 6


def finding(severity: str, category: str, title: str, sources: list[str], columns: list[tuple[str, str]], affected: int, sql: str, result, impact: str = "low", effort: str = "medium") -> dict:
    return {"severity": severity, "category": category, "title": title, "sourceIds": sources, "columns": [{"sourceId": s, "column": c} for s, c in columns], "affectedRows": affected, "evidence": [{"label": category, "sql": sql, "result": result}], "remediation": {"suggestion": title, "impact": impact, "effort": effort}}


def near_duplicates(source: str, columns: list[Column], freq: DataFrame) -> list[dict]:
    able = [c for c in columns if c.group == "text" and not c.personal and c.kind in ("geo_admin", "category", "unknown") and 4 <= c.distinct <= VALUES and c.rows >= 20 and c.uniqueness <= 0.9]
    able = [c for c in able if sum(n for v, n in c.top if any(f"{s} " in v for s in ",;|")) <= 0.15 * sum(n for _, n in c.top)]
    if not able:
        return []
    values: dict[str, list] = {}
    for r in freq.where(F.col("column").isin([c.name for c in able])).orderBy(F.desc("cnt"), "value").collect():  # at most VALUES per column
        values.setdefault(r["column"], []).append((r["value"], r["cnt"]))
    out = []
    for c in able:
        groups = cluster_variants(values.get(c.name, []))
        if len(groups) < 0.9 * c.distinct and any(len(g) > 1 for g in groups):
            some = [{"kept": g[0][0], "variants": [v for v, _ in g[1:]]} for g in groups if len(g) > 1]
            out.append(finding("warning", "near_duplicates", f"{c.name}: {c.distinct} spellings of about {len(groups)} things", [source], [(source, c.name)], sum(n for g in groups if len(g) > 1 for _, n in g), f'SELECT "{c.name}", COUNT(*) FROM "{source}" GROUP BY 1 ORDER BY 2 DESC', some[:5], "medium", "low"))
    return out


def ghost_columns(source: str, columns: list[Column]) -> list[dict]:
    gone = [c for c in columns if c.rows >= 50 and (c.nulls + c.empty_like) / c.rows >= 0.95]
    return [finding("info", "ghost_column", f"{c.name} is almost empty", [source], [(source, c.name)], c.nulls + c.empty_like, f"SELECT COUNT(*) FROM \"{source}\" WHERE \"{c.name}\" IS NULL OR trim(\"{c.name}\"::VARCHAR) IN ('', 'N/A', 'NA', 'n/a', '-', 'NULL', 'null', '#N/A', '#REF!', 'S/D', 's/d')", c.nulls + c.empty_like, "low", "low") for c in gone]


def mirror_counts(df: DataFrame, formulas: list[tuple[str, str, str]]) -> dict[tuple, tuple[int, int]]:
    """(broken, checked) rows of target = a * b, all formulas in one pass."""
    if not formulas:
        return {}
    d = lambda c: df[f"`{c}`"].cast("double")
    aggs = []
    for i, (t, a, b) in enumerate(formulas):
        gap = F.abs(d(a) * d(b) - d(t))
        aggs += [F.count_if(gap > 0.005).alias(f"x{i}"), F.count(gap).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    return {f: (r[f"x{i}"], r[f"n{i}"]) for i, f in enumerate(formulas)}


def mirror_columns(source: str, df: DataFrame, columns: list[Column]) -> list[dict]:
    able = [c.name for c in columns if c.group == "numeric" and c.kind != "identifier" and c.distinct > 1 and c.rows >= 50]
    if not 3 <= len(able) <= 8:
        return []
    first = sorted(able, key=lambda n: 0 if "total" in n.lower() else 1 if "valor" in n.lower() else 2)
    formulas = [(t, a, b) for t in first for a, b in combinations([c for c in able if c != t], 2)][:MIRRORS]
    for (t, a, b), (broken, n) in mirror_counts(df, formulas).items():
        if n and broken <= 0.05 * n:
            sql = f'SELECT COUNT(*) FROM "{source}" WHERE ABS("{a}" * "{b}" - "{t}") > 0.005'
            return [finding("warning", "mirror_column", f"{t} = {a} x {b}, except in {broken} rows", [source], [(source, x) for x in (t, a, b)], broken, sql, broken, "high")] if broken else []
    return []


def redundant_copies(source: str, df: DataFrame, columns: list[Column], key: dict | None) -> list[dict]:
    if not columns or columns[0].rows < 50:
        return []
    keys = set(key["columns"]) if key else set()
    able = [c for c in columns if c.name not in keys and c.kind != "free_text" and not c.personal and c.group != "other"]
    lead = [c for c in able if 2 <= c.distinct <= 0.5 * c.rows][:DETERMINANTS]
    tests = [(x.name, y.name) for x, y in permutations(able, 2) if x in lead and 1 < y.distinct <= x.distinct]
    dep, by, seen, out = determines(df, tests), {c.name: c for c in columns}, set(), []
    for x in lead:
        copies = [y for a, y in tests if a == x.name and dep[a, y] and y not in seen and x.name not in seen]
        if copies:
            seen |= {*copies}
            sql = f'SELECT COUNT(DISTINCT "{x.name}"), COUNT(DISTINCT "{x.name}" || coalesce("{copies[0]}"::VARCHAR, \'\')) FROM "{source}"'
            out.append(finding("warning", "redundant_copy", f"{', '.join(copies)} follow from {x.name}", [source], [(source, c) for c in (x.name, *copies)], by[x.name].rows - by[x.name].distinct, sql, by[x.name].distinct, "medium"))
    return out


def from_profiles(source: str, columns: list[Column]) -> list[dict]:
    out = [finding("warning", "ambiguous_date", f"{c.name}: {c.risks[0]}", [source], [(source, c.name)], c.rows - c.nulls, f'SELECT "{c.name}", COUNT(*) FROM "{source}" GROUP BY 1', c.risks, "high") for c in columns if c.risks]
    if some := [c.name for c in columns if c.personal]:
        out.append(finding("info", "personal_data", f"personal data in {', '.join(some)}", [source], [(source, c) for c in some], columns[0].rows, f'SELECT COUNT(*) FROM "{source}"', columns[0].rows))
    return out


def from_others(bridges: list[dict], relationships: list[dict]) -> list[dict]:
    out = []
    for b in bridges:
        m = b["resultMetrics"]
        if b["kind"] == "n_m" and m["rows"] > m["distinctLeft"]:
            out.append(finding("warning", "inflated_count", f"{m['rows']} rows, but {m['distinctLeft']} different {b['columns'][0]}", b["sourceIds"], [(b["sourceIds"][0], b["columns"][0])], m["rows"] - m["distinctLeft"], b["populateSql"], m["distinctLeft"], "high"))
    for r in relationships:
        if r["classification"] == "broken_integrity" and r["confidence"] == "high":
            out.append(finding("critical", "orphans", f"{r['orphans']} rows of {r['leftSourceId']} point nowhere", [r["leftSourceId"], r["rightSourceId"]], [(r["leftSourceId"], r["leftColumns"][0]), (r["rightSourceId"], r["rightColumns"][0])], r["orphans"], r["evidence"][0]["sql"], r["orphans"], "high"))
    return out
