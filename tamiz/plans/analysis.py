"""The whole diagnosis: tables in, one report out; and what a user does with the report afterwards."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tamiz.operators import bridges, joins, keys, quality, relationships
from tamiz.operators.profile import frequencies, profile
from tamiz.sources.files import Source, read_folder, register

VERSION, SCORING = "1.0.0", "1.0.0"
TABLES_AT_ONCE = 4
LISTS = ("sources", "profiles", "keys", "relationships", "findings", "joinPredictions", "bridgeProposals", "stages")


def at_once(f: Callable, items) -> list:
    """f of each item, in order; the jobs of several tables run beside each other."""
    session = SparkSession.getActiveSession()
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(session)(f) if session else f, items))


def validate(report: dict) -> dict:
    """ValueError unless the report keeps its contract."""
    if missing := [k for k in LISTS if k not in report]:
        raise ValueError(f"report without {missing}")
    for kind in ("relationships", "findings"):
        for x in report[kind]:
            if not x.get("evidence") or any("sql" not in e for e in x["evidence"]):
                raise ValueError(f"{kind}: {x.get('id')} has no evidence")
    for r in report["relationships"]:
        if not (r.get("signals") and 0 <= r["score"] <= 1 and all(0 <= v <= 1 for v in r["signals"].values()) and all(p["delta"] <= 0 for p in r["penalties"])):
            raise ValueError(f"relationship {r.get('id')}: signals, score or penalties out of range")
    return report


def analyze(spark: SparkSession, sources: list[Source] | dict[str, DataFrame] | str, say: Callable[[str], None] | None = None, locale: str = "es") -> dict:
    """Diagnose a folder, sources, or DataFrames by name.  A stage that fails is recorded and the next ones go on."""
    report: dict = {k: [] for k in LISTS} | {"version": VERSION, "scoringVersion": SCORING, "locale": locale, "llmUsed": False}
    state: dict = {"profiles": {}, "freq": None, "keys": {}}
    held: list[DataFrame] = []

    def ingest() -> None:
        found = read_folder(spark, sources) if isinstance(sources, str) else [Source(n, n, df, df.count()) for n, df in sources.items()] if isinstance(sources, dict) else sources
        register(found)
        state["sources"] = [s for s in found if s.df is not None and s.rows]
        report["sources"] = [{"id": s.id, "name": s.name, "rowCount": s.rows, "warnings": s.warnings, "origin": {"kind": s.origin, "sheet": s.sheet, "contentHash": s.content_hash, "headerRow": s.header_row, "discardedRows": s.discarded}} for s in found]

    def profiles() -> None:
        freqs = [frequencies(s.df).persist(StorageLevel.MEMORY_AND_DISK) for s in state["sources"]]
        held.extend(freqs)
        state["profiles"] |= dict(at_once(lambda x: (x[0].id, profile(x[0].id, x[0].df, x[1])), zip(state["sources"], freqs, strict=True)))
        parts = [freq.withColumn("source", F.lit(s.id)) for s, freq in zip(state["sources"], freqs, strict=True)]
        state["freq"] = reduce(DataFrame.unionByName, parts) if parts else None
        report["profiles"] = [c.published() for cs in state["profiles"].values() for c in cs]

    def find_keys() -> None:
        able = [s for s in state["sources"] if s.id in state["profiles"]]
        for s, k in zip(able, at_once(lambda s: keys.find_key(s.df, state["profiles"][s.id]), able), strict=True):
            if k:
                state["keys"][s.id] = k
                report["keys"].append(k)

    def relate() -> None:
        if state["freq"] is not None:
            report["relationships"] = relationships.discover(state["freq"], state["profiles"])

    def bridge() -> None:
        for found in at_once(lambda s: bridges.find_bridges(s.id, s.df, state["profiles"][s.id], state["keys"].get(s.id)), state["sources"]):
            report["bridgeProposals"] += found
        for i, b in enumerate(report["bridgeProposals"]):
            b["id"] = f"bridge_{i + 1}"

    def judge() -> None:
        out = quality.from_others(report["bridgeProposals"], report["relationships"])

        def of(s: Source) -> list[dict]:
            cs, freq = state["profiles"][s.id], state["freq"].where(F.col("source") == s.id)
            return quality.near_duplicates(s.id, cs, freq) + quality.ghost_columns(s.id, cs) + quality.mirror_columns(s.id, s.df, cs) + quality.redundant_copies(s.id, s.df, cs, state["keys"].get(s.id)) + quality.from_profiles(s.id, cs)

        for found in at_once(of, state["sources"]):
            out += found
        report["findings"] = [{"id": f"finding_{i + 1}"} | f for i, f in enumerate(out)]
        for f in report["findings"]:
            if say:
                say(f["title"])

    def predict() -> None:
        if state["freq"] is not None:
            report["joinPredictions"] = joins.predict(state["freq"], state["profiles"], report["relationships"])

    now = lambda: dt.datetime.now(dt.UTC).isoformat()
    try:
        for name, run in (("ingest", ingest), ("profile", profiles), ("keys", find_keys), ("relationships", relate), ("bridges", bridge), ("quality", judge), ("joins", predict)):
            if say:
                say(name)
            stage = {"name": name, "status": "done", "startedAt": now(), "error": None}
            try:
                run()
            except Exception as e:
                stage |= {"status": "failed", "error": str(e)[:300]}
            report["stages"].append(stage | {"finishedAt": now()})
    finally:
        for df in held:
            df.unpersist()
    return validate(report)


def save(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, default=str)


def decide(report: dict, relationship_id: str, decision: str, comment: str | None = None) -> dict:
    if decision not in ("pending", "confirmed", "rejected"):
        raise ValueError(decision)
    r = next(r for r in report["relationships"] if r["id"] == relationship_id)
    r |= {"userDecision": decision, "userComment": comment}
    return report


def prediction_for(report: dict, a: str, b: str) -> dict | None:
    """The first prediction for two sources, or else the best indirect route between them."""
    for j in report["joinPredictions"]:
        if {j["leftSourceId"], j["rightSourceId"]} == {a, b}:
            return j
    return next((r for r in joins.routes(report["relationships"]) if {r["from"], r["to"]} == {a, b}), None)


def execute_join(spark: SparkSession, report: dict, join_id: str, path: str | None = None) -> DataFrame | int:
    j = next(j for j in report["joinPredictions"] if j["id"] == join_id)
    k = j["keys"][0]
    df = joins.left_join(spark.table(j["leftSourceId"]), spark.table(j["rightSourceId"]), k["left"], k["right"], (j["normalizations"] or ["exact"])[0])
    return df if path is None else joins.export_csv(df, path, single_file=True)


def execute_bridge(spark: SparkSession, report: dict, bridge_id: str, row_meaning: str, path: str | None = None) -> DataFrame | int:
    """Needs the user's word on what a row stands for, which the report keeps."""
    if not row_meaning.strip():
        raise ValueError("say what a row of the bridge stands for")
    b = next(b for b in report["bridgeProposals"] if b["id"] == bridge_id)
    source = spark.table(b["sourceIds"][0])
    if b["kind"] == "n_m":
        df = bridges.pairs(source, *b["columns"])
    else:
        own = b["ddl"].split('("')[1].split('"')[0]
        df = bridges.explode_list(source, own, b["column"], b["separator"])
    out = df if path is None else joins.export_csv(df, path, single_file=True)
    b["meaning"] = {"rowMeaning": row_meaning, "confirmedByUser": True}
    return out


def purge(folder: str, *names: str) -> None:
    """Remove files inside a folder, and nothing outside it."""
    home = os.path.realpath(folder)
    for n in names:
        path = os.path.realpath(os.path.join(home, n))
        if os.path.commonpath([home, path]) == home and os.path.isfile(path):
            os.remove(path)


__all__ = ["analyze", "decide", "execute_bridge", "execute_join", "prediction_for", "purge", "save", "validate"]
