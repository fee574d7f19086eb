"""Column profiles: one wide aggregate per table, and one table of value frequencies for all columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.functions import semantic
from tamiz.functions.text import is_empty_like, mask_value, normalise, pattern_shape

TOP, PATTERNS, LONG = 20, 3, 200
PERCENTILES, NEAR = (0.5, 0.95), 0.002
FAR = "struct<basic: string, digits: string, shape: string>"


def group_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "bool" if isinstance(t, T.BooleanType) else "other"


def as_text(df: DataFrame, name: str):
    t = df.schema[name].dataType
    c = df[f"`{name}`"]
    return F.to_json(F.struct(c)) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else F.hex(c) if isinstance(t, T.BinaryType) else c.cast("string")


@dataclass
class Column:
    source: str
    name: str
    position: int
    physical: str
    group: str
    rows: int
    nulls: int
    distinct: int
    uniqueness: float
    empty_like: int = 0
    low: object = None
    high: object = None
    mean: float | None = None
    median: float | None = None
    p95: float | None = None
    length: tuple = (None, None, None)
    top: list = field(default_factory=list)
    patterns: list = field(default_factory=list)
    kind: str = "unknown"
    confidence: str = "low"
    personal: bool = False
    risks: list = field(default_factory=list)

    @property
    def integer(self) -> bool:
        return self.physical in ("tinyint", "smallint", "int", "bigint")

    @property
    def null_ratio(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    def published(self) -> dict:
        """What may be shown: personal values are masked, their statistics left out."""
        hide = self.personal
        return {
            "sourceId": self.source, "name": self.name, "position": self.position, "physicalType": self.physical, "semanticType": self.kind, "semanticConfidence": self.confidence, "isPersonalData": hide, "rowCount": self.rows,
            "nullCount": self.nulls, "emptyLikeCount": self.empty_like, "distinctCount": self.distinct, "uniquenessRatio": self.uniqueness, "min": None if hide or self.low is None else str(self.low), "max": None if hide or self.high is None else str(self.high),
            "mean": None if hide else self.mean, "median": None if hide else self.median, "p95": None if hide else self.p95, "topValues": [{"value": mask_value(v) if hide else v, "count": n} for v, n in self.top],
            "lengthMin": self.length[0], "lengthMax": self.length[1], "lengthAvg": self.length[2], "dominantPatterns": [{"pattern": p, "share": s} for p, s in self.patterns], "risks": self.risks,
        }


def frequencies(df: DataFrame) -> DataFrame:
    """(column, value, far, cnt) of all non-null values as text.

    A text of over LONG characters is shown by its beginning and a 128-bit hash, so that whole texts are never shuffled;
    ``far`` then has what the normalisations and the shape make of the whole text, itself shortened in this way.
    """

    def short(c):
        return F.when(F.length(c) > LONG, F.concat(F.left(c, F.lit(LONG)), F.lit("…"), F.hex(F.xxhash64(c)), F.hex(F.xxhash64(c, F.lit(1))))).otherwise(c)

    def pair(name: str):
        v = as_text(df, name)
        kinds = {"basic": short(normalise(v, "basic")), "digits": short(normalise(v, "digits")), "shape": short(pattern_shape(v))}
        far = F.when(F.length(v) > LONG, F.struct(*(e.alias(k) for k, e in kinds.items())))
        return F.struct(F.lit(name).alias("column"), short(v).alias("value"), (far if group_of(df.schema[name].dataType) in ("text", "other") else F.lit(None).cast(FAR)).alias("far"))

    return df.select(F.explode(F.array(*map(pair, df.columns))).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("column", "value", "far").agg(F.count("*").alias("cnt"))


def form_of(kind: str):
    """Of a row of ``frequencies``: its value after a normalisation, or its shape."""
    value, far = F.col("value"), F.col("far")
    plain = pattern_shape(value) if kind == "shape" else normalise(value, kind)
    return plain if kind == "exact" else F.when(far.isNull(), plain).otherwise(far[kind])


def top_values(freq: DataFrame, k: int = TOP) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("cnt"), "value"))
    return freq.withColumn("rank", rank).where(F.col("rank") <= k)


def dominant_patterns(freq: DataFrame, k: int = PATTERNS) -> DataFrame:
    """(column, pattern, share, rank), share of the non-null rows."""
    p = freq.groupBy("column", form_of("shape").alias("pattern")).agg(F.sum("cnt").alias("n"))
    p = p.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "pattern"))).where(F.col("rank") <= k)


def wide_stats(df: DataFrame) -> dict:
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c, g = df[f"`{f.name}`"], group_of(f.dataType)
        aggs.append(F.count(c).alias(f"n{i}"))
        if g in ("numeric", "text", "date"):
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if g == "numeric":
            d = c.cast("double")
            around = [F.lit(p + e) for p in PERCENTILES for e in (-NEAR, NEAR)]
            aggs += [F.avg(d).alias(f"avg{i}"), F.percentile_approx(d, F.array(*around), 10_000).alias(f"pc{i}")]
        if g == "text":
            aggs += [F.count_if(is_empty_like(c)).alias(f"em{i}"), *(getattr(F, k)(F.length(c)).alias(f"l{k}{i}") for k in ("min", "max", "avg"))]
    return df.agg(*aggs).first().asDict()


def percentiles(freq: DataFrame, around: dict[str, tuple[int, list]]) -> dict[str, list]:
    """Exact percentiles from frequencies; ``around``: column -> (values, bounds on both sides of each percentile).

    The bounds come from mergeable sketches, so only the few values between them are put in order; all below are one count.
    """
    bounds = [(c, k, p, float(b[2 * k]), float(b[2 * k + 1]), n) for c, (n, b) in around.items() if n and b for k, p in enumerate(PERCENTILES)]
    if not bounds:
        return {}
    side = freq.sparkSession.createDataFrame(bounds, "column string, k int, p double, lo double, hi double, n long")
    v = F.col("value").cast("double")
    j = freq.join(F.broadcast(side), "column").where(v <= F.col("hi")).select("column", "k", F.when(v >= F.col("lo"), v).alias("v"), "cnt", ((F.col("n") - 1) * F.col("p")).alias("at"))
    j = j.groupBy("column", "k", "v").agg(F.sum("cnt").alias("cnt"), F.first("at").alias("at"))
    upto = F.sum("cnt").over(Window.partitionBy("column", "k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("upto", upto).where("v IS NOT NULL").groupBy("column", "k")
    rows = j.agg(F.first("at").alias("at"), *(F.min(F.when(F.col("upto") > f("at"), F.col("v"))).alias(x) for x, f in (("a", F.floor), ("b", F.ceil)))).collect()
    out = {c: [None] * len(PERCENTILES) for c in around}
    for r in rows:
        if r["a"] is not None and r["b"] is not None:
            out[r["column"]][r["k"]] = r["a"] + (r["b"] - r["a"]) * (r["at"] - int(r["at"]))
    return out


def profile(source: str, df: DataFrame, freq: DataFrame) -> list[Column]:
    """Profiles of all columns; ``freq`` are the table's frequencies, best persisted."""
    w = wide_stats(df)
    distinct = {r["column"]: r["d"] for r in freq.groupBy("column").agg(F.count("*").alias("d")).collect()}
    tops: dict[str, list] = {}
    for r in top_values(freq).orderBy("column", "rank").collect():
        tops.setdefault(r["column"], []).append((r["value"], r["cnt"]))
    text = [f.name for f in df.schema.fields if group_of(f.dataType) == "text"]
    shapes: dict[str, list] = {}
    for r in dominant_patterns(freq.where(F.col("column").isin(text))).orderBy("column", "rank").collect() if text else []:
        shapes.setdefault(r["column"], []).append((r["pattern"], r["share"]))
    exact = percentiles(freq, {f.name: (w[f"n{i}"], w[f"pc{i}"]) for i, f in enumerate(df.schema.fields) if f"pc{i}" in w})
    out = []
    for i, f in enumerate(df.schema.fields):
        n, d, g = w[f"n{i}"], distinct.get(f.name, 0), group_of(f.dataType)
        pc = exact.get(f.name) or [None, None]
        c = Column(source, f.name, i, f.dataType.simpleString(), g, w["rows"], w["rows"] - n, d, d / n if n else 0.0, w.get(f"em{i}") or 0, w.get(f"lo{i}"), w.get(f"hi{i}"), w.get(f"avg{i}"), pc[0], pc[1], tuple(w.get(f"l{k}{i}") for k in ("min", "max", "avg")), tops.get(f.name, []), shapes.get(f.name, []))
        m = semantic.infer(f.name, g, c.integer, f.dataType.simpleString().startswith("timestamp"), c.top, d, c.rows, c.length[2] or 0.0, c.uniqueness)
        c.kind, c.confidence, c.personal, c.risks = m.kind, m.confidence, m.personal, m.risks
        out.append(c)
    return out
