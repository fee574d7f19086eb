"""Tables of a live database, read only, with a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.sources.files import Source

TABLES, SAMPLE_ROWS = 200, 200_000


def redact(message: str, *secrets: str | None) -> str:
    for s in sorted({s for s in secrets if s}, key=len, reverse=True):
        message = message.replace(s, "•••")
    return message[:300]


def sample_exact(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same on every run."""
    h = F.xxhash64(F.lit(seed), *(F.to_json(F.struct(df[f"`{c}`"])) if "<" in t else df[f"`{c}`"] for c, t in df.dtypes))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


def connection(engine: str, host: str, port: int | None, database: str, user: str, password: str) -> dict:
    kind = {"postgres": ("postgresql", 5432, "org.postgresql.Driver"), "mysql": ("mysql", 3306, "com.mysql.cj.jdbc.Driver")}[engine]
    return {"url": f"jdbc:{kind[0]}://{host}:{port or kind[1]}/{database}", "driver": kind[2], "user": user, "password": password, "readOnly": "true", "sessionInitStatement": "SET default_transaction_read_only = on" if engine == "postgres" else "SET SESSION TRANSACTION READ ONLY"}


def read_database(spark: SparkSession, engine: str, host: str, database: str, user: str, password: str, port: int | None = None, schema: str | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 0, load=None) -> list[Source]:
    """The first TABLES tables by name.  ``load(options)`` gives a DataFrame; by default Spark's JDBC reader."""
    options = connection(engine, host, port, database, user, password)
    load = load or (lambda o: spark.read.format("jdbc").options(**o).load())
    schema = schema or ("public" if engine == "postgres" else database)
    listed = load(options | {"query": f"SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema.replace(chr(39), chr(39) * 2)}' AND table_type = 'BASE TABLE' ORDER BY table_name LIMIT {TABLES}"})
    out = []
    for name in [r[0] for r in listed.collect()]:
        sid = f"src_db_{''.join(c if c.isalnum() else '_' for c in name)[:40]}"
        try:
            df = load(options | {"dbtable": f"{schema}.{name}"})
            total = df.count()
            sampled = total > sample_rows
            out.append(Source(sid, name, sample_exact(df, sample_rows, seed) if sampled else df, min(total, sample_rows), origin="database", warnings=[f"{sample_rows} of {total} rows"] * sampled))
        except Exception as e:  # one bad table must not stop the others
            out.append(Source(sid, name, None, origin="database", warnings=[redact(str(e), password, user, host)]))
    return out
