"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the text under a letter-trigram model of each language; the
language that the markup or metadata declares, through how often each language's texts declare it; the address suffix;
and the host.  The priors are estimated from all rows by grouped aggregation of the text posteriors and smoothed by
level: a host's counts lean on its suffix's, those on the counts of the whole table.  A row's own count is left out of
its prior.  Besides the languages there is ``und``, whose text likelihood is a flat model; it takes texts of no known
language.

The trigram models are fitted on a bounded sample of labelled rows, about ``SAMPLE`` per declared language chosen by a
hash of the id.  Every declared language takes part, by its primary subtag (en-us and en_gb are en); models are fitted,
kept as files and scored in blocks of ``LANGUAGES``.  Everything else uses whole texts of all rows.

A row is kept if its language is known and its posterior is at least one half.  Defined cases: a text without letters
(null, empty) is ``und`` and rejected; null declared language, suffix or host give no evidence of that kind; a null id or
a repeated row is judged like any other; where no row declares a language all are ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.shared import column_of, get_bytes, numbered, put_bytes, settle, workspace

SAMPLE = 1500
LANGUAGES = 60
BINS = 1 << 16
PART_BYTES = 1 << 20
#: Text evidence counts as that of this many trigrams at most, as neighbouring trigrams aren't independent.
TEXT_WEIGHT = 40.0
HOST_LEAN, SUFFIX_LEAN, DECLARED_LEAN = 20.0, 50.0, 1.0
UND, UND_SHARE = "und", 0.01
#: ASCII letters lowered, other ASCII blank; bytes of longer characters kept.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def cut_texts(texts: list[bytes], most: int = PART_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, owner) of parts of about ``most`` bytes; owner is -1 at the edges of a piece, which only serve as neighbours.

    A longer text is cut, and each piece sees the byte before and after it, so cutting changes no trigram.
    """
    held, size = [], 0

    def part() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for _, x in held])
        owner, ends = np.repeat([k for k, _ in held], sizes), np.cumsum(sizes)
        owner[ends - 1] = owner[ends - sizes] = -1
        return np.frombuffer(b"".join(x for _, x in held), np.uint8).astype(np.uint32), owner

    for k, t in enumerate(texts):
        t = b" " + t.translate(TABLE) + b" "
        for a in range(1, len(t) - 1, most):
            held.append((k, t[a - 1 : a + most + 1] if len(t) > most + 2 else t))
            size += len(held[-1][1])
            if size >= most:
                yield part()
                held, size = [], 0
    if held:
        yield part()


def trigram_bins(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bin and text number of each trigram with a letter in its middle, part by part."""
    for b, owner in cut_texts(texts):
        code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
        inner = (b[1:-1] != 32) & (owner[1:-1] >= 0)
        yield code[inner].astype(np.int64), owner[1:-1][inner]


def primary(declared: Column) -> Column:
    """The language without its region or script."""
    return F.coalesce(F.nullif(F.regexp_extract(declared, "^[^-_]+", 0), F.lit("")), declared)


def fit(rows: DataFrame, root: str) -> tuple[list[str], list[str]]:
    """(languages, files of the log-probabilities of their bins) from a bounded sample of (key, text, declared)."""
    rows = rows.withColumn("declared", primary(F.col("declared")))
    counts = {r["declared"]: r["count"] for r in rows.where("declared IS NOT NULL").groupBy("declared").count().collect()}
    names, files = sorted(counts), []
    for k in range(0, len(names), LANGUAGES):
        part = names[k : k + LANGUAGES]
        files.append(f"{root}/model/{k}")
        put_bytes(files[-1], _fit(rows, part, [counts[x] for x in part]).tobytes())
    return names, files


@lru_cache(1)
def _model(path: str) -> np.ndarray:
    return np.frombuffer(get_bytes(path), np.float32).reshape(-1, BINS)


def _fit(rows: DataFrame, names: list[str], counts: list[int]) -> np.ndarray:
    share = F.create_map(*(F.lit(x) for name, n in zip(names, counts, strict=True) for x in (name, min(1.0, SAMPLE / n))))
    chance = F.pmod(F.xxhash64("key", F.lit(4)), F.lit(1 << 30)) / (1 << 30)
    picked = rows.where(F.col("declared").isin(names)).where(chance < F.element_at(share, F.col("declared"))).select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the bins that a partition's share of the sample has, a row per language."""
        total: dict[str, np.ndarray] = {}
        for rows in batches:
            label = rows.column("declared").to_pylist()
            texts = [t or b"" for t in rows.column("text").cast(pa.large_binary()).to_pylist()]
            for name in set(label):
                for code, _ in trigram_bins([t for t, x in zip(texts, label, strict=True) if x == name]):
                    total[name] = total.get(name, 0) + np.bincount(code, minlength=BINS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"name": [name], "at": [at.astype(np.int32).tobytes()], "n": [n[at].tobytes()]})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(BINS, np.int64)
        for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        return pa.table({"name": [t.column("name")[0].as_py()], "data": [total.tobytes()]})

    # The sample is bounded, and so are the rows that meet for a language: one for each partition with a sampled text.
    parts = picked.mapInArrow(count, "name string, at binary, n binary").groupBy("name").applyInArrow(add, "name string, data binary")
    got = {r["name"]: np.frombuffer(r["data"], np.int64) for r in parts.collect()}
    total = np.stack([got.get(name, np.zeros(BINS, np.int64)) for name in names])
    p = (total + 0.2) / (total + 0.2).sum(axis=1, keepdims=True)
    return np.log(p).astype(np.float32)


def text_scores(rows: DataFrame, files: list[str]) -> DataFrame:
    """Replaces text by n (trigrams) and score, the weighed log-likelihood of each language, ``und`` last."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or b"" for t in rows.column("text").cast(pa.large_binary()).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            blocks = []
            for turn, file in enumerate(files or [None]):
                table = [] if file is None else _model(file)
                sums = np.zeros((len(texts), len(table)))
                for code, owner in trigram_bins(texts):
                    if len(owner):
                        lo, hi = int(owner[0]), int(owner[-1]) + 1
                        if turn == 0:
                            n[lo:hi] += np.bincount(owner - lo, minlength=hi - lo)
                        for j, t in enumerate(table):
                            sums[lo:hi, j] += np.bincount(owner - lo, t[code], minlength=hi - lo)
                blocks.append(sums)
            score = np.concatenate([*blocks, n[:, None] * -np.log(BINS / 4)], 1) * (TEXT_WEIGHT / (n + TEXT_WEIGHT))[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * score.shape[1], pa.int32()), pa.array(score.ravel()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in others), pa.array(n, pa.int64()), flat], [*others, "n", "score"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, "text").mapInArrow(run, schema + ", n long, score array<double>")


def softmax(score: Column) -> Column:
    top = F.array_max(score)
    e = F.transform(score, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(rows: DataFrame) -> DataFrame:
    """Of rows (key, text, declared, host, suffix): key, declared, text_lang, lang, posterior, kept, and any other column."""
    spark, more = rows.sparkSession, [c for c in rows.columns if c not in ("key", "text", "declared", "host", "suffix")]
    root = workspace(spark, "language")
    names, files = fit(rows, root)
    labels = [*names, UND]
    k = len(labels)
    scored = settle(text_scores(rows, files), f"{root}/scores")
    # The text's own posterior under equal priors, und apart.
    flat = [float(np.log((1 - UND_SHARE) / max(1, k - 1)))] * (k - 1) + [float(np.log(UND_SHARE))]
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    base = F.array(*map(F.lit, flat))
    own = settle(scored.withColumn("s", plus("score", base)).withColumn("own", softmax(F.col("s"))).drop("s"), f"{root}/own")
    sums = lambda *keys: own.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.get("own", F.lit(i))).alias(f"c{i}") for i in range(k)))
    vector = lambda: F.array(*(F.col(f"c{i}") for i in range(k)))
    whole = sums().first()
    total = np.array([whole[f"c{i}"] or 0.0 for i in range(k)])
    every = (total + 1) / (total + 1).sum()
    suffixes = sums("suffix").where("suffix IS NOT NULL").select(F.col("suffix").alias("_s"), vector().alias("by_suffix"))
    hosts = sums("host", "suffix").where("host IS NOT NULL").select(F.col("host").alias("_h"), F.col("suffix").alias("_hs"), vector().alias("by_host"))
    said = sums("declared").where("declared IS NOT NULL").select(F.col("declared").alias("_d"), vector().alias("by_declared"))
    j = own.join(suffixes, F.col("suffix") == F.col("_s"), "left").join(hosts, (F.col("host") == F.col("_h")) & F.col("suffix").eqNullSafe(F.col("_hs")), "left").join(said, F.col("declared") == F.col("_d"), "left")
    at = F.array(*map(F.lit, range(k)))
    prior0 = F.array(*(F.lit(float(x)) for x in every))
    size0 = F.array(*(F.lit(float(x)) for x in total))
    less = lambda counts, i: F.greatest(F.coalesce(F.get(counts, i) - F.get("own", i), F.lit(0.0)), F.lit(0.0))
    n_of = lambda counts: F.greatest(F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, b: a + b), F.lit(1.0)) - 1, F.lit(0.0))
    j = j.withColumns({"n_suffix": n_of(F.col("by_suffix")), "n_host": n_of(F.col("by_host"))})
    j = j.withColumn("p_suffix", F.transform(at, lambda i: (less("by_suffix", i) + SUFFIX_LEAN * F.get(prior0, i)) / (F.col("n_suffix") + SUFFIX_LEAN)))
    j = j.withColumn("p_host", F.transform(at, lambda i: (less("by_host", i) + HOST_LEAN * F.get("p_suffix", i)) / (F.col("n_host") + HOST_LEAN)))
    declared = F.transform(at, lambda i: F.when(F.col("declared").isNull(), 0.0).otherwise(F.log((less("by_declared", i) + DECLARED_LEAN) / (F.greatest(F.get(size0, i) - F.get("own", i), F.lit(0.0)) + DECLARED_LEAN * (k + 1)))))
    j = j.withColumn("fused", F.transform(at, lambda i: F.get("score", i) + F.log(F.get("p_host", i)))).withColumn("said", declared)
    j = j.withColumn("fused", plus("fused", "said")).withColumn("post", softmax(F.col("fused")))
    name = lambda p: F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int"))
    some = F.col("n") > 0
    lang, posterior = F.when(some, name(F.col("post"))).otherwise(UND), F.when(some, F.round(F.array_max("post"), 6)).otherwise(1.0)
    j = j.select("key", *more, "declared", F.when(some, name(F.col("own"))).otherwise(UND).alias("text_lang"), lang.alias("lang"), posterior.alias("posterior"))
    j = j.withColumn("kept", (F.col("lang") != UND) & (F.col("posterior") >= 0.5))
    return settle(j, f"{root}/found")  # a filter of the caller's would copy the nested expressions above into itself


def document_rows(docs: DataFrame, *more: str) -> DataFrame:
    """Documents declare ``lang``; their source stands for the host, and its last label, if it has one, for the suffix."""
    source = F.lower(F.col("source").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("declared"), source.alias("host"), F.nullif(F.regexp_extract(source, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), *more)


def documents_in_known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, with all their columns; ``lang`` becomes the language found.

    A verdict depends on a row's text, declared language and source only, so it is joined back by the hash of those
    beside the id: rows that share an id, or have none, keep verdicts of their own, and equal rows stay as many.
    """
    d = numbered(docs)
    text, lang, source = (F.col(column_of(docs, c)).cast("string") for c in ("text", "lang", "source"))
    hash_ = F.xxhash64(text, lang.isNull(), lang, source.isNull(), source)
    rows = document_rows(d.select(F.col(column_of(docs, "doc_id")).alias("doc_id"), text.alias("text"), lang.alias("lang"), source.alias("source"), hash_.alias("row")), "row")
    found = identify(rows).where("kept").select("key", "row", "lang").distinct()
    j = d.join(found, F.col(column_of(docs, "doc_id")).cast("long").eqNullSafe(F.col("key")) & (hash_ == F.col("row")))
    return j.select(*(F.col("lang" if n == "lang" else c).alias(n) for c, n in zip(d.columns, docs.columns, strict=True)))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages declare the language of their html tag; host and suffix come from the address, text is what stands outside tags."""
    html, host = F.col("html").cast("string"), F.lower(F.call_function("try_parse_url", F.col("url").cast("string"), F.lit("HOST")))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    lang = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("key"), text.alias("text"), lang.alias("declared"), host.alias("host"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(document_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("key", "doc_id")


def language_id_pages(spark, sf_dir: str) -> DataFrame:
    """The same operator over pages, with declared markup language, address suffix and host."""
    return identify(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("key", "page_id")
