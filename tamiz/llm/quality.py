"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each document gets exact counts (words, symbols, repeated lines, words in repeated 3-word windows).  From
them come four rates, kept as integers.  Per (lang, source) the rates of the documents that pass the fixed base
rules are gathered in mergeable quantile sketches: histograms whose bins keep the leading ``BITS`` bits of a
value, so a bin's error is bounded relative to its value, two sketches merge by adding counts, and the order
of merging changes nothing.  A group under ``LEAST`` documents falls back on the merged sketches of its
language, and that on those of all documents.  The quartiles read from the sketches give fences (quartile plus
or minus ``REACH`` times the spread), which are joined to the documents; a document outside a fence goes.

Defined cases: null text has no words and no lines; null lang or source form groups of their own; a null doc_id
or a repeated row is judged like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.shared import settle, workspace

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BITS = 6
LEAST = 50
REACH = 4
#: Rates and the smallest spread that counts, so that a group of equal documents is not cut to a point.  REACH times a
#: spread must leave a fence within what the rate can be: 1.6 code points a word, 80 symbols, 100 repeated lines and 400
#: repeated words in 1000 (the base rule takes 500) beyond a quartile, a multiple of the noise of texts of 50 words.
RATES = {"word_length": 40, "symbols": 20, "dup_lines": 25, "repeats": 100}


def word_array(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the exact counts of the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, " " + SPACES, "") != "")
    d = d.select("*", word_array(F.col("t")).alias("w"), lines.alias("lines"))
    n = F.size("w").cast("long")
    d = d.select(
        "doc_id", "lang", "source", "w", n.alias("n_words"), F.length(F.translate("t", " " + SPACES, "")).cast("long").alias("word_chars"), (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # Windows as (hash, place), sorted: those that occur twice stand side by side.
    last = F.size("w") - 2
    window = lambda i: F.struct(F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)).alias("h"), i.alias("i"))
    d = d.withColumn("s", F.when(last >= 2, F.array_sort(F.transform(F.sequence(F.lit(1), last), window))))
    twice = lambda i: (F.col("s")[i - 1]["h"] == F.get("s", i)["h"]) | (F.col("s")[i - 1]["h"] == F.get("s", i - 2)["h"])
    at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: F.coalesce(twice(i), F.lit(False))), lambda i: F.get("s", i - 1)["i"]))
    d = d.withColumn("at", F.when(F.col("s").isNotNull(), at))
    # Each window adds the words up to the next window, three at most.
    covered = F.aggregate(F.sequence(F.lit(1), F.size("at")), F.lit(0).cast("long"), lambda a, i: a + F.least(F.lit(3), F.coalesce(F.get("at", i) - F.get("at", i - 1), F.lit(3))))
    d = d.withColumn("n_repeat_words", F.when(F.size("at") > 0, covered).otherwise(F.lit(0)).cast("long"))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))


def rates(d: DataFrame) -> DataFrame:
    """Adds the rates, whole numbers: code points per 100 words, and symbols, repeated lines, repeated words per 1000 words."""
    per = lambda c, k: F.expr(f"CASE WHEN n_words > 0 THEN {k} * {c} DIV n_words ELSE 0 END")
    return d.withColumns({"word_length": per("word_chars", 100), "symbols": per("n_symbols", 1000), "dup_lines": per("n_dup_lines", 1000), "repeats": per("n_repeat_words", 1000)})


def sketch_bin(value: Column) -> Column:
    """Smallest value with the same leading BITS bits."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(d: DataFrame) -> DataFrame:
    """One row per (lang, source, rate, bin): a sketch in rows, merged by adding n."""
    pairs = F.array(*(F.struct(F.lit(r).alias("rate"), sketch_bin(F.col(r)).alias("bin")) for r in RATES))
    return d.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.rate", "p.bin").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """First and third quartile per group and rate, of sketches merged up to ``keys``."""
    merged = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")
    run = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    m = merged.select(*keys, "rate", "bin", F.sum("n").over(run).alias("upto"), F.sum("n").over(group).alias("all"))
    return m.groupBy(*keys, "rate").agg(F.max("all").alias("docs"), F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bin"))).alias("q1"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bin"))).alias("q3"))


def fences(sketch: DataFrame) -> DataFrame:
    """Lowest and highest value allowed of each rate, one row per (lang, source)."""
    own = quartiles(sketch, "lang", "source")
    lang = quartiles(sketch, "lang").select(F.col("lang").alias("_l"), F.col("rate").alias("_r"), F.struct("docs", "q1", "q3").alias("by_lang"))
    every = quartiles(sketch).select(F.col("rate").alias("_e"), F.struct("docs", "q1", "q3").alias("by_all"))
    q = own.join(lang, own.lang.eqNullSafe(F.col("_l")) & (own.rate == F.col("_r"))).join(F.broadcast(every), F.col("rate") == F.col("_e"))
    use = F.when(F.col("docs") >= LEAST, F.struct("docs", "q1", "q3")).when(F.col("by_lang.docs") >= LEAST, F.col("by_lang")).otherwise(F.col("by_all"))
    q = q.select("lang", "source", "rate", use.alias("u"))
    floor = F.element_at(F.create_map(*(F.lit(x) for kv in RATES.items() for x in kv)), F.col("rate"))
    spread = REACH * F.greatest(F.col("u.q3") - F.col("u.q1"), floor)
    q = q.select("lang", "source", "rate", (F.col("u.q1") - spread).alias("low"), (F.col("u.q3") + spread).alias("high"))
    pick = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{r}_{c}")
    return q.groupBy("lang", "source").agg(pick("word_length", "low"), *(pick(r, "high") for r in RATES))


def quality(docs: DataFrame) -> DataFrame:
    """Per document row the counts, base_failed and the verdict ``kept``."""
    root = workspace(docs.sparkSession, "quality")
    counts = rates(settle(document_counts(docs), f"{root}/counts"))
    limit = settle(fences(sketches(counts)), f"{root}/fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    j = counts.join(limit, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = (F.col("word_length") >= F.col("word_length_low")) & (F.col("word_length") <= F.col("word_length_high"))
    for r in ("symbols", "dup_lines", "repeats"):
        inside &= F.col(r) <= F.col(f"{r}_high")
    return j.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang", "source")


_RATE_SQL = """
    SELECT *, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
        CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_words ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats
    FROM counts"""
_FLOORS = " ".join(f"WHEN '{r}' THEN {v}" for r, v in RATES.items())
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w),
windows AS (SELECT row, i, [words[i], words[i + 1], words[i + 2]] AS g FROM places),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
hit AS (SELECT row, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY row),
counts AS (
    SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
        len(words) < 50 OR 100 * coalesce(hit.n, 0) > 50 * len(words) AS base_failed
    FROM w LEFT JOIN hit USING (row)),
rates AS ({_RATE_SQL}),
vals AS (
    SELECT lang, source, rate, (v >> s) << s AS bin
    FROM (SELECT *, greatest(length(bin(v)) - {BITS}, 0) AS s FROM (
        SELECT lang, source, unnest([{", ".join(f"'{r}'" for r in RATES)}]) AS rate, unnest([{", ".join(f"{r}::BIGINT" for r in RATES)}]) AS v FROM rates WHERE NOT base_failed))),
quart AS (
    SELECT lang, source, rate, grouping(source) AS by_lang, grouping(lang) AS by_all, count(*) AS docs, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3
    FROM vals GROUP BY GROUPING SETS ((lang, source, rate), (lang, rate), (rate))),
used AS (
    SELECT o.lang, o.source, o.rate, CASE o.rate {_FLOORS} END AS least,
        CASE WHEN o.docs >= {LEAST} THEN o.q1 WHEN l.docs >= {LEAST} THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN o.docs >= {LEAST} THEN o.q3 WHEN l.docs >= {LEAST} THEN l.q3 ELSE a.q3 END AS q3
    FROM (SELECT * FROM quart WHERE by_lang = 0) o
    JOIN (SELECT * FROM quart WHERE by_lang = 1 AND by_all = 0) l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate
    JOIN (SELECT * FROM quart WHERE by_all = 1) a ON o.rate = a.rate),
outside AS (SELECT lang, source, rate, q1 - {REACH} * greatest(q3 - q1, least) AS low, q3 + {REACH} * greatest(q3 - q1, least) AS high FROM used)
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
    NOT r.base_failed AND NOT EXISTS (
        SELECT 1 FROM outside o WHERE o.lang IS NOT DISTINCT FROM r.lang AND o.source IS NOT DISTINCT FROM r.source
        AND (CASE o.rate WHEN 'word_length' THEN r.word_length WHEN 'symbols' THEN r.symbols WHEN 'dup_lines' THEN r.dup_lines ELSE r.repeats END > o.high OR o.rate = 'word_length' AND r.word_length < o.low)) AS kept
FROM rates r
"""
