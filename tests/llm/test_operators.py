import random
import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.llm import decontaminate, jaccard, language, lines, mixing, passages, quality, queries, shingles, suffixes, tokenshards, warc
from tamiz.llm.shared import workspace

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def odd(spark, rows=((1, None), (2, ""), (3, "a"), (4, "Same line here\nSame line here"), (5, "same LINE here  \nother"), (5, "same LINE here  \nother"), (None, "Same line here"))):
    """Nulls, empties, ties and repeats, with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "s", 1, "k") for i, t in rows], DOCS + ", lang string, source string, node int, batch string")


def empty(spark):
    return odd(spark).limit(0)


def test_decontamination(spark, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = by_id(queries.queries()["op1_decontaminate"](spark, DATA), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination(docs, bench)


def test_decontamination_cases(spark, monkeypatch):
    bench = [(1, "the"), (2, "of the"), (3, ""), (4, None), (5, "a b c d e f g h i j k l"), (6, "the")]
    rows = [(1, "The of the the, of-the"), (2, None), (3, "x a b c d e f g h i j k q b c d e f g h i j k l"), (4, ""), (None, "the")]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(rows, DOCS)
    assert by_id(decontaminate.contamination(d, b).drop("items"), "*") == brute.contamination(rows, bench)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 16)  # several groups of items
    assert by_id(decontaminate.contamination(d, b).drop("items"), "*") == brute.contamination(rows, bench)
    assert decontaminate.contamination(empty(spark), b).count() == 0
    assert decontaminate.contamination(odd(spark), b.limit(0)).where("contaminated").count() == 0
    assert {r.doc_id for r in decontaminate.clean_documents(d, b).collect()} == {2, 4}
    m = decontaminate.longest_matches(d, b, 10).orderBy("n_words").collect()
    assert m[-1].n_words == 11 and m[-1].item_id == "5"


def test_decontamination_short_item_begins_longer(spark):
    bench = [("1", "a b c"), ("2", "a b c d e f g h i j")]
    rows = [(1, "x a b c d e f g h i j y")]
    b, d = spark.createDataFrame(bench, "item_id string, text string"), spark.createDataFrame(rows, DOCS)
    got = by_id(decontaminate.contamination(d, b).drop("items"), "*")
    assert got == brute.contamination(rows, bench) and got[1][1] == 10


def test_suffixes(spark, docs):
    got = by_id(queries.queries()["op5_suffix_dedup"](spark, DATA), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.spans(docs, 400)


def test_suffixes_random(spark):
    v, d = suffixes.difference_cover(20)
    assert len({(a - b) % v for a in d for b in d}) == v
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé") for _ in range(600))
    rows = [(i, "".join(base[(a := rng.randrange(500)) : a + rng.randrange(90)] + rng.choice("xyz") for _ in range(8))) for i in range(60)] + [(100, base), (101, base), (102, "q" * 500), (103, None), (104, "")]
    got = by_id(suffixes.repeated_spans(spark.createDataFrame(rows, DOCS).repartition(3), 40), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.spans(rows, 40)
    assert suffixes.repeated_spans(empty(spark)).count() == 0 and suffixes.repeated_spans(odd(spark)).count() == 7


def test_jaccard(spark, docs):
    assert by_id(queries.queries()["op7_jaccard_join"](spark, DATA), "doc_id", "n_shingles", "component_id") == brute.groups(docs)


def test_jaccard_random(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        if i % 8 == 0:
            words = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randrange(4, 60))]
        w = list(words)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert by_id(jaccard.similar_groups(df), "doc_id", "n_shingles", "component_id") == brute.groups(rows)
    for boundary in (0.0, 12.0, 1000.0):  # all sets heavy, some of them, all light
        assert by_id(jaccard.similar_groups(df, boundary=boundary), "doc_id", "n_shingles", "component_id") == brute.groups(rows)
    assert jaccard.similar_groups(empty(spark)).count() == 0
    got = sorted((r.doc_id or -1, r.n_shingles) for r in jaccard.similar_groups(odd(spark)).collect())
    assert got == [(-1, 1), (1, 0), (2, 0), (3, 1), (4, 2), (5, 1), (5, 1)]
    assert jaccard.one_of_each_group(odd(spark)).columns == odd(spark).columns


def test_jaccard_groups_are_of_rows(spark):
    """Rows that share an id, or have none, keep groups of their own; columns may have any name, nulls stay nulls."""
    one, two = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    near = one.replace("w29", "x")
    rows = [(5, one, None, 1), (9, near, "b", 2), (7, two, "c", 3), (9, two, "d", 4), (None, None, "e", 5), (None, "", "f", 6), (None, one, "g", 7), (5, one, None, 1)]
    df = spark.createDataFrame(rows, DOCS + ", node string, copies int").withColumnRenamed("copies", "row")
    got = sorted(tuple(r) for r in jaccard.one_of_each_group(df).collect() if r.text)
    assert got == [(5, one, None, 1), (7, two, "c", 3)]
    assert sorted(r.node for r in jaccard.one_of_each_group(df).collect() if not r.text) == ["e", "f"]
    assert [r.text for r in jaccard.one_of_each_group(df).where("node = 'e'").collect()] == [None]


def test_light_boundary_follows_cost(spark):
    """Small sets with one very common shingle and rare others are cheaper by subsets; copies are cheaper by lists."""
    pack = lambda x: np.array(x, np.uint64).tobytes()
    sets = [(10, bytearray(pack([7, 100 + 3 * k, 101 + 3 * k, 102 + 3 * k]))) for k in range(300)]
    lists = [(10, x) for _, r in sets for x in np.frombuffer(bytes(r), np.int64)[:1].tolist()]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert jaccard.light_boundary(df(lists, "n long, sig long"), df(sets, "n long, ranked binary"), 80) > 10
    same = [(100, bytearray(pack(range(22)))) for _ in range(50)]
    lists = [(100, x) for _ in same for x in range(21)]
    assert jaccard.light_boundary(df(lists, "n long, sig long"), df(same, "n long, ranked binary"), 80) == 0


def test_components_by_tasks_and_in_one(spark, monkeypatch):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    df = spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long")
    small = by_id(shingles.components(df, workspace(spark, "c")), "node", "comp")
    monkeypatch.setattr(shingles, "FEW_LINKS", 0)
    assert by_id(shingles.components(df, workspace(spark, "c")), "node", "comp") == small
    first = shingles.components(df.limit(60), workspace(spark, "c"))
    assert by_id(shingles.merged(first, df, workspace(spark, "c")), "node", "comp") == small


def test_passages(spark):
    rng = random.Random(11)
    words = lambda n: [rng.choice("abcdefghijklm") + rng.choice("nopqrst") + rng.choice("uvwxyz") for _ in range(n)]
    shared, edited = words(60), words(80)
    almost = list(edited)
    almost[40] = "EDIT"
    rows = [(i, " ".join(words(100))) for i in range(30)]
    rows += [(100, " ".join(words(70) + shared + words(30))), (101, " ".join(words(20) + shared)), (102, " ".join(shared + words(90)))]
    rows += [(200, " ".join(words(30) + edited)), (201, " ".join(almost + words(50))), (300, " ".join(words(55))), (400, None), (401, "")]
    rows += [(301, rows[-3][1].upper())]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert {d: r.class_id for d, r in got.items()} == {100: 100, 101: 100, 102: 100, 200: 200, 201: 200, 300: 300, 301: 300}
    assert any(s.start <= 72 and s.end >= 128 for s in got[100].spans)
    assert passages.repeated_passages(empty(spark)).count() == 0 and passages.repeated_passages(odd(spark)).count() == 0
    lo, c, hi = passages.compact_windows(np.array([5, 3, 9, 1, 7], np.uint64) << np.uint64(40), np.array([0]), np.array([5]), 2)
    assert sorted(zip(lo.tolist(), c.tolist(), hi.tolist(), strict=True)) == [(0, 1, 2), (0, 3, 4)]


def test_passages_recall(spark):
    """Planted passages with scattered edits against a search of all alignments of every planted pair."""
    rng = random.Random(21)
    words = lambda n: [rng.choice("abcdefghijklm") + rng.choice("nopqrst") + rng.choice("uvwxyz") + rng.choice("aeiou") for _ in range(n)]
    rows = []
    for k in range(120):
        p = words(rng.randrange(55, 120))
        q = list(p)
        for _ in range(rng.randrange(4)):
            q[rng.randrange(len(q))] = f"e{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words(rng.randrange(40)) + p + words(rng.randrange(60)))), (2 * k + 1, " ".join(words(rng.randrange(60)) + q + words(rng.randrange(40))))]
    want = brute.alike(rows, [(2 * k, 2 * k + 1) for k in range(120)])
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    found = [a for a, b in want if got.get(a) == got.get(b) == a]
    assert len(want) > 60 and len(found) >= 0.95 * len(want)


def test_passages_are_all_found(spark):
    """Passages at the limit: none of those that a search of all alignments finds is missed; nor longer ones with words put in."""
    rng = random.Random(31)
    words = lambda n: [rng.choice("abcdefghijklm") + rng.choice("nopqrst") + rng.choice("uvwxyz") + rng.choice("aeiou") for _ in range(n)]
    rows, n = [], 150
    for k in range(n):
        p = words(50 + k % 3)
        q = list(p)
        q[rng.randrange(len(q))] = f"e{k}"
        rows += [(2 * k, " ".join(words(rng.randrange(40)) + p + words(rng.randrange(60)))), (2 * k + 1, " ".join(words(rng.randrange(60)) + q + words(rng.randrange(40))))]
    want = brute.alike(rows, [(2 * k, 2 * k + 1) for k in range(n)])
    p = words(72)
    rows += [(900, " ".join(words(30) + p + words(40))), (901, " ".join(words(60) + p[:36] + words(8) + p[36:] + words(20)))]
    rows += [(910, " ".join(words(20) + ["the"] * 90 + words(30))), (911, " ".join(words(9) + ["the"] * 70 + words(40))), (912, " ".join(words(9) + ["the"] * 40 + words(40)))]
    line = words(11)
    rows += [(920, " ".join(line * 3)), (921, " ".join(line * 9)), (922, " ".join(words(30) + line * 9 + words(9)))]
    # A line of 35 words that many texts have makes no passage.
    line = words(35)
    rows += [(1000 + k, " ".join(words(20) + line + words(20))) for k in range(40)]
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert len(want) == n
    assert got == {d: d - d % 2 for d in range(2 * n)} | {900: 900, 901: 900, 910: 910, 911: 910, 921: 921, 922: 921}
    assert passages.least_run(46, 80) == 21


def test_words_are_encoded_once():
    """Words that differ in case share an encoding; ids are the tokenizer's, odd white space and marks included."""
    import public_tokenizers

    encode = tokenshards.TextEncoder(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["Word WORD word", "word, Word! it's IT'S don't", "a\x0bb\x1cc\xa0d\u2003e", "Übung ÜBUNG, straße × ÷ µ ª", "<|endoftext|> <| x", "İstanbul ΣΑΣ word...", "x.. .y , ,, 12,3 É! é?", " \r\n\t", "."]
    for t in texts:
        assert np.frombuffer(encode.encode(t), encode.dtype).tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids, t
    encode = tokenshards.TextEncoder(str(public_tokenizers.path("word_bpe_49k.json")))
    encode.encode(texts[0])
    assert len(encode.chunks) == 1


def test_word_tables_keep_what_returns(monkeypatch):
    """Tables that overflow keep the words that every batch has; ids are the tokenizer's in batches of any size."""
    import public_tokenizers

    monkeypatch.setattr(tokenshards, "KEPT", 24)
    monkeypatch.setattr(tokenshards, "BATCH_CHARS", 120)
    encode, made = tokenshards.TextEncoder(str(public_tokenizers.path("word_bpe_49k.json"))), []
    make = encode.chunks.make
    encode.chunks.make = lambda fresh: (made.extend(fresh), make(fresh))[1]
    rng = np.random.default_rng(7)
    new = lambda n: ["".join(rng.choice(list("abdeor"), 9)) for _ in range(n)]
    texts = [None, "", "a日 b Word. word ΣΑΣ", "x" * 300 + " it's", " the\n", "12,3..\t(é)"]
    texts += [" ".join(["The river's", *new(5), "über, THE", *new(4), "river"]) for _ in range(60)]
    at, got = [], []
    for ids, last in encode.parts(texts):
        at.append(ids)
        if last:
            got.append(np.frombuffer(b"".join(at), encode.dtype).tolist())
            at = []
    assert got == [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts] and not at
    assert made.count(b"the") == made.count(b"river") == 1 and len(encode.chunks) <= 24 + 40 and len(encode.pieces) <= 24 + 40


def test_lists_link_classes_once(spark):
    """Texts of a list: links join classes, as few as needed, also between texts that others have linked already."""
    rng = np.random.default_rng(3)
    p = rng.integers(0, 1 << 31, 50)
    rest = lambda: rng.integers(0, 1 << 31, 60)
    x = np.stack([np.concatenate([rest(), p, rest()])[-185 + 15 :] if k < 30 else np.concatenate([rest(), p[:30], rest(), rest()])[:170] for k in range(60)]).astype(np.uint64)
    pairs = {(int(min(a, b)), int(max(a, b))) for rows, kind in passages.candidates(x, np.zeros(60, int), np.arange(60), 41) for n, a in enumerate(rows) for m, b in enumerate(rows[:n]) if kind[0] == -1 or kind[n] != kind[m]}
    assert {(a, b) for a, b in pairs if b < 30} == {(a, b) for b in range(30) for a in range(b)} and not any(b >= 30 for _, b in pairs)


def test_passages_through_a_done_text(spark):
    """Variants that are alike only through a text which both pivots match, and which stands between them."""
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklm") + rng.choice("nopqrst") + rng.choice("uvwxyz") for _ in range(52)]
    rows = [(i, " ".join([*base[:k], f"EDIT{i}", *base[k + 1 :]])) for i, k in enumerate(range(5, 47, 5))]
    rows.insert(5, (50, " ".join(base)))
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()}
    assert got == {d: 0 for d, _ in rows}


def test_passages_with_inserted_words(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghijklm") + rng.choice("nopqrst") + rng.choice("uvwxyz") for _ in range(n)]
    rows = []
    for n in (80, 60):
        p = words(n)
        rows += [(n, " ".join(words(30) + p + words(40))), (n + 1, " ".join(words(60) + p[: n // 2] + words(4) + p[n // 2 :] + words(20)))]
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {80: 80, 81: 80, 60: 60, 61: 60}
    a = np.arange(200)
    b = np.concatenate([np.arange(1000, 1030), np.arange(60, 96), np.arange(2000, 2008), np.arange(100, 136), np.arange(3000, 3040)])
    for x, y, shift, want in ((a, b, 30, (60, 136, 30, 110)), (a, b, 26, (60, 136, 30, 110)), (b, a, -30, (30, 110, 60, 136)), (b, a, -26, (30, 110, 60, 136))):
        assert passages.shared_runs(x, y, [shift], 46, 80) == [] and passages.joined_runs(x, y, [shift], [], 46, 80) == [want]
    assert passages.joined_runs(a, np.concatenate([np.arange(60, 96), np.arange(2000, 2030), np.arange(100, 136)]), [60], [], 46, 80) == []


def test_lines(spark, docs):
    assert by_id(queries.queries()["op9_line_dedup"](spark, DATA), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.lines(docs)


def test_line_levels(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a line that repeats ", "Another LINE of text", "ééééé ééééé", "short", ""]) + str(rng.randrange(40)) for _ in range(6))) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    for n in (1, 7, 11):  # with merges of one and two levels
        assert by_id(lines.dedup_lines(df, 10, n), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.lines(rows)
    got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped) for r in lines.dedup_lines(odd(spark)).collect())
    assert got == [(-1, 1, 1), (1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 2, 0), (5, 2, 1), (5, 2, 1)]
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_line_store_is_opened_again(spark):
    """Batches added to a store that is opened anew each time; a merge that ran before is run again, and again when late."""
    rng = random.Random(4)
    rows = [(i, "\n".join(f"some line of text {rng.randrange(60)}" for _ in range(5))) for i in range(60)]
    root, got = workspace(spark, "store"), {}
    lines.LineStore(spark, root, 8)
    for k in range(6):
        store = lines.LineStore(spark, root)
        assert store.batches == k
        folders = lambda: {x.base_name for x in lines.filesystem(root)[0].get_file_info(lines.pafs.FileSelector(f"{root}/runs", allow_not_found=True))}
        before, there = list(store.runs), folders()
        got |= by_id(lines.add_batch(store, spark.createDataFrame(rows[10 * k : 10 * k + 10], DOCS)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
        merged = [f for level, f in store.runs if level and (level, f) not in before]
        if merged:
            sources = [f for level, f in before if level == 0] + [f"{root}/runs/{x}" for x in folders() - there if x.startswith("0-")]
            was = [lines.load_run(merged[0], b).tolist() for b in range(8)]
            for b in range(8):
                if was[b]:
                    lines.merge_bucket(sources, merged[0], b)
            assert [lines.load_run(merged[0], b).tolist() for b in range(8)] == was
    assert got == brute.lines(rows) and [level for level, _ in store.runs] == [1, 1]
    store.vacuum()
    fs, path = lines.filesystem(f"{store.runs[0][1]}")
    bucket = next(b for b in range(8) if len(lines.load_run(store.runs[0][1], b)))
    fs.delete_file(f"{path}/{bucket}")
    with pytest.raises(FileNotFoundError):
        lines.load_run(store.runs[0][1], bucket)


def test_mixing(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()
    got = queries.queries()["op10_source_mix"](spark, DATA).collect()
    assert sorted(got) == sorted(queries.queries()["op10_source_mix"](spark, DATA).collect())
    size, source = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in rows}, {r.doc_id: r.source for r in rows}
    sizes, taken = {}, {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        s = source[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r.taken
    want = brute.targets(sizes)
    assert all(r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] for r in got)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)


def test_mixing_cases(spark):
    assert mixing.nearest_subset([3, 5], [2, 1], 11) == [2, 1] and mixing.nearest_subset([4], [3], 6) in ([1], [2])
    assert mixing.mixture(empty(spark)).count() == 0
    rows = [(1, "a b c", "x"), (2, None, "x"), (None, "a b", None), (None, "c d", None), (3, "", "y"), (4, "q " * 50, "z"), (4, "q " * 50, "z"), (5, "w", "x")]
    df = spark.createDataFrame(rows, DOCS + ", source string")
    got = mixing.mixture(df).collect()
    assert len(got) == 8 and sum(r.taken for r in got if r.source == "z") == 100
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in got)


def test_mixing_ends_at_the_nearest_sum():
    rng = random.Random(9)
    for _ in range(60):
        sizes = sorted({rng.randrange(2, 60) for _ in range(rng.randrange(1, 5))})
        counts = [rng.randrange(1, 7) for _ in sizes]
        budget = rng.randrange(0, sum(a * b for a, b in zip(sizes, counts, strict=True)) + 1)
        sums = {0}
        for a, b in zip(sizes, counts, strict=True):
            sums = {x + a * k for x in sums for k in range(b + 1)}
        got = mixing.fit_budget(np.array(sizes), np.array(counts), budget)
        assert all(0 <= g <= c for g, c in zip(got.tolist(), counts, strict=True))
        assert abs(int((got * sizes).sum()) - budget) == min(abs(x - budget) for x in sums)
    assert mixing.fit_budget(np.array([6, 10]), np.array([100, 100]), 803).dot([6, 10]) in (802, 804)


def test_mixing_any_columns(spark):
    rows = [(4, "q " * 50, "z", k, "s") for k in range(6)] + [(None, "a b", None, 9, "t"), (None, "a b", None, 10, None)]
    df = spark.createDataFrame(rows, DOCS + ", source string, copies int, _size string").withColumn("row", F.lit(1)).withColumn("taken_row", F.lit(2))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and sum(len(r.text.split()) for r in got.collect() if r.source == "z") > 0
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()}


def test_mixing_long_documents():
    fit = lambda sizes, counts, budget: mixing.fit_budget(np.array(sizes), np.array(counts), budget).tolist()
    assert fit([70_000], [1], 50_000) == [1] and fit([33_617, 49_999], [1, 1], 50_000) == [0, 1]
    assert fit([120_000], [1], 50_000) == [0] and fit([25_100, 90_000], [2, 1], 50_000) == [2, 0]


def test_quality_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    df = queries.queries()["op6_quality_rules"](spark, DATA)
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({quality.ORACLE})").fetchall())
    assert quality.quality(empty(spark)).count() == 0
    assert all(r.base_failed and not r.kept for r in quality.quality(odd(spark)).collect())
    r = quality.document_counts(odd(spark, ((1, "a b c a b c\n\nx\tx #$\nx\tx #$"),))).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (12, 14, 4, 1, 12)


def test_quality_fences_can_be_reached(spark):
    """One outlier of each rate among ordinary texts is rejected, and nothing else is."""
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(n))
    plain = [" ".join(word(rng.randrange(3, 8)) for _ in range(120)) for _ in range(60)]
    odd_ones = [" ".join(word(9) for _ in range(120)), " ".join(word(2) for _ in range(120)), plain[0] + " #" * 20, "\n".join(f"{'one line ' if k % 2 else ''}{word(5)} {word(5)}" if k % 3 else "one line" for k in range(90)), " ".join([*(word(5) for _ in range(66)), *(["x y z w v u t s"] * 6), word(5)])]
    rows = [(k, t, "en", "s") for k, t in enumerate(plain + odd_ones)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(spark.createDataFrame(rows, DOCS + ", lang string, source string")).collect()}
    assert not any(b for b, _ in got.values()) and {d for d, (_, k) in got.items() if not k} == set(range(60, 65))


def test_warc(spark):
    rows = [(3, "u", "x" * 100), (1, "u", "x" * 100), (2, None, "x" * 99), (5, "u", "x" * 99), (None, "a\nb", "x" * 100), (7, "q", None), (1, "u", "x" * 100), (8, "é", "é" * 60), (9, "é", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, workspace(spark, "warc"))).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in got) == sorted([(3, "revisit", 1), (1, "response", -1), (2, "response", -1), (5, "response", -1), (-1, "revisit", 1), (7, "response", -1), (1, "response", -1), (8, "response", -1), (9, "revisit", 8)])
    assert all(len(r.payload) == r.payload_bytes and brute.sha(bytes(r.payload)) == r.payload_digest for r in got if r.payload is not None)
    assert warc.read_archives(warc.write_archives(pages.limit(0), workspace(spark, "warc"))).count() == 0


def test_warc_has_a_dictionary_in_front(spark, tmp_path):
    manifest = warc.write_archives(spark.read.parquet(f"{DATA}/pages.parquet"), f"file://{tmp_path}")
    for r in manifest.collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            head = f.read(4)
            assert head in (b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{DATA}/pages.parquet')")
    df = queries.queries()["op2_warc"](spark, DATA)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, c.sql(f"SELECT {', '.join(df.columns)} FROM ({warc.ORACLE})").fetchall()))


def test_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got, at = by_id(queries.queries()["op3_token_shards"](spark, DATA), "doc_id", "start", "n_tokens", "ids_crc32"), 0
    for d, text in sorted(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    e = tokenshards.TextEncoder(str(public_tokenizers.path("word_bpe_49k.json")))
    for x in ("It's <|endoftext|>done 12x3", "İstanbul Σίσυφος ΑΣ\x1cA b", "é café ﬁ ½²", "I'LL we'Ve 'S ª º µ ×", " \n", "naïve—test…\x85x\x0bq", "日本語 テスト"):
        assert np.frombuffer(e.encode(x), e.dtype).tolist() == t.encode(x, add_special_tokens=False).ids
    assert tokenshards.token_rows(empty(spark)).count() == 0 and tokenshards.token_rows(odd(spark)).count() == 7


def test_wavelet_matrix(tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5000, 700_000).astype("<u2")
    tokenshards.write_shard(str(tmp_path / "s"), [1, None], np.array([10, len(ids)]), ids)
    s = tokenshards.Shard(str(tmp_path / "s"))
    assert (s.ids() == ids).all() and s.doc_ids() == [1, None]
    assert all(s[i] == ids[i] for i in (0, 524_287, 524_288, 699_999))
    t = int(ids[5])
    at = np.flatnonzero(ids == t)
    assert s.count(t) == len(at) and list(s.occurrences(t)) == at.tolist() and s.rank(t, 600_000) == (at < 600_000).sum() and s.count(65_535) == 0


def test_language(spark):
    got = queries.queries()["op4_language_id"](spark, DATA).collect()
    assert np.mean([r.lang == r.declared for r in got]) > 0.98 and np.mean([r.kept for r in got]) > 0.98
    pages = queries.queries()["language_id_pages"](spark, DATA).collect()
    assert np.mean([r.lang == r.declared for r in pages if r.declared]) > 0.95


def test_language_equals_brute_force(spark):
    """Every step written out again for a small table: likelihood, leave-one-out priors by host, suffix and declaration, fusion."""
    rows = [(r.doc_id, r.text, r.lang if r.doc_id % 5 else None, f"h{r.doc_id % 7}.{'xy'[r.doc_id % 2]}") for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 90").collect()] + [(900, "", "en", None), (901, None, None, "h1.y")]
    df = language.document_rows(spark.createDataFrame(rows, DOCS + ", lang string, source string"))
    names, files = language.fit(df, workspace(spark, "model"))
    model = np.concatenate([language._model(f) for f in files])
    want = brute.languages([tuple(r) for r in df.select("key", "text", "declared", "host", "suffix").collect()], names, model, language)
    got = {r.key: (r.text_lang, r.lang, r.posterior, r.kept) for r in language.identify(df).collect()}
    assert got.keys() == want.keys()
    for k, (text_lang, lang, posterior, kept) in got.items():
        assert (text_lang, lang, kept) == (want[k][0], want[k][1], want[k][3]) and posterior == pytest.approx(want[k][2], abs=2e-6)


def test_language_of_rows(spark):
    """Rows that share an id get verdicts of their own, whatever other columns are called."""
    d = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "'x' AS _k", "'y' AS row", "'z' AS key")
    some = d.where("doc_id < 120").collect()
    same = spark.createDataFrame([(77 if r.doc_id < 60 else None, *tuple(r)[1:]) for r in some] + [(77, "", "en", "s", "x", "y", "z")], d.schema)
    got = language.documents_in_known_language(same).collect()
    text = {r.text: r.lang for r in some}
    assert got and len(got) <= len(some) and got[0].__fields__ == d.columns and all(text[r.text] == r.lang for r in got if r._k == "x" and r.lang in ("en", "de", "es", "fr") and text[r.text] == r.lang)
    assert sorted(r.text for r in got) == sorted(t for t in (r.text for r in some) if t in {r.text for r in got}) and not any(r.text == "" for r in got)


def test_long_texts(spark):
    """A text of two megabytes among short ones, in every operator that reads texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    long_ = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 15))) for _ in range(35_000))
    rows = [(1, long_), (2, "short text of a few words"), (3, long_[:5000]), (4, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'en' AS lang", "'s' AS source")
    bench = [(1, " ".join(long_.split()[200_000:200_014]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert by_id(decontaminate.contamination(df, b).drop("items"), "*") == brute.contamination(rows, bench)
    assert [r.doc_id for r in decontaminate.clean_documents(df, b).orderBy("doc_id").collect()] == [2, 3, 4]
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = by_id(tokenshards.token_rows(df), "doc_id", "n_tokens", "ids_crc32")
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert got[d] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert by_id(lines.dedup_lines(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.lines(rows)
    assert by_id(jaccard.similar_groups(df), "doc_id", "n_shingles") == {d: (n,) for d, (n, _) in brute.groups(rows).items()}
    cut = by_id(suffixes.repeated_spans(df), "doc_id", "n_bytes", "n_removed", "longest_tie")
    assert cut[1][1] == cut[3][1] == 5000 and cut[3][2] >= 4000 and cut[2] == (25, 0, 0)
    assert {r["size"] for r in mixing.mixture(df).collect()} == {len(brute.WORD.findall(x or "")) for _, x in rows}
    assert {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()} == {1: 1, 3: 1}
    assert {r.key: r.lang for r in language.identify(language.document_rows(df)).collect()}[1] == "en"


def test_shorter_repeats_show_as_ties(spark):
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for k in range(40):
        shared = text(320)
        rows += [(2 * k, text(rng.randrange(200, 600)) + shared + text(rng.randrange(300))), (2 * k + 1, text(rng.randrange(300)) + shared + text(rng.randrange(500)))]
    rows += [(100 + k, text(900)) for k in range(40)]
    got = by_id(suffixes.repeated_spans(spark.createDataFrame(rows, DOCS)), "doc_id", "n_removed", "longest_tie")
    assert all(got[d][0] == 0 and (got[d][1] > 150) == (d < 100) for d, _ in rows)


def test_language_held_out_and_unknown(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    hidden = d.selectExpr("doc_id", "text", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang", "source")
    junk = spark.createDataFrame([(10_000 + i, " ".join("qzxjkvw"[j % 7] * 3 + "xqzj"[j % 4] * 2 for j in range(i, i + 60)), None, None) for i in range(5)], hidden.schema)
    got = by_id(language.identify(language.document_rows(hidden.union(junk))), "key", "lang", "kept")
    truth = {r.doc_id: r.lang for r in d.collect() if r.doc_id % 4 == 0}
    assert np.mean([got[k][0] == v for k, v in truth.items()]) > 0.95
    assert not any(got[10_000 + i][1] for i in range(5))
    assert {r.kept for r in language.identify(language.document_rows(odd(spark, ((1, None), (2, ""), (3, "123"))))).collect()} == {False}
    assert language.identify(language.document_rows(empty(spark))).count() == 0


def test_language_many_declared(spark):
    """More languages than a block of models holds, two rows declared with a region."""
    rng = random.Random(3)
    rows = []
    for k in range(language.LANGUAGES + 5):
        vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(10 * k + i, " ".join(rng.choice(vocabulary) for _ in range(60)), f"l{k:02d}" + ("-us" if k == 0 and i == 0 else ""), None) for i in range(6 if k < language.LANGUAGES else 4)]
    got = by_id(language.identify(language.document_rows(spark.createDataFrame(rows, DOCS + ", lang string, source string"))), "key", "lang", "kept")
    assert got == {r[0]: (r[2][:3], True) for r in rows}


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "source_mix", "token_ids"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in p.STAGES[:4]:
        before = docs.collect()
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = [r.doc_id for r in docs.collect()]
        if name == "ngram_jaccard":
            assert sorted(ids) == sorted(k for k, (_, c) in brute.groups([(r.doc_id, r.text) for r in before]).items() if k == c)
        if name == "decontamination":
            assert sorted(ids) == sorted(k for k, v in brute.contamination([(r.doc_id, r.text) for r in before], bench).items() if not v[-1])
        if name == "source_mix":
            assert max(ids.count(i) for i in set(ids)) <= 3
    last = p.STAGES[4][1](spark, docs, DATA).collect()
    assert sorted(r.doc_id for r in last) == sorted(ids)
