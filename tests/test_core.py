import io
import random
import zipfile
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tamiz import catalogue
from tamiz.functions import names, semantic
from tamiz.operators.joins import export_csv, left_join, routes
from tamiz.operators.profile import frequencies, profile
from tamiz.operators.scoring import cardinality, classify, score
from tamiz.plans import analysis, report
from tamiz.sources import files, jdbc, spreadsheet

DATA = "/root/testdata/sf0.001"


def same(x):
    return "NULL" if x is None else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = oracle.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    assert sorted(tuple(map(same, r)) for r in got) == sorted(tuple(map(same, r)) for r in want)


def test_rounding_as_sql(spark, oracle, tmp_path):
    """Means and ratios that end in a half are rounded as SQL does; a table without rows has none."""
    for x, places in ((25.40225, 4), (-25.40225, 4), (0.0078125, 6), (1.00005, 4), (2.5, 0), (0.49999999999999994, 0), (1e300, 6)):
        assert catalogue._rounded(x, places) == oracle.sql(f"SELECT ROUND({x!r}::DOUBLE, {places})").fetchall()[0][0]
    sql = "SELECT CASE WHEN i < 161 THEN 26.0 ELSE 25.0 END AS l_quantity, i / 128 AS l_extendedprice, -i / 128 AS l_discount, i AS l_partkey FROM range(400) t(i)"
    duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/lineitem.parquet'")
    want = duckdb.connect()
    want.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert sorted(map(tuple, catalogue.mean_median_p95(spark, str(tmp_path)).collect())) == sorted(want.sql(catalogue.oracle_sql()["mean_median_p95"]).fetchall())
    duckdb.sql(f"COPY ({sql} LIMIT 0) TO '{tmp_path}/lineitem.parquet'")
    assert {tuple(r)[1:] for r in catalogue.mean_median_p95(spark, str(tmp_path)).collect()} == {(None, None, None)}


def test_lengths_need_no_frequencies(spark, oracle, monkeypatch):
    """Long texts are neither normalised nor grouped to tell their lengths."""
    monkeypatch.setattr(catalogue, "frequencies", lambda df: pytest.fail("frequencies of whole texts"))
    got = sorted(map(tuple, catalogue.text_lengths(spark, DATA).select("source", "shortest", "longest", "mean").collect()))
    assert got == sorted(oracle.sql(catalogue.oracle_sql()["text_lengths"]).fetchall())


def test_names():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-3)
    assert names.name_similarity("idProyecto", "proyecto_id") == 1.0
    assert names.name_similarity("l_orderkey", "o_orderkey") > 0.9
    groups = names.cluster_variants([("San José", 9), ("SAN JOSE", 4), ("S. José", 2), ("Bogotá", 5), ("Bogota D.C.", 1), ("Bogotá DC", 1)])
    assert sorted(len(g) for g in groups)[-1] >= 3


def test_scores():
    good = score(1, 0.926, 1, 1)
    assert good["score"] == pytest.approx(0.984, abs=1e-3) and good["confidence"] == "high"
    assert score(1, 0.3, 0.4, 0.5)["confidence"] != "high"
    assert score(1, 1, 1, 1, parent_distinct=5, parent_is_key=False)["confidence"] != "high"
    assert [classify(x) for x in (0.99, 0.8, 0.5, 0.1)] == ["solid", "broken_integrity", "partial", None]
    assert classify(0.9, True) == "domain_coincidence"
    assert cardinality(0.2, 1.0) == "N:1"


def test_meanings():
    m = lambda name, top, **k: semantic.infer(name, k.get("group", "text"), False, False, top, k.get("distinct", 50), k.get("rows", 100), 10, k.get("uniqueness", 0.5))
    assert m("correo", [("a@b.co", 5)]).personal
    assert m("fecha_pago", [("2024-01-02", 5), ("13/01/2024", 5)]).risks == ["mixed_formats"]
    assert m("activo", [("si", 3), ("no", 2)], distinct=2).kind == "boolean_coded"
    assert m("valor_total", [("1", 1)], group="numeric").kind == "currency"
    assert m("id_proyecto", [("P-0001", 1)], uniqueness=1.0).kind == "identifier"


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """A folder with planted defects: orphans, spellings, embedded lists, broken totals, ghosts, copies, and a bad file."""
    d, rng = tmp_path_factory.mktemp("planted"), random.Random(7)
    spell = [["San José", "SAN JOSE", "San Jose ", "S. José", "San  José"], ["Puerto Rico", "PUERTO RICO", "Pto Rico", "puerto rico", "Puerto-Rico"], ["La Unión", "LA UNION", "La Union", "la unión", "La  Unión"]]
    rows = {
        "proyectos.csv": ["id_proyecto,nombre,municipio", *(f"P-{i:04d},Proyecto {i},{spell[i % 3][i // 3 % 5]}" for i in range(1, 61))],
        "actividades.csv": ["id_actividad,proyecto,sectores,entidad_nit,entidad_nombre,observaciones_2", *(f'A-{i:04d},{rng.randint(1, 60)},"{", ".join(rng.sample(["Salud", "Agua", "Vías", "Escuela", "Campo"], 2))}",{i % 3}00123,Entidad {"ABC"[i % 3]},{"x" if i == 1 else ""}' for i in range(1, 401))],
        "pagos.csv": ["id_pago,proyecto,cantidad,valor_unitario,valor_total", *(f"G-{i:05d},{900 + i % 9 if i <= 312 else rng.randint(1, 60)},{(q := rng.randint(1, 9))},{(v := rng.randint(100, 999))},{q * v + (5 if 400 < i <= 414 else 0)}" for i in range(1, 3001))],
    }
    for name, lines in rows.items():
        (d / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    (d / "roto.json").write_text("{not json")
    return d


def test_planted_defects(spark, planted):
    said = []
    r = analysis.analyze(spark, str(planted), say=said.append)
    assert [s["status"] for s in r["stages"]] == ["done"] * 7
    assert any("could not be read" in w for s in r["sources"] for w in s["warnings"])
    kinds = {f["category"]: f for f in r["findings"]}
    assert kinds["mirror_column"]["affectedRows"] == 14
    assert "ghost_column" in kinds and "redundant_copy" in kinds and "near_duplicates" in kinds
    to_projects = {x["leftSourceId"]: x for x in r["relationships"] if x["rightColumns"] == ["id_proyecto"]}
    paid = next(x for k, x in to_projects.items() if "pagos" in k)
    assert paid["normalizations"] == ["digits"] and paid["orphans"] == 312
    assert any(b["kind"] == "embedded_list" and b["resultMetrics"]["distinctRight"] == 5 for b in r["bridgeProposals"])
    assert analysis.validate(r) and "<h1>" in report.html(r) and zipfile.ZipFile(io.BytesIO(report.docx(r))).namelist()
    b = next(b for b in r["bridgeProposals"] if b["kind"] == "embedded_list")
    assert analysis.execute_bridge(spark, r, b["id"], "an activity's sector").count() == 800
    j = r["joinPredictions"][0]
    assert analysis.execute_join(spark, r, j["id"]).count() == j["expectedRows"]["left"]["value"]
    analysis.decide(r, paid["id"], "rejected")
    assert paid not in report.reportable(r["relationships"])
    assert said[0] == "ingest"


def test_contract_is_checked():
    good = {k: [] for k in analysis.LISTS}
    with pytest.raises(ValueError, match="no evidence"):
        analysis.validate(good | {"findings": [{"id": "f", "evidence": []}]})


def test_csv_export_and_join_names(spark, tmp_path):
    a = spark.createDataFrame([(1, "=cmd"), (2, "-5"), (3, None)], "id int, note string")
    assert export_csv(a, str(tmp_path / "out")) == 3
    assert {r[1] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {"'=cmd", "-5", None}
    assert left_join(a, a, "id", "id").columns == ["id", "note", "id_right", "note_right"]


def test_routes_take_the_best_path():
    e = lambda a, b, s: {"leftSourceId": a, "rightSourceId": b, "score": s, "confidence": "high", "userDecision": "pending"}
    got = routes([e("a", "b", 0.9), e("b", "c", 0.9), e("a", "d", 0.5), e("d", "c", 0.5)])
    assert got[0]["via"] == ["a", "b", "c"] and got[0]["score"] == pytest.approx(0.81)


def test_sheet_under_titles_and_over_totals():
    cells = [["Informe 2024", "", ""], ["", "", ""], ["trimestre", "municipio", "valor"], ["T1", "A", "10"], ["T2", "B", "20"], ["TOTAL", "", "30"]]
    s = spreadsheet.interpret("h", cells, 1)
    assert (s.header_row, s.header, len(s.rows), s.discarded) == (3, ["trimestre", "municipio", "valor"], 2, [1, 2, 6])
    assert spreadsheet.interpret("x", [["only"]]) is None


def test_workbook(spark, tmp_path):
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, c, v: f'<c r="{c}{r}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [["Titulo"], ["mes", "valor"], ["enero", 5], ["febrero", 7], ["Total", 12]]
    body = "".join(f'<row r="{i}">{"".join(cell(i, c, v) for c, v in zip("AB", r, strict=False))}</row>' for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(tmp_path / "h.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {n} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Hoja" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {n}><sheetData>{body}</sheetData></worksheet>")
    (s,) = files.read_folder(spark, str(tmp_path))
    assert (s.rows, s.header_row, s.df.columns) == (2, 2, ["mes", "valor"]) and s.df.agg({"valor": "sum"}).first()[0] == 12
    spark.dataSource.register(spreadsheet.SpreadsheetSource)
    assert spark.read.format("human_xlsx").load(str(tmp_path / "h.xlsx")).count() == 2


def test_database_reader_with_a_stub(spark):
    tables = {"a": spark.range(50), "b": None}

    def load(o):
        if "query" in o:
            return spark.createDataFrame([(t,) for t in tables], "table_name string")
        name = o["dbtable"].split(".")[1]
        if tables[name] is None:
            raise RuntimeError("refused for user me with secret at host.example")
        return tables[name]

    got = jdbc.read_database(spark, "postgres", "host.example", "db", "me", "secret", sample_rows=10, load=load)
    assert got[0].df.count() == 10 and got[0].df.collect() == got[0].df.collect()
    assert got[1].df is None and "secret" not in got[1].warnings[0] and "host.example" not in got[1].warnings[0]


def test_upload_names():
    assert files.accepted_upload("../x/da ta.csv", 5) == "da ta.csv"
    with pytest.raises(ValueError):
        files.accepted_upload("x.exe", 5)


def test_personal_values_stay_hidden(spark):
    df = spark.createDataFrame([(f"persona{i}@correo.example",) for i in range(30)], "correo string")
    shown = profile("s", df, frequencies(df))[0].published()
    assert shown["isPersonalData"] and shown["min"] is None and "persona" not in str(shown)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
