"""Artifact to documents: order of findings, HTML, Word, and the diagram of sources."""

from __future__ import annotations

import io
import json
import math
import zipfile
from html import escape

SEVERITY = {"critical": 3, "warning": 2, "info": 1}
LEVEL = {"high": 3, "medium": 2, "low": 1}


def priority(f: dict) -> float:
    r = f.get("remediation") or {}
    return 10 * SEVERITY[f["severity"]] + LEVEL[r.get("impact", "low")] / LEVEL[r.get("effort", "medium")]


def prioritised(findings: list[dict]) -> list[dict]:
    return sorted(findings, key=lambda f: -priority(f))


def reportable(relationships: list[dict]) -> list[dict]:
    return sorted((r for r in relationships if r["userDecision"] != "rejected" and r["confidence"] != "low" and r["classification"] != "domain_coincidence"), key=lambda r: -r["score"])


def executive(findings: list[dict]) -> list[dict]:
    return [f for f in prioritised(findings) if f["severity"] != "info"][:5]


def er_svg(report: dict, width: int = 900, height: int = 480) -> str:
    """Sources on an ellipse; confirmed relationships solid, others dashed; red where a critical finding begins."""
    shown = [s for s in report["sources"] if s["rowCount"]]
    red = {f["sourceIds"][0] for f in report["findings"] if f["severity"] == "critical" and f["sourceIds"]}
    at = {s["id"]: (width / 2 + (width / 2 - 110) * math.cos(2 * math.pi * i / len(shown)), height / 2 + (height / 2 - 50) * math.sin(2 * math.pi * i / len(shown))) for i, s in enumerate(shown)}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img">']
    for r in reportable(report["relationships"]):
        if r["leftSourceId"] in at and r["rightSourceId"] in at:
            (x, y), (u, v) = at[r["leftSourceId"]], at[r["rightSourceId"]]
            dash = "" if r["userDecision"] == "confirmed" or r["status"] == "declared" else ' stroke-dasharray="6 4"'
            out.append(f'<line x1="{x:.0f}" y1="{y:.0f}" x2="{u:.0f}" y2="{v:.0f}" stroke="#667"{dash}/>')
    for s in shown:
        x, y = at[s["id"]]
        out.append(f'<rect x="{x - 90:.0f}" y="{y - 20:.0f}" width="180" height="40" rx="6" fill="#fff" stroke="{"#c00" if s["id"] in red else "#345"}"/><text x="{x:.0f}" y="{y + 5:.0f}" text-anchor="middle" font-size="13">{escape(s["name"][:24])}</text>')
    return "".join([*out, "</svg>"])


def _sections(report: dict) -> list[tuple[str, list[list]]]:
    pct = lambda x: f"{100 * x:.0f} %"
    return [
        ("1. What matters most", [["Severity", "Finding", "Rows"], *([f["severity"], f["title"], f["affectedRows"]] for f in executive(report["findings"]))]),
        ("2. Sources", [["Source", "Rows", "Notes"], *([s["name"], s["rowCount"], "; ".join(s["warnings"])] for s in report["sources"])]),
        ("3. Relationships", [["From", "To", "Kind", "Score", "Matched"], *([f"{r['leftSourceId']}.{r['leftColumns'][0]}", f"{r['rightSourceId']}.{r['rightColumns'][0]}", r["classification"], f"{r['score']:.2f}", pct(r["coverage"])] for r in reportable(report["relationships"]))]),
        ("4. Findings", [["Severity", "Category", "Finding", "Rows"], *([f["severity"], f["category"], f["title"], f["affectedRows"]] for f in prioritised(report["findings"]))]),
        ("5. Joins", [["Left", "Right", "Rows expected", "Matched", "Times"], *([j["leftSourceId"], j["rightSourceId"], j["expectedRows"]["left"]["value"], pct(j["matchRate"]["leftInRight"]), j["fanOut"]["multiplier"]] for j in report["joinPredictions"])]),
        ("6. Bridge tables", [["Table", "Kind", "Rows"], *([b["proposedTableName"], b["kind"], b["resultMetrics"]["rows"]] for b in report["bridgeProposals"])]),
        ("Annex A. Columns", [["Source", "Column", "Meaning", "Distinct", "Nulls"], *([p["sourceId"], p["name"], p["semanticType"], p["distinctCount"], p["nullCount"]] for p in report["profiles"])]),
    ]


def _evidence(report: dict, most: int) -> list[list]:
    return [["Statement", "Query", "Result"], *([e["label"], e["sql"], json.dumps(e["result"], default=str, ensure_ascii=False)[:most]] for kind in ("relationships", "findings", "joinPredictions", "bridgeProposals") for x in report[kind] for e in x["evidence"])]


def html(report: dict) -> str:
    table = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<{t}>{escape(str(c))}</{t}>" for c in r) + "</tr>" for i, r in enumerate(rows) for t in ["th" if i == 0 else "td"]) + "</table>"
    indicators = [["Indicator", "Query"], *([i["title"], i["sql"]] for j in report["joinPredictions"] for i in j["indicators"])][:13]
    parts = [*_sections(report), ("Annex B. Evidence", _evidence(report, 600)), ("Annex C. Indicators", indicators)]
    body = "".join(f"<section><h2>{escape(t)}</h2>{table(rows)}</section>" for t, rows in parts)
    css = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px;text-align:left}@page{size:A4;margin:15mm}@media print{section{break-inside:avoid}}"
    return f'<!doctype html><html lang="{escape(report["locale"])}"><head><meta charset="utf-8"><title>Data diagnosis</title><style>{css}</style></head><body><h1>Data diagnosis</h1>{er_svg(report) if report["sources"] else ""}{body}</body></html>'


def docx(report: dict) -> bytes:
    cell = lambda c: f'<w:tc><w:p><w:r><w:t xml:space="preserve">{escape("".join(x for x in str(c) if x >= " " or x in chr(9) + chr(10)))}</w:t></w:r></w:p></w:tc>'
    para = lambda t: f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{escape(t)}</w:t></w:r></w:p>"
    table = lambda rows: '<w:tbl><w:tblPr><w:tblBorders><w:insideH w:val="single" w:sz="4"/><w:insideV w:val="single" w:sz="4"/></w:tblBorders></w:tblPr>' + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"
    parts = [*(s for s in _sections(report) if not s[0].startswith("5.")), ("Annex B. Evidence", _evidence(report, 400))]
    body = para("Data diagnosis") + "".join(para(t) + table(rows) for t, rows in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
