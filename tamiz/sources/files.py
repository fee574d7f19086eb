"""Files as tables: a folder's Parquet, CSV, TSV, JSON and spreadsheets, each read on its own risk."""

from __future__ import annotations

import csv
import hashlib
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tamiz.sources import spreadsheet

EXTENSIONS = (".csv", ".tsv", ".parquet", ".json", ".jsonl", ".xlsx")
IGNORED = {"expected.json"}
MOST_BYTES = 2 << 30


@dataclass
class Source:
    id: str
    name: str
    df: DataFrame | None
    rows: int = 0
    sheet: str | None = None
    content_hash: str | None = None
    header_row: int = 1
    discarded: list = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    origin: str = "file"


def source_id(file_name: str, suffix: str = "") -> str:
    base = re.sub(r"[^A-Za-z0-9]", "_", os.path.splitext(file_name)[0])[:40]
    return f"src_{base}{suffix}_{hashlib.sha1((file_name + suffix).encode()).hexdigest()[:6]}"


def sheet_suffix(sheet: str) -> str:
    return "_" + re.sub(r"[^A-Za-z0-9]", "_", sheet)[:20]


def accepted_upload(name: str, size: int) -> str:
    """Cleaned file name of an upload, or ValueError."""
    clean = re.sub(r"[^\w.\- ]", "_", os.path.basename(name.replace("\\", "/")))
    if not clean.lower().endswith(EXTENSIONS) or size > MOST_BYTES:
        raise ValueError(f"{clean}: not an accepted file")
    return clean


def content_hash(path: str) -> str | None:
    if os.path.isdir(path):
        return None
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()[:16]


def sniffed(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        head = f.read(1 << 16)
    try:
        return csv.Sniffer().sniff(head, ",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep or sniffed(path), quote='"', escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects or one object a line; a file without a readable record is an error."""
    with open(path, encoding="utf-8", errors="replace") as f:
        array = f.read(4096).lstrip()[:1] == "["
    df = spark.read.json(path, multiLine=array)
    if not [c for c in df.columns if c != "_corrupt_record"]:
        raise ValueError("not valid JSON")
    return df


def read_file(spark: SparkSession, path: str) -> DataFrame:
    kind = os.path.splitext(path)[1].lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    return read_json(spark, path) if kind in (".json", ".jsonl") else read_csv(spark, path)


def read_folder(spark: SparkSession, folder: str) -> list[Source]:
    """All tables of a folder, by file name; a file that can't be read is a source without rows."""
    out = []
    for name in sorted(n for n in os.listdir(folder) if n.lower().endswith(EXTENSIONS) and n not in IGNORED):
        path = os.path.join(folder, name)
        try:
            if name.lower().endswith(".xlsx"):
                sheets = spreadsheet.read_workbook(path)
                if not sheets:
                    raise ValueError("no sheet holds a table")
                for s in sheets:
                    df = spreadsheet.to_dataframe(spark, s)
                    suffix = sheet_suffix(s.name)
                    out.append(Source(source_id(name, suffix), name, df, len(s.rows), s.name, content_hash(path), s.header_row, s.discarded, s.warnings))
            else:
                df = read_file(spark, path)
                out.append(Source(source_id(name), name, df, df.count(), content_hash=content_hash(path)))
        except Exception as e:  # one bad file must not stop the others
            out.append(Source(source_id(name, "_err"), name, None, warnings=[f"could not be read: {str(e)[:300]}"]))
    return out


def register(sources: list[Source]) -> None:
    for s in sources:
        if s.df is not None:
            s.df.createOrReplaceTempView(s.id)
