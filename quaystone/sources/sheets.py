"""Spreadsheet and CSV files to records, and results to files.

CSV is read in splits; one XLSX file is one task, which reads its parts as a
stream.  The header row is found among a sheet's first rows, in a task,
and joined back to its rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import layout
from .csvsplits import read_csv as read_csv
from .workbooks import shared_strings, sheet_rows, sheets_of

HEAD_ROWS = 30
#: Cells that a spreadsheet shows where a formula failed (fixed values).
FORMULA_ERRORS = ("#VALUE!", "#REF!", "#DIV/0!", "#N/A", "#NAME?", "#NUM!", "#NULL!")

CELLS = "file string, sheet string, row_index int, cells array<string>"


def xlsx_rows(content: bytes):
    """(sheet, row number, cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = shared_strings(z)
        for name, part in sheets_of(z):
            with z.open(part) as f:
                for number, cells in sheet_rows(f, strings):
                    yield name, number, cells


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of workbooks: (file, sheet, row_index, cells), each read through Spark by one task (``workbooks`` has a task a sheet)."""

    def run(frames):
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for sheet, number, cells in xlsx_rows(content):
                    rows.append((file, sheet, number, cells))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=["file", "sheet", "row_index", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "sheet", "row_index", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def valid_signature(content: bytes, name: str) -> bool:
    """Whether a file's bytes fit its name: a zip with a workbook and without macros for xlsx, no NUL at the beginning of a csv."""
    name = name.lower()
    if name.endswith(".xlsx"):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                entries = [e.lower() for e in z.namelist()]
        except zipfile.BadZipFile:
            return False
        return content[:2] == b"PK" and "xl/workbook.xml" in entries and not any(e.endswith("vbaproject.bin") for e in entries)
    return name.endswith(".csv") and b"\0" not in content[:8192]


def valid_upload(name: str, mime: str, size: int, most: int = 64 << 20) -> list[str]:
    """What is wrong with an upload's name, type or size."""
    out = []
    if not re.search(r"\.(csv|xlsx)$", name, re.IGNORECASE):
        out.append("extension")
    if mime not in ("text/csv", "application/csv", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/octet-stream"):
        out.append("type")
    if not 0 < size <= most:
        out.append("size")
    return out


PROFILE = "header_row int, confidence double, names array<string>, fields map<string,int>, parts array<int>, category string, category_confidence double"


def profile(cells: DataFrame) -> DataFrame:
    """(file, sheet, ``PROFILE``): each sheet's header, mapping and category, from its first rows.

    At most ``HEAD_ROWS`` rows of a sheet come together, in a task; nothing comes to the driver.
    """
    place = F.row_number().over(Window.partitionBy("file", "sheet").orderBy("row_index"))
    heads = cells.withColumn("place", place).filter(F.col("place") <= HEAD_ROWS).groupBy("file", "sheet").agg(F.array_sort(F.collect_list(F.struct("row_index", "cells"))).alias("rows"))

    @F.arrow_udf(PROFILE)
    def read(sheets: pa.Array) -> pa.Array:
        out = []
        for rows in sheets.to_pylist():
            at, sure = layout.find_header([r["cells"] for r in rows])
            names = layout.unique_names(rows[at]["cells"])
            fields = layout.map_fields(names)
            kind, kind_sure = layout.category(names, fields)
            out.append({"header_row": rows[at]["row_index"], "confidence": sure, "names": names, "fields": list(fields.items()), "parts": layout.part_columns(names), "category": kind, "category_confidence": kind_sure})
        texts = pa.list_(pa.string())
        return pa.array(out, pa.struct([("header_row", pa.int32()), ("confidence", pa.float64()), ("names", texts), ("fields", pa.map_(pa.string(), pa.int32())), ("parts", pa.list_(pa.int32())), ("category", pa.string()), ("category_confidence", pa.float64())]))

    return heads.select("file", "sheet", read("rows").alias("p")).select("file", "sheet", "p.*")


def _field(name: str, cell: Column) -> tuple[Column, Column]:
    """A field's value and the issue its cell has."""
    bad_formula = F.upper(F.trim(cell)).isin(*FORMULA_ERRORS)
    clean = F.when(~F.coalesce(bad_formula, F.lit(False)), cell)
    filled = F.nullif(F.trim(clean), F.lit("")).isNotNull()
    issue = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(name).alias("column"), cell.alias("raw")))
    formula = issue(bad_formula, "formula_error", "high")
    if name == "gp_rate":
        number = S.parse_number(clean)
        return S.gp_rate(number), F.coalesce(formula, issue(filled & number.isNull(), "invalid_number", "medium"), issue(S.gp_rate_warns(number), "margin_out_of_range", "low"))
    if name in layout.NUMERIC:
        number = S.parse_number(clean)
        return number, F.coalesce(formula, issue(filled & number.isNull(), "invalid_number", "medium"))
    if name in layout.DATES:
        day = S.parse_date(F.trim(clean))
        return day, F.coalesce(formula, issue(filled & day.isNull(), "invalid_date", "medium"))
    return S.sanitize_scalar(clean), formula


def ingest(cells: DataFrame, selected: str = "Auto Detect") -> DataFrame:
    """All sheets of the files as one table of typed records with issues, in one scan.

    Each row meets its sheet's profile, which says in which cell every field is.
    """
    p = profile(cells).withColumnsRenamed({"file": "its_file", "sheet": "its_sheet"})
    rows = cells.join(p, (cells["file"] == p["its_file"]) & (cells["sheet"] == p["its_sheet"])).filter("row_index > header_row")
    cell = lambda at: F.get("cells", at)
    fields = {name: _field(name, cell(F.col("fields")[name])) for name in layout.FIELD_ALIASES}
    issues = F.filter(F.array(*[issue for _, issue in fields.values()]), lambda x: x.isNotNull())
    raw = F.map_from_arrays("names", F.transform("names", lambda _, i: S.sanitize_scalar(cell(i))))
    kind = F.col("category") if selected in ("", "Auto Detect") else F.lit(layout.chosen_category(selected, ""))
    out = S.settled(rows, "file", "sheet", "row_index", kind.alias("category"), raw.alias("raw_data"), *[value.alias(name) for name, (value, _) in fields.items()], issues.alias("issues"), F.transform("parts", lambda i: F.when(~F.upper(F.trim(cell(i))).isin(*FORMULA_ERRORS), S.sanitize_scalar(cell(i)))).alias("__parts"))
    text = F.lower(F.concat_ws(" ", "category", F.array_join(F.map_values("raw_data"), " "), *[F.col(name).cast("string") for name in layout.FIELD_ALIASES]))
    other = F.get(F.filter("__parts", lambda c: c.isNotNull()), F.lit(0))
    return out.withColumn("mpn", F.coalesce("mpn", "mpn_quoted", other)).withColumn("searchable_text", text).withColumn("has_errors", F.size("issues") > 0).drop("__parts")


# ---- sinks


def ingest_key(*parts: str) -> str:
    """A key that is equal for equal inputs and versions."""
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()


def replace_batch(df: DataFrame, path: str, by: str = "upload_batch_id") -> None:
    """Write records, replacing those of the same batches: repeating an import changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """All cells quoted, lines ending in CR LF; with ``bom``, every file begins with a byte order mark, as spreadsheets like it."""
    if not bom:
        df.write.mode("overwrite").csv(path, header=True, quoteAll=True, lineSep="\r\n", escape='"')
        return
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    head = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines = df.select(F.concat_ws(",", *[quoted(F.col(f"`{c}`").cast("string")) for c in df.columns]).alias("value"))
    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path, lineSep="\r\n")


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; ``kept`` columns stay as they were."""
    was = old.select(F.col(key).alias("its_key"), *[F.col(c).alias(f"was_{c}") for c in kept])
    fresh = new.join(was, new[key] == was["its_key"], "left").select(*[F.coalesce(f"was_{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns])
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def write_json_store(parts: dict[str, DataFrame], path: str) -> None:
    """Write named lists as a store: a folder of JSON lines each, so that no list is one task's."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_json_store(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One list of a store, or of a single JSON document of lists."""
    try:
        return spark.read.json(f"{path.rstrip('/')}/{part}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.read.json(path, multiLine=True).select(F.explode(part).alias("x")).select("x.*")
