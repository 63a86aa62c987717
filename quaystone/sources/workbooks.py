"""Workbooks as a data source of Spark: ``spark.read.format("xlsx")`` and ``df.write.format("xlsx")``.

Reading: a partition is one sheet of one workbook.  The driver lists files and
reads each one's directory of sheets, which are a few parts at its end; a task
then reads its sheet's part (and the shared strings) as a stream.

Writing: each task writes its rows as a workbook of its own under a temporary
name, and commit renames those of the tasks that count; abort removes them.
``coalesce(1)`` gives one workbook.  A sheet that is full goes on in another.

Paths are anything that Arrow's file systems open (local files, HDFS, S3,
GCS), a file, a folder or a pattern in the last part.  For stores that only
Spark opens, ``sheets.read_xlsx`` reads whole workbooks through Spark.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

CELLS = "file string, sheet string, row_index int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of one Arrow batch.
BATCH = 5000
#: Rows of a sheet (a fixed value of the format).
SHEET_ROWS = 1_048_576


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if re.match(r"[a-z0-9+]+:", path) else f"file://{path}")


def _uri(path: str, of: str) -> str:
    """A path of ``of``'s file system as a URI like it."""
    head = re.match(r"([a-z0-9+]+:)(//[^/]*)?", of)
    if not head or head[1] == "file:":
        return f"file://{path}"
    return f"{head[1]}//{path}" if head[1] in ("s3:", "gs:") else f"{head[1]}{head[2] or ''}{path}"


def found_files(path: str) -> list[str]:
    """URIs of the workbooks of a path."""
    fs, inner = _opened(path)
    folder, last = inner.rsplit("/", 1) if "/" in inner else ("", inner)
    if re.search(r"[*?\[]", last):
        infos = [i for i in fs.get_file_info(arrow_fs.FileSelector(folder)) if fnmatch.fnmatch(i.base_name, last)]
    elif fs.get_file_info(inner).type == arrow_fs.FileType.Directory:
        infos = fs.get_file_info(arrow_fs.FileSelector(inner))
    else:
        infos = [fs.get_file_info(inner)]
        if infos[0].type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(path)
    return sorted(_uri(i.path, path) for i in infos if i.type == arrow_fs.FileType.File and i.base_name.lower().endswith(".xlsx") and not i.base_name.startswith(("_", ".", "~")))


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet of a workbook, in order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
        target = links[sheet.get(_LINK)].lstrip("/")
        out.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as part:
            for _, e in ElementTree.iterparse(part):
                if e.tag == _MAIN + "si":
                    out.append("".join(t.text or "" for t in e.iter(_MAIN + "t")))
                    e.clear()
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(part, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet's part, blank rows left out; formulas give what they were last computed to."""
    for _, e in ElementTree.iterparse(part):
        if e.tag != _MAIN + "row":
            continue
        cells: list[str | None] = []
        for i, c in enumerate(e.iter(_MAIN + "c")):
            at = _column(c.get("r")) if c.get("r") else i
            cells += [None] * (at + 1 - len(cells))
            v = c.find(_MAIN + "v")
            if c.get("t") == "s" and v is not None:
                cells[at] = strings[int(v.text)]
            elif c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
            elif v is not None:
                cells[at] = {"1": "TRUE", "0": "FALSE"}.get(v.text) if c.get("t") == "b" else v.text
        if any(c and c.strip() for c in cells):
            yield int(e.get("r") or 0), cells
        e.clear()


@dataclass
class SheetPartition(InputPartition):
    file: str
    sheet: str
    part: str


class XlsxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[SheetPartition]:
        out = []
        for file in found_files(self.path):
            fs, inner = _opened(file)
            with fs.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                out += [SheetPartition(file, name, part) for name, part in sheets_of(z)]
        return out

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, SheetPartition):  # there are no sheets
            return
        fs, inner = _opened(partition.file)
        with fs.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            strings = shared_strings(z)
            with z.open(partition.part) as part:
                rows: list = []
                for row in sheet_rows(part, strings):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield self._batch(partition, rows)
                        rows = []
                if rows:
                    yield self._batch(partition, rows)

    @staticmethod
    def _batch(p: SheetPartition, rows: list) -> pa.RecordBatch:
        texts = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([p.file] * len(rows)), pa.array([p.sheet] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], texts)], ["file", "sheet", "row_index", "cells"])


# ---- writing

_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Styles: plain, header (bold white on a colour, centred), wrapped, percent.
_STYLES = """{head}<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="164" formatCode="0.00&quot;%&quot;"/></numFmts>
<fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts>
<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF{color}"/></patternFill></fill></fills>
<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="4"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>"""


def column_letters(n: int) -> str:
    """The letters of a column, counted from 1."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class Workbook:
    """A workbook written to a stream, a row at a time: the first row is a header that stays in sight and filters."""

    def __init__(self, out, names: list[str], sheet: str = "Sheet1", widths: list[float] | None = None, wrapped: set[str] | None = None, percents: set[str] | None = None, color: str = "0F766E", full: int = SHEET_ROWS):
        self.z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.names, self.sheet, self.widths, self.color, self.full = names, sheet, widths or [], color, full
        self.styles = [2 if n in (wrapped or ()) else 3 if n in (percents or ()) else 0 for n in names]
        self.sheets, self.row, self.part = 0, 0, None

    def _begin(self) -> None:
        self._end()
        self.sheets, self.row = self.sheets + 1, 0
        self.part = self.z.open(f"xl/worksheets/sheet{self.sheets}.xml", "w", force_zip64=True)
        cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(self.widths[: len(self.names)], 1))
        self._put(f'{_HEAD}<worksheet {_NS}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>{f"<cols>{cols}</cols>" if cols else ""}<sheetData>')
        self._write(self.names, [1] * len(self.names), 30)

    def _put(self, text: str) -> None:
        self.part.write(text.encode())

    def _end(self) -> None:
        if self.part:
            self._put(f'</sheetData><autoFilter ref="A1:{column_letters(len(self.names))}{self.row}"/></worksheet>')
            self.part.close()
            self.part = None

    def _write(self, values, styles: list[int], height: int) -> None:
        self.row += 1
        cells = []
        for i, (v, style) in enumerate(zip(values, styles), 1):
            if v is None:
                continue
            at = f'<c r="{column_letters(i)}{self.row}"' + (f' s="{style}"' if style else "")
            if isinstance(v, bool):
                cells.append(f'{at} t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float, Decimal)) and v == v and v not in (float("inf"), float("-inf")):
                cells.append(f"{at}><v>{v!r}</v></c>" if not isinstance(v, Decimal) else f"{at}><v>{v}</v></c>")
            else:
                text = v.isoformat() if isinstance(v, (date, datetime)) else "; ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
                cells.append(f'{at} t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", text))}</t></is></c>')
        self._put(f'<row r="{self.row}" ht="{height}" customHeight="1">{"".join(cells)}</row>')

    def add(self, values) -> None:
        if self.part is None or self.row >= self.full:
            self._begin()
        self._write(values, self.styles, 36)

    def close(self) -> None:
        if not self.sheets:
            self._begin()
        self._end()
        numbers = range(1, self.sheets + 1)
        kind, rel = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        name = lambda i: escape(self.sheet[:24] + (f" ({i})" if i > 1 else ""), {'"': "&quot;"})
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook {_NS} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{name(i)}" sheetId="{i}" r:id="rId{i}"/>' for i in numbers) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + f'<Relationship Id="rId{self.sheets + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        }
        for path, text in parts.items():
            self.z.writestr(path, _HEAD + text)
        self.z.writestr("xl/styles.xml", _STYLES.format(head=_HEAD, ns=_NS, color=self.color))
        self.z.close()


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    rows: int


class XlsxWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), schema.fieldNames(), overwrite
        listed = lambda k: [x.strip() for x in options.get(k, "").split(",") if x.strip()]
        self.look = {"sheet": options.get("sheet", "Sheet1"), "widths": [float(w) for w in listed("widths")], "wrapped": set(listed("wrapped")), "percents": set(listed("percents"))}
        self.full = int(options.get("sheetRows", SHEET_ROWS))

    def write(self, rows: Iterator[Row]) -> Written:
        fs, inner = _opened(self.path)
        folder = f"{inner}/_temporary"
        fs.create_dir(folder, recursive=True)
        name, n = f"{folder}/{uuid.uuid4().hex}.xlsx", 0
        with fs.open_output_stream(name) as out:
            book = Workbook(out, self.names, full=self.full, **self.look)
            for row in rows:
                book.add(row)
                n += 1
            book.close()
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = _opened(self.path)
        if self.overwrite:
            for old in found_files(self.path):
                fs.delete_file(_opened(old)[1])
        batch = uuid.uuid4().hex[:8]
        done = [m for m in messages if m is not None]
        some = [m for m in done if m.rows] or done[:1]  # tasks without rows leave no file, but there is one at least
        for i, m in enumerate(some):
            fs.move(m.temporary, f"{inner}/part-{i:05}-{batch}.xlsx")
        self._clear(fs, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    @staticmethod
    def _clear(fs: arrow_fs.FileSystem, inner: str) -> None:
        if fs.get_file_info(f"{inner}/_temporary").type == arrow_fs.FileType.Directory:
            fs.delete_dir(f"{inner}/_temporary")


class XlsxSource(DataSource):
    """Options: ``path``; when writing also ``sheet`` (its name), ``widths``, ``wrapped`` and ``percents`` (column names), comma-separated."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def write_results(rows: DataFrame, path: str, sheet: str = "Opportunities") -> None:
    """Write rows of the finder's export as workbooks that look like what users know: widths by column, wrapped texts, coverage in percent."""
    register(rows.sparkSession)
    look = {"sheet": sheet, "widths": "24,22,18,24,18,24,26,16,18,16,14,12,16,12,30,30,45,45,40", "wrapped": ",".join(rows.columns[14:]), "percents": rows.columns[11]}
    rows.write.format("xlsx").options(**look).mode("overwrite").save(path)
