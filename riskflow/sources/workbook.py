"""Workbooks (xlsx) without a spreadsheet library: tasks read and make the zipped XML parts.

A workbook is one row group for one task (a sheet has 1,048,576 rows at most, in one compressed stream); a folder or pattern of many is read by many tasks.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions import exprs as E

ROWS = 100_000  # of a workbook that is made
BATCH = 10_000
_CELLS = "file string, row int, cells array<string>, kinds array<string>"
# Fixed values of the format: built-in number formats that show days or times, the day that numbers count from, and what may not stand in XML
DAY_FORMATS = {*range(14, 23), *range(45, 48)}
DAY_ZERO = dt.datetime(1899, 12, 30)
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _column(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _name(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _day_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a day or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in root.iter(f"{_SPACE}numFmt")}
    days = DAY_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", code, re.IGNORECASE)}
    styles = root.find(f"{_SPACE}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId") or 0) in days}


def _first_sheet(book: zipfile.ZipFile) -> str:
    root, links = ElementTree.fromstring(book.read("xl/workbook.xml")), ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    wanted = next(root.iter(f"{_SPACE}sheet")).get(f"{{{_OFFICE}}}id")
    target = next(x.get("Target") for x in links if x.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None], list[str | None]]]:
    """Number, values and kinds (n: number, d: day, b: truth value, s: text) of the rows of the first sheet that have a cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        days, shared = _day_styles(book), []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if item.tag == f"{_SPACE}si":
                    shared.append("".join(t.text or "" for t in item.iter(f"{_SPACE}t")))
                    item.clear()
        number = 0
        for _, row in ElementTree.iterparse(book.open(_first_sheet(book))):
            if row.tag != f"{_SPACE}row":
                continue
            number = int(row.get("r") or number + 1)
            values: list[str | None] = []
            kinds: list[str | None] = []
            for cell in row.iter(f"{_SPACE}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(values)
                kind, v = cell.get("t") or "n", cell.find(f"{_SPACE}v")
                text = v.text if v is not None else None
                if kind == "inlineStr":
                    kind, text = "s", "".join(t.text or "" for t in cell.iter(f"{_SPACE}t"))
                elif kind == "s":
                    text = shared[int(text)] if text is not None else None
                elif kind == "n" and text is not None and int(cell.get("s") or 0) in days:
                    kind, text = "d", (DAY_ZERO + dt.timedelta(seconds=round(float(text) * 86400))).isoformat(" ")
                elif kind not in ("n", "b"):  # results and errors of formulas, ISO days
                    kind = "d" if kind == "d" else "s"
                values += [None] * (at + 1 - len(values))
                kinds += [None] * (at + 1 - len(kinds))
                values[at], kinds[at] = text, kind if text is not None else None
            row.clear()
            if any(k is not None for k in kinds):
                yield number, values, kinds


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of the workbooks at ``path`` (a file, folder or pattern of any store that Spark reads).  The first row of each names the columns; later
    workbooks may have them in another order, and what they lack is null.  A column of numbers is double, of days a timestamp, anything else text.  Columns
    without a name, and empty rows, are left out; of equal names the first counts."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("kinds", pa.list_(pa.string()))])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, names = [], None
                for number, values, kinds in sheet_rows(content.as_py()):
                    names = names or number  # the first row with a cell
                    held.append((file, 0 if number == names else number, values, kinds))
                    if len(held) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    parsed = E.cut(files.mapInArrow(parse, _CELLS))
    heads = parsed.where("row = 0").select("file", F.col("cells").alias("names"))
    first = heads.orderBy("file").limit(1).collect()
    names = list(dict.fromkeys(n for n in (first[0]["names"] if first else []) if n))
    if not names:
        raise ValueError(f"no columns in {path}")
    place = [F.array_position("names", n).cast("int") - 1 for n in names]
    rows = E.with_lookup(parsed.where("row > 0"), heads, "file", "inner").select(*(F.struct(F.when(p >= 0, F.get("cells", p)).alias("v"), F.when(p >= 0, F.get("kinds", p)).alias("k")).alias(f"c{i}") for i, p in enumerate(place)))
    seen = rows.agg(*(F.array_sort(F.collect_set(f"c{i}.k")).alias(f"c{i}") for i in range(len(names)))).first()
    types = {("n",): "double", ("d",): "timestamp", ("b",): "boolean"}
    return rows.select(*(F.col(f"c{i}.v").cast(types.get(tuple(seen[i]), "string")).alias(n) for i, n in enumerate(names)))


def _cell(at: str, x: object) -> str:
    if x is None or x != x:
        return ""
    if isinstance(x, bool):
        return f'<c r="{at}" t="b"><v>{int(x)}</v></c>'
    if isinstance(x, int | float) and abs(x) < 1e300:
        return f'<c r="{at}"><v>{x!r}</v></c>'
    if isinstance(x, dt.date):
        day = x.replace(tzinfo=None) if isinstance(x, dt.datetime) else dt.datetime(x.year, x.month, x.day)
        since = day - DAY_ZERO
        return f'<c r="{at}" s="{2 if isinstance(x, dt.datetime) else 1}"><v>{since.days + since.seconds / 86400!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(NOT_XML.sub("", str(x)))}</t></is></c>'


def workbook_bytes(names: list[str], rows: Iterator[list]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = {"workbook": "sheet.main", "worksheets/sheet1": "worksheet", "styles": "styles"}
        listed = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{office}.{t}+xml"/>' for p, t in parts.items())
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{listed}</Types>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_LINKS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_LINKS}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_SPACE[1:-1]}" xmlns:r="{_OFFICE}"><sheets><sheet name="report" sheetId="1" r:id="rId1"/></sheets></workbook>')
        styles = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for n in (0, 14, 22))
        plain = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        book.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_SPACE[1:-1]}">{plain}<cellXfs count="3">{styles}</cellXfs></styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'{_HEAD}<worksheet xmlns="{_SPACE[1:-1]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
            letters = [_name(k) for k in range(len(names))]
            for number, row in enumerate([names, *rows], 1):
                sheet.write(f'<row r="{number}">{"".join(_cell(f"{letters[k]}{number}", x) for k, x in enumerate(row))}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_workbooks(df: DataFrame, path: str, rows: int = ROWS) -> list[str]:
    """Workbooks of at most ``rows`` rows under the folder ``path``, in the order of ``df``; an empty table has one.  Tasks make them and, where the folder lies in the one that
    all executors share on a mounted disk (or the session is local), put them in place; for another store one at a time goes through the driver.  Numbers, truth values and days keep their kind, decimals become doubles, anything else is text."""
    df = df.select(*(F.col(f"`{n}`").cast("double" if t.startswith("decimal") else t if t in ("boolean", "date", "timestamp", "tinyint", "smallint", "int", "bigint", "float", "double") else "string").alias(n) for n, t in df.dtypes))
    names = df.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[list] = []
        made = 0
        for batch in batches:
            held += map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while len(held) >= rows:
                yield one(TaskContext.get().partitionId(), made, held[:rows])
                held, made = held[rows:], made + 1
        if held:
            yield one(TaskContext.get().partitionId(), made, held)

    def one(task: int, made: int, some: list[list]) -> pa.RecordBatch:
        name, content = f"part-{task:05}-{made:05}.xlsx", workbook_bytes(names, iter(some))
        if local:
            from pyspark import TaskContext

            draft = f"{local}/.{name}-{TaskContext.get().taskAttemptId()}"  # a task that is tried again puts the same file in place
            with open(draft, "wb") as file:
                file.write(content)
            os.replace(draft, f"{local}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None if local else content], pa.binary())], ["name", "content"])

    spark, done = df.sparkSession, []
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    local = _mounted(spark, fs, top)
    if local:
        fs.mkdirs(top)
        done = [r["name"] for r in df.mapInArrow(make, "name string, content binary").select("name").collect()]  # a name for each workbook
        made = iter(())
    else:
        made = E.cut(df.mapInArrow(make, "name string, content binary")).toLocalIterator()  # made by all tasks at once, then read one by one
    for r in made:
        _put(fs, spark._jvm.org.apache.hadoop.fs.Path(top, r["name"]), bytes(r["content"]))
        done.append(r["name"])
    if not done:
        _put(fs, spark._jvm.org.apache.hadoop.fs.Path(top, "part-00000-00000.xlsx"), workbook_bytes(names, iter(())))
        done.append("part-00000-00000.xlsx")
    return done


def _mounted(spark: SparkSession, fs, path) -> str | None:
    """``path`` as tasks can write it, if it lies on a disk that they share with the driver."""
    if fs.getUri().getScheme() != "file":
        return None
    at, shared = fs.makeQualified(path).toUri(), spark._jvm.org.apache.hadoop.fs.Path(E.shared_folder(spark)).toUri()
    master = spark.sparkContext.master
    alone = master == "local" or master.startswith("local[")
    return at.getPath() if alone or shared.getScheme() in (None, "file") and f"{at.getPath()}/".startswith(f"{shared.getPath()}/") else None


def _put(fs, path, content: bytes) -> None:
    out = fs.create(path, True)
    for at in range(0, len(content), 1 << 20):
        out.write(bytearray(content[at : at + (1 << 20)]))
    out.close()
