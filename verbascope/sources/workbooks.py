"""XLSX workbooks, read through Spark's binary files and written as small exports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, unescape

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers of the two workbooks, by the names used here.
INVENTORY = {"term": "词条", "sense_no": "释义序号", "definition": "释义", "dict_example": "词典例句", "learner_example": "学习者例句", "level": "等级"}
HITS = {"essay_id": "essay_id", "phrase": "短语", "is_poly": "多义", "sense": "消歧义项", "cefr": "CEFR", "pos": "词性", "total_score": "总分"}

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _text(node: ElementTree.Element) -> str:
    """All runs of a string, without phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag != f"{_MAIN}rPh" for t in part.iter(f"{_MAIN}t"))


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _number(text: str) -> str:
    number = float(text)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return None if inline is None else _text(inline)
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    return _number(value.text) if kind == "n" else value.text


def active_sheet(book: zipfile.ZipFile) -> str:
    """The member that holds the sheet a workbook opens on."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    sheets = root.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    chosen = sheets[int(view.get("activeTab", 0)) if view is not None else 0].get(f"{_REL}id")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == chosen:
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("the active sheet isn't there")


# How ``sheet_of`` writes what is around the rows of a sheet and its cells.
_HEAD = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_TAIL = "</sheetData></worksheet>"
_OPEN, _CLOSE = '<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>"
_PLAIN_CELL = re.compile(f"<c/>|<c><v>[^<&]+</v></c>|{_OPEN}[^<]*{_CLOSE}")
#: Bytes of a sheet that is read at once; larger ones are streamed.
PLAIN_BYTES = 1 << 28


def _plain_value(cell: str) -> str | None:
    if cell == "<c/>":
        return None
    if cell.startswith("<c>"):
        return _number(cell[6:-8])
    value = cell[len(_OPEN) : -len(_CLOSE)]
    return unescape(value) if "&" in value else value


def plain_lines(sheet: bytes) -> list[list[str | None]] | None:
    """The rows of a sheet whose every character is as ``sheet_of`` writes it, by a search for cells; None for all other sheets, which need a parser."""
    text = sheet.decode("utf-8", "replace")
    if not (text.startswith(_HEAD) and text.endswith(_TAIL)) or "\r" in text or "\ufffd" in text or re.search("&(?!amp;|lt;|gt;)", text):
        return None
    *found, rest = text[len(_HEAD) : -len(_TAIL)].split("</row>")
    lines, values = [], {}
    for row in found:
        cells = _PLAIN_CELL.findall(row, 5)
        if not row.startswith("<row>") or sum(map(len, cells)) != len(row) - 5:
            return None
        try:
            lines.append([values[c] for c in cells])
        except KeyError:
            values |= {c: _plain_value(c) for c in cells if c not in values}
            lines.append([values[c] for c in cells])
    return None if rest else lines


def _lines(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the active sheet, headers first."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        name = active_sheet(book)
        if book.getinfo(name).file_size <= PLAIN_BYTES and (found := plain_lines(book.read(name))) is not None:
            yield from found
            return
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        with book.open(name) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str | None] = {}
                for i, cell in enumerate(node.findall(f"{_MAIN}c")):
                    cells[_column(cell.get("r")) if cell.get("r") else i] = _value(cell, shared)
                node.clear()
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def rows(content: bytes) -> Iterator[dict[str, str | None]]:
    """The rows of the active sheet by header; of columns with the same header the rightmost holds."""
    headers: list[str | None] | None = None
    for line in _lines(content):
        if headers is None:
            headers = line
        else:
            yield {h: v for h, v in zip(headers, line + [None] * (len(headers) - len(line)), strict=False) if h is not None}


def columns_of(content: bytes, headers: list[str]) -> list[list[str | None]]:
    """The values below each of ``headers``, as ``rows`` has them."""
    first, *lines = [*_lines(content)] or [[]]
    places = [max((i for i, h in enumerate(first) if h == header), default=None) for header in headers]
    if all(len(line) == len(first) for line in lines):
        return [[None] * len(lines) if i is None else [line[i] for line in lines] for i in places]
    return [[line[i] if i is not None and i < len(line) else None for line in lines] for i in places]


def read_workbook(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """row_no and ``columns`` (name: header) as strings. The file is fetched by Spark, from any store it reads."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"].to_pylist():
                found = columns_of(content, [columns[n] for n in names])
                yield pa.RecordBatch.from_arrays([pa.array(range(1, len(found[0]) + 1), pa.int64()), *(pa.array(x, pa.string()) for x in found)], ["row_no", *names])

    schema = "row_no long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The sense inventory; sense numbers are text, as some inventories number senses ``2a``."""
    return read_workbook(spark, path, INVENTORY)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_workbook(spark, path, HITS).withColumn("total_score", F.expr("try_cast(total_score AS DOUBLE)"))


# The parts of a minimal workbook.
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_ROOT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>'
_LINKS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
_LINK = '<Relationship Id="rId{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{n}.xml"/>'


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'{_OPEN}{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))}{_CLOSE}'
    return f"<c><v>{value!r}</v></c>"


def _cells(values: list) -> list[str]:
    """The cells of a column's values, of which texts are made once for each that is different; what isn't there, or is no number, is empty."""
    memo = {x: _cell(x) for x in {x for x in values if isinstance(x, str)}}
    return [memo[x] if isinstance(x, str) else _cell(None if x is None or x != x else x) for x in values]


def sheet_of(rows: Iterable[Iterable[str]]) -> str:
    """A sheet's XML from the cells of its rows."""
    return _HEAD + "".join(["<row>" + "".join(cells) + "</row>" for cells in rows]) + _TAIL


#: Rows of a sheet, with its header, at most.
SHEET_ROWS = 1 << 20


def write_workbooks(rows: DataFrame, folder: str, columns: dict[str, str], order: str, size: int = 10_000) -> None:
    """``rows`` as workbooks of up to ``size`` rows with the headers of ``columns``, each of a range of ``order``, a number."""
    names = list(columns)

    def save(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        cells = zip(*(_cells(part[n].tolist()) for n in names), strict=True)
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/part-{key[0]:012d}.xlsx", compression=None) as file:
            file.write(_book({"rows": sheet_of([map(_cell, columns.values()), *cells])}, level=1))
        return pd.DataFrame({"file": [key[0]]})

    numbered = rows.withColumn("_chunk", F.floor(F.col(order) / size).cast("long"))
    numbered.groupBy("_chunk").applyInPandas(save, "file long").write.format("noop").mode("overwrite").save()


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of a few small sheets."""
    return _book({k: sheet_of(map(_cell, line) for line in lines) for k, lines in sheets.items()})


def _book(sheets: dict[str, str], level: int | None = None) -> bytes:
    """A workbook of sheets of XML."""
    out = io.BytesIO()
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as book:
        book.writestr("[Content_Types].xml", _TYPES.format(sheets="".join(_SHEET_TYPE.format(n=n) for n in numbers)))
        book.writestr("_rels/.rels", _ROOT)
        book.writestr("xl/workbook.xml", _BOOK.format(sheets="".join(f'<sheet name="{escape(k)}" sheetId="{n}" r:id="rId{n}"/>' for n, k in zip(numbers, sheets, strict=True))))
        book.writestr("xl/_rels/workbook.xml.rels", _LINKS.format(links="".join(_LINK.format(n=n) for n in numbers)))
        for n, sheet in zip(numbers, sheets.values(), strict=True):
            book.writestr(f"xl/worksheets/sheet{n}.xml", sheet)
    return out.getvalue()
