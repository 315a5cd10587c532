"""Word and Excel files with the standard library: parsing, writing, and the DataFrames around them.

Files are read by Spark as binaries, so any file system that Spark knows will do, and parsed a row at a time in Arrow
batches; a document is one row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.shipping import shipped

# Namespaces of the formats (fixed values).
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"

BODY = "word/document.xml"

BLOCKS = T.ArrayType(T.StructType([T.StructField("block_id", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))

#: Colour of highlighted terms.
RED = "FF0000"


def paragraph_text(p: ET.Element) -> str:
    """Text of the runs of a paragraph; tabs and breaks as their characters."""
    out = []
    for run in p.iter(f"{W}r"):
        for node in run:
            if node.tag == f"{W}t":
                out.append(node.text or "")
            elif node.tag == f"{W}tab":
                out.append("\t")
            elif node.tag in (f"{W}br", f"{W}cr"):
                out.append("\n")
    return "".join(out)


def _rows(table: ET.Element) -> Iterator[list[ET.Element]]:
    """Cells of each row; a cell over several columns repeats, and one continued from above is the cell above."""
    above: list[ET.Element] = []
    for row in table.findall(f"{W}tr"):
        cells: list[ET.Element] = []
        for cell in row.findall(f"{W}tc"):
            props = cell.find(f"{W}tcPr")
            span = props.find(f"{W}gridSpan") if props is not None else None
            merge = props.find(f"{W}vMerge") if props is not None else None
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and len(above) > len(cells):
                cell = above[len(cells)]
            cells += [cell] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
        yield cells
        above = cells


def _body(content: bytes) -> ET.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ET.fromstring(z.read(BODY)).find(f"{W}body")


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, then the rows of every table: cells that are not blank, joined by spaces; all joined
    by line ends."""
    body = _body(content)
    lines = [t for p in body.findall(f"{W}p") if (t := paragraph_text(p)).strip()]
    for table in body.findall(f"{W}tbl"):
        for cells in _rows(table):
            texts = ["\n".join(paragraph_text(p) for p in cell.findall(f"{W}p")) for cell in cells]
            if shown := [t for t in texts if t.strip()]:
                lines.append(" ".join(shown))
    return "\n".join(lines)


def _paragraphs(body: ET.Element) -> list[tuple[str, ET.Element]]:
    """(kind, element) of body paragraphs and of the paragraphs of table cells, each once."""
    out = [("paragraph", p) for p in body.findall(f"{W}p")]
    seen: set[int] = set()
    for table in body.findall(f"{W}tbl"):
        for cells in _rows(table):
            for cell in cells:
                if id(cell) not in seen:
                    seen.add(id(cell))
                    out += [("cell", p) for p in cell.findall(f"{W}p")]
    return out


def docx_blocks(content: bytes) -> list[tuple[int, str, str]]:
    """(block_id, kind, text): what highlighting works on."""
    return [(i, kind, paragraph_text(p)) for i, (kind, p) in enumerate(_paragraphs(_body(content)))]


def cut_at_spans(text: str, spans: Iterable[tuple[int, int]]) -> list[tuple[str, bool]]:
    """Runs (text, is_term) of a text cut at sorted, disjoint spans, without empty plain runs."""
    out, at = [], 0
    for start, end in spans:
        if start > at:
            out.append((text[at:start], False))
        out.append((text[start:end], True))
        at = end
    if at < len(text):
        out.append((text[at:], False))
    return out


def highlighted_docx(content: bytes, spans: dict[int, list[tuple[int, int]]]) -> bytes:
    """A copy of the document where the paragraphs with spans have their runs replaced by plain and red ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {name: z.read(name) for name in z.namelist()}
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(parts[BODY]), events=("start-ns",)):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(parts[BODY])
    for block, (_, p) in enumerate(_paragraphs(root.find(f"{W}body"))):
        if not spans.get(block):
            continue
        text = paragraph_text(p)
        for child in [c for c in p if c.tag != f"{W}pPr"]:
            p.remove(child)
        for piece, is_term in cut_at_spans(text, spans[block]):
            run = ET.SubElement(p, f"{W}r")
            if is_term:
                ET.SubElement(ET.SubElement(run, f"{W}rPr"), f"{W}color").set(f"{W}val", RED)
            node = ET.SubElement(run, f"{W}t")
            node.text = piece
            node.set(XML_SPACE, "preserve")
    parts[BODY] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    return _zipped(parts)


def _zipped(parts: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def make_docx(paragraphs: list[str], tables: list[list[list[str]]] | None = None) -> bytes:
    """A small document of paragraphs and tables."""
    p = lambda text: f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    body = "".join(map(p, paragraphs)) + "".join(map(table, tables or []))
    return _zipped(
        {
            "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
            "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
            BODY: f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>',
        }
    )


Cell = str | float | int | bool | None


def xlsx_rows(content: bytes) -> list[list[Cell]]:
    """Cells of the first sheet, row by row; missing cells and rows are None and empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        sheet = ET.fromstring(z.read("xl/workbook.xml")).find(f"{S}sheets")[0]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheet.get(f"{R}id")]
        root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows: list[list[Cell]] = []
    for row in root.find(f"{S}sheetData"):
        at = int(row.get("r", len(rows) + 1))
        rows += [[] for _ in range(at - len(rows))]
        cells = rows[at - 1]
        for cell in row:
            column = _column(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (column + 1 - len(cells))
            cells[column] = _value(cell, shared)
    return rows


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell: ET.Element, shared: list[str]) -> Cell:
    kind, v = cell.get("t", "n"), cell.find(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind != "n":
        return v.text
    number = float(v.text)
    return int(number) if number.is_integer() and "e" not in v.text.lower() else number


def first_column(rows: list[list[Cell]]) -> list[str]:
    """The first column as strings, as a typed table shows them: whole numbers with a decimal if the column is all
    numbers and has gaps, blanks as nan."""
    values = [row[0] if row else None for row in rows]
    numbers = all(v is None or (isinstance(v, int | float) and not isinstance(v, bool)) for v in values)
    as_float = numbers and (None in values or any(isinstance(v, float) for v in values))
    return ["nan" if v is None else str(float(v)) if as_float else str(v) for v in values]


def make_xlsx(columns: list[str], rows: Iterable[Iterable[Cell]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet with a header row."""

    def cell(value: Cell) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    data = "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in ([columns] if columns else []) + [list(r) for r in rows])
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    return _zipped(
        {
            "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
            "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<?xml version="1.0"?><workbook xmlns="{S[1:-1]}" xmlns:r="{rel}"><sheets><sheet name={_quoted(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{S[1:-1]}"><sheetData>{data}</sheetData></worksheet>',
        }
    )


def _quoted(value: str) -> str:
    return '"' + escape(value[:31], {'"': "&quot;"}) + '"'


def binaries(spark: SparkSession, *paths: str) -> DataFrame:
    """path and content of files."""
    shipped(spark)
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


@F.pandas_udf(T.StringType())
def _texts(contents: pd.Series) -> pd.Series:
    return contents.map(docx_text)


@F.pandas_udf(BLOCKS)
def _blocks(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: [{"block_id": i, "kind": kind, "text": text} for i, kind, text in docx_blocks(c)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _first_columns(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: first_column(xlsx_rows(c)))


def read_docx(spark: SparkSession, *paths: str) -> DataFrame:
    """path and text of Word documents."""
    return binaries(spark, *paths).select("path", _texts("content").alias("text"))


def read_docx_blocks(spark: SparkSession, *paths: str) -> DataFrame:
    """path, block_id, kind and text of the paragraphs of Word documents, those in table cells included."""
    return binaries(spark, *paths).select("path", F.explode(_blocks("content")).alias("b")).select("path", "b.*")


def read_xlsx_column(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line: the first column of the first sheet, without a header."""
    return binaries(spark, path).select(F.posexplode(_first_columns("content")).alias("line_no", "line")).select(F.col("line_no").cast("bigint").alias("line_no"), "line")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet with its header row as a DataFrame. A workbook is one file and read on the driver."""
    rows = xlsx_rows(bytes(binaries(spark, path).first()["content"]))
    header = [str(c) if c is not None else f"Unnamed: {i}" for i, c in enumerate(rows[0] if rows else [])]
    body = [[*row[: len(header)], *[None] * (len(header) - len(row))] for row in rows[1:]]
    return spark.createDataFrame(pd.DataFrame(body, columns=header).astype(object).where(lambda d: d.notna(), None)) if body else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in header))
