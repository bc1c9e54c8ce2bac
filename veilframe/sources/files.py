"""Files as text: type by content, readers for documents and sheets, guards.

``binaryFile`` gives (path, content); everything else is a column expression or one Arrow stage. Recognition of
images and speech is a port: a callable that gets bytes and gives text and confidence.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import pieces

#: Formats by type.
FORMATS = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "image/png": "image", "image/jpeg": "image", "image/jpg": "image", "image/tiff": "image", "image/bmp": "image",
    "audio/mpeg": "audio", "audio/mp3": "audio", "audio/wav": "audio", "audio/x-wav": "audio", "audio/flac": "audio", "audio/ogg": "audio", "audio/mp4": "audio", "audio/m4a": "audio", "audio/x-m4a": "audio", "video/mp4": "audio",
}
#: Fixed value: no larger file is read.
MOST_BYTES = 50 * 1024 * 1024


def mime_of(content: Column, fallback: Column | None = None) -> Column:
    """The type by the first bytes, else the fallback, else null."""
    head = F.hex(F.substring(content, 1, 16))
    part = lambda a, n: F.substring(head, 2 * a + 1, 2 * n)
    starts = lambda s: head.startswith(s.hex().upper())
    text = F.hex(F.substring(content, 1, 4000))
    holds = lambda s: F.contains(text, F.lit(s.hex().upper()))
    found = (
        F.when(starts(b"%PDF-"), "application/pdf").when(starts(b"\x89PNG\r\n\x1a\n"), "image/png").when(starts(b"\xff\xd8"), "image/jpeg")
        .when(starts(b"RIFF") & (part(8, 4) == b"WAVE".hex().upper()), "audio/wav").when(starts(b"OggS"), "audio/ogg").when(starts(b"fLaC"), "audio/flac").when(starts(b"ID3"), "audio/mpeg")
        .when(head.rlike("^FF[EF]"), "audio/mpeg").when(part(4, 4) == b"ftyp".hex().upper(), "audio/mp4")
        .when(starts(b"PK") & holds(b"vnd.oasis.opendocument.spreadsheet"), "application/vnd.oasis.opendocument.spreadsheet")
        .when(starts(b"PK") & holds(b"word/"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when(starts(b"PK") & holds(b"xl/"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
    )
    return F.coalesce(found, F.trim(fallback) if fallback is not None else F.lit(None))


def format_of(mime: Column) -> Column:
    """The format of a type; whole families count, unknown types give null."""
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, mime), F.when(mime.startswith("audio/") | (mime == "application/octet-stream"), "audio").when(mime.startswith("image/"), "image"))


# --- documents -------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def read_docx(content: bytes) -> str:
    """Paragraphs, one to a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    paragraphs = [p for p in (body if body is not None else root) if p.tag == f"{_W}p"]
    sign = {f"{_W}tab": "\t", f"{_W}br": "\n"}
    return "\n".join("".join(e.text or "" if e.tag == f"{_W}t" else sign.get(e.tag, "") for e in p.iter()) for p in paragraphs)


def _sheet_text(name: str, rows: Iterator[list[str]]) -> str:
    """The first row that is not empty becomes numbered column names; empty cells are left out."""
    lines, header = [], ""
    for row in rows:
        if not row:
            continue
        if not lines:
            names = [f"COLUMN_{i}" for i in range(1, len(row) + 1)]
            header = " — columns: " + " | ".join(names)
            row = names
        lines.append("\t".join(row))
    return f"# Sheet: {name}{header}\n" + "\n".join(lines) if lines else ""


def read_xlsx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}

        def cells(row) -> list[str]:
            out = []
            for c in row.iter(f"{_S}c"):
                v = c.find(f"{_S}v")
                if c.get("t") == "inlineStr":
                    out.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                elif v is not None and v.text is not None:
                    out.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
            return out

        texts = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            path = targets[s.get(_R)].lstrip("/")
            root = ET.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            texts.append(_sheet_text(s.get("name"), (cells(r) for r in root.iter(f"{_S}row"))))
    return "\n\n".join(t for t in texts if t)


def read_ods(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("content.xml"))

    def cells(row) -> list[str]:
        found = ["\n".join("".join(p.itertext()) for p in c.iter(f"{_X}p")).strip() for c in row.iter(f"{_T}table-cell")]
        return [c for c in found if c]

    texts = [_sheet_text(t.get(f"{_T}name"), (cells(r) for r in t.iter(f"{_T}table-row"))) for t in root.iter(f"{_T}table")]
    return "\n\n".join(t for t in texts if t)


_STREAM = re.compile(rb"(?:/Length (\d+)(?! \d+ R)[^>]*>>\s*)?\bstream\r?\n")
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|\b(?:TJ|Tj|Td|TD|ET)\b|['\"]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(2, "0"))
        return data.decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")

    def one(m: re.Match) -> bytes:
        s = m.group(1)
        return bytes([int(s, 8) & 255]) if s.isdigit() else _ESCAPES.get(s, s)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S).decode("latin-1")


def read_pdf(content: bytes, recognise: Callable[[bytes], tuple[str, float]] | None = None) -> str:
    """Text that content streams show, pages parted by a blank line. A page whose text layer is broken goes to ``recognise``."""
    pages = []
    for m in _STREAM.finditer(content):
        end = m.end() + int(m.group(1)) if m.group(1) else content.find(b"endstream", m.end())
        data = content[m.end() : end if end >= 0 else len(content)]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"Tj" not in data and b"TJ" not in data:
            continue
        out, held = [], []
        for t in _SHOW.findall(data):
            if t[:1] in b"(<" and len(t) > 1:
                held.append(_pdf_string(t))
            else:
                if t in (b"Tj", b"TJ", b"'", b'"'):
                    out.append("".join(held))
                elif t in (b"T*", b"Td", b"TD") and out and not out[-1].endswith("\n"):
                    out.append("\n")
                held = []
        pages.append("".join(out).strip())
    if recognise is not None:
        pages = [recognise(content)[0] if "(cid:" in p or "�" in p else p for p in pages]
    return "\n\n".join(p for p in pages if p)


READERS: dict[str, Callable[[bytes], str]] = {"pdf": read_pdf, "docx": read_docx, "xlsx": read_xlsx, "ods": read_ods}


def ingest(files: DataFrame, recognise: Callable[[bytes], tuple[str, float]] | None = None, transcribe: Callable[[bytes], tuple[str, float]] | None = None, keep: str = "path") -> DataFrame:
    """(keep, format, text, confidence, warning) of files (keep, content, format). Images and speech go to their ports; without
    one, or where a file cannot be read, the text is empty and the warning says so."""
    kind = files.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ports = {"image": recognise, "audio": transcribe}
        for b in pieces(batches):
            out = []
            for content, fmt in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    if fmt in READERS:
                        out.append((READERS[fmt](content), None, None))
                    elif ports.get(fmt):
                        out.append((*ports[fmt](content), None))
                    else:
                        out.append(("", None, f"no reader for {fmt}"))
                except Exception as e:  # noqa: BLE001 - one broken file must not stop the others
                    out.append(("", None, f"{type(e).__name__}: {e}"[:200]))
            c = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(c[0]), pa.string()), pa.array(list(c[1]), pa.float64()), pa.array(list(c[2]), pa.string())], names=[keep, "format", "text", "confidence", "warning"])

    return files.select(keep, "content", "format").mapInArrow(run, f"{keep} {kind}, format string, text string, confidence double, warning string")


def scan_folder(spark: SparkSession, root: str, pattern: str = "*", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, content, format) of files under the root, none larger than ``most_bytes``. Links are followed by no reader
    of Hadoop's; paths outside of the root never match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") <= most_bytes).select("path", "length", "content", format_of(mime_of(F.col("content"))).alias("format"))


def read_plain(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, text) of txt, md, csv (cells by tabs) and json (indented) files."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    if kind == "csv":
        lines = F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n", -1)
        cell = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
        cells = lambda line: F.transform(F.regexp_extract_all(line, F.lit(cell), F.lit(1)), lambda c: F.replace(F.regexp_replace(c, r'^"|"\z', ""), F.lit('""'), F.lit('"')))
        return whole.select("path", F.array_join(F.transform(lines, lambda x: F.array_join(cells(x), "\t")), "\n").alias("text"))
    if kind == "json":
        return whole.select("path", F.to_json(F.parse_json("text"), {"pretty": "true"}).alias("text"))
    return whole


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file of JSON lines; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


# --- fields and layout -----------------------------------------------------------------------------


def field_type(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(label.rlike(r"\d[\d\s\-\(\)]{5,}"), "phone").when(F.contains(low, F.lit("@")) | F.contains(F.replace(low, F.lit("-"), F.lit("")), F.lit("e-mail")), "email")
        .when(low.rlike(r"(no|id)\.?\z") | F.contains(label, F.lit("#")), "identifier").when(label.rlike(r"\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}"), "date")
    )


def fields(text: Column) -> Column:
    """``label : value`` lines as an array of (label, value, field_type); labels of up to ten words."""
    lines = F.split(text, "\n", -1)
    pattern = r"^(.{2,80}?)\s*:\s*(.+?)\s*\z"
    found = F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.struct(F.trim(F.regexp_extract(x, pattern, 1)).alias("label"), F.trim(F.regexp_extract(x, pattern, 2)).alias("value")))
    kept = F.filter(found, lambda f: (f["label"] != "") & (f["value"] != "") & (F.size(F.split(f["label"], r"\s+")) <= 10))
    return F.transform(kept, lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value"), field_type(f["label"]).alias("field_type")))


def layout_lines(boxes: Column, width: Column) -> Column:
    """Recognised boxes (y, left, right, height, text) as lines in reading order. Two columns are told apart where at least three
    boxes lie to the right and enough of them are texts; a line takes boxes within half the middling height of its mean."""
    mid = width / 2
    is_right = lambda b: (b["right"] - b["left"] <= width * 0.5) & ((b["left"] + b["right"]) / 2 >= mid)
    right = F.filter(boxes, is_right)
    texty = F.filter(right, lambda b: (F.length(b["text"]) > 6) & ~b["text"].rlike(r"(?i)^[\d.,₺€$£#tb\s+\-]+\z"))
    two = (width >= 400) & (F.size(right) >= 3) & (F.size(texty) >= 0.3 * F.size(right))
    columns = F.when(two, F.array(F.filter(boxes, lambda b: ~is_right(b)), right)).otherwise(F.array(boxes))
    return F.flatten(F.transform(columns, _lines))


def _lines(boxes: Column) -> Column:
    heights = F.array_sort(F.filter(F.transform(boxes, lambda b: b["height"].cast("double")), lambda h: h > 0))
    middle = F.coalesce(F.try_element_at(heights, (F.floor(F.size(heights) / 2) + 1).cast("int")), F.lit(20.0)) * 0.5
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"].cast("double").alias("y"), b["left"].cast("double").alias("x"), b["text"].alias("text"))))
    cell = F.array(F.struct(F.lit(0.0).alias("x"), F.lit("").alias("text")))
    zero = F.struct(F.lit(None).cast("double").alias("mean"), F.slice(cell, 1, 0).alias("line"), F.slice(F.array(cell), 1, 0).alias("out"))

    def add(acc: Column, b: Column) -> Column:
        new = acc["mean"].isNotNull() & (F.abs(b["y"] - acc["mean"]) > middle)
        line = F.when(new, F.slice(cell, 1, 0)).otherwise(acc["line"])
        base = F.when(new | acc["mean"].isNull(), b["y"]).otherwise(acc["mean"])
        grown = F.concat(line, F.array(F.struct(b["x"].alias("x"), b["text"].alias("text"))))
        return F.struct((base + (b["y"] - base) / F.size(grown)).alias("mean"), grown.alias("line"), F.when(new, F.concat(acc["out"], F.array(acc["line"]))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, zero, add)
    every = F.when(F.size(done["line"]) > 0, F.concat(done["out"], F.array(done["line"]))).otherwise(done["out"])
    return F.transform(every, lambda line: F.array_join(F.transform(F.array_sort(line), lambda c: c["text"]), "  "))


# --- writers of the same formats, for exports and tests ------------------------------------------


def _xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def write_docx(text: str) -> bytes:
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_xml(p)}</w:t></w:r></w:p>' for p in text.split("\n"))
    return _zip({"word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{paragraphs}</w:body></w:document>'})


def write_xlsx(sheets: dict[str, list[list[str | None]]]) -> bytes:
    parts, listed, links = {}, "", ""
    for i, (name, rows) in enumerate(sheets.items(), 1):
        cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{_xml(v)}</t></is></c>'
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_S[1:-1]}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>"
        listed += f'<sheet name="{_xml(name)}" sheetId="{i}" r:id="r{i}"/>'
        links += f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-3]}"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{links}</Relationships>"
    return _zip(parts)


def write_ods(sheets: dict[str, list[list[str | None]]]) -> bytes:
    body = ""
    for name, rows in sheets.items():
        cells = lambda r: "".join(f"<t:table-cell>{'' if v is None else f'<x:p>{_xml(v)}</x:p>'}</t:table-cell>" for v in r)
        body += f'<t:table t:name="{_xml(name)}">' + "".join(f"<t:table-row>{cells(r)}</t:table-row>" for r in rows) + "</t:table>"
    return _zip({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f'<d xmlns:t="{_T[1:-1]}" xmlns:x="{_X[1:-1]}">{body}</d>'})


def write_pdf(pages: list[str]) -> bytes:
    """Pages of plain lines; enough for what read_pdf reads."""
    out = b"%PDF-1.4\n"
    for i, page in enumerate(pages, 1):
        lines = b" T* ".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("latin-1", "replace")) + b") Tj" for x in page.split("\n"))
        data = zlib.compress(b"BT /F1 12 Tf " + lines + b" ET")
        out += b"%d 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (i, len(data), data)
    return out + b"%%EOF\n"
