"""Files as tables: what they are by their bytes, their hash, and the paragraphs and tracked revisions of Word files."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCUMENT = "word/document.xml"
PARAGRAPHS = "path string, ord int, source_id string, container string, text string, style string, bold boolean, num_id string, num_level int, problem string"
REVISIONS = "path string, ord int, kind string, author string, date string, text string"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files of a folder or pattern: path, length, content. The glob is applied while listing."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", "content")


def format_of(content: Column) -> Column:
    """docx, pdf or unknown, by the bytes alone: %PDF within the first 1024, or a ZIP whose directory names a document part."""
    head = F.hex(F.substring(content, 1, 1024))
    named = F.instr(F.hex(content), F.lit(DOCUMENT.encode().hex().upper()))
    return F.when(head.contains("25504446"), "pdf").when(head.startswith("504B0304") & (named > 0), "docx").otherwise("unknown")


def detected(found: DataFrame) -> DataFrame:
    """Adds format and sha256."""
    return found.withColumn("format", format_of(F.col("content"))).withColumn("sha256", F.sha2("content", 256))


def _walk(node: ET.Element, path: str) -> Iterator[tuple[str, ET.Element]]:
    """Paragraphs in reading order, depth first, each with the path of its ordinals by tag."""
    seen: dict[str, int] = {}
    for child in node:
        tag = child.tag.rpartition("}")[2]
        seen[tag] = seen.get(tag, 0) + 1
        own = f"{path}/{tag}[{seen[tag]}]"
        if child.tag == f"{W}p":
            yield own, child
        yield from _walk(child, own)


def _on(properties: ET.Element | None, tag: str) -> bool | None:
    found = None if properties is None else properties.find(f"{W}{tag}")
    return None if found is None else found.get(f"{W}val", "true") not in ("0", "false", "none")


def _text(paragraph: ET.Element) -> str:
    parts = []
    for node in paragraph.iter():
        if node.tag == f"{W}t":
            parts.append(node.text or "")
        elif node.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            parts.append(" ")
    return " ".join("".join(parts).split())


def read_paragraphs(content: bytes) -> list[dict]:
    """The paragraphs of a Word file's body. A file that can't be read gives one row that says why."""
    try:
        body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(DOCUMENT)).find(f"{W}body")
        if body is None:
            raise KeyError("no body")
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as wrong:
        return [{"problem": f"{type(wrong).__name__}: {wrong}"}]
    out = []
    for ord_, (path, p) in enumerate(_walk(body, "body[1]"), 1):
        properties = p.find(f"{W}pPr")
        style = None if properties is None else properties.find(f"{W}pStyle")
        number = None if properties is None else properties.find(f"{W}numPr")
        value = lambda tag: None if number is None or (x := number.find(f"{W}{tag}")) is None else x.get(f"{W}val")  # noqa: E731, B023
        runs = [r for r in p.iter(f"{W}r") if any((t.text or "").strip() for t in r.iter(f"{W}t"))]
        bolds = [_on(r.find(f"{W}rPr"), "b") for r in runs]
        container = "cell" if "/tc[" in path else "textbox" if "/txbxContent[" in path else "body"
        level = value("ilvl")
        out.append({
            "ord": ord_, "source_id": path, "container": container, "text": _text(p), "style": None if style is None else style.get(f"{W}val"),
            "bold": all(bolds) if bolds and None not in bolds else None, "num_id": value("numId"), "num_level": int(level) if level else None,
        })
    return out


def paragraphs(found: DataFrame) -> DataFrame:
    """A row per paragraph of the Word files among ``found`` (path, content); a file is read by one call, and faults are rows."""

    return _rows(found, read_paragraphs, PARAGRAPHS)


def _rows(found: DataFrame, read: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """What ``read`` finds in each file, one row each, with the file's path."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [{k: ({"path": path} | r).get(k) for k in arrow.names} for r in read(content or b"")]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return found.select("path", "content").mapInArrow(run, schema)


def read_revisions(content: bytes) -> list[dict]:
    """Tracked insertions, deletions and moves, in reading order."""
    kinds = {"ins": "insert", "del": "delete", "moveFrom": "move_from", "moveTo": "move_to", "rPrChange": "format_run", "pPrChange": "format_paragraph"}
    try:
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(DOCUMENT))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []
    out = []
    for node in root.iter():
        if (kind := kinds.get(node.tag.rpartition("}")[2])) and node.tag.startswith(W):
            text = "".join(t.text or "" for t in node.iter() if t.tag in (f"{W}t", f"{W}delText"))
            out.append({"ord": len(out) + 1, "kind": kind, "author": node.get(f"{W}author"), "date": node.get(f"{W}date"), "text": text})
    return out


def revisions(found: DataFrame) -> DataFrame:
    """A row per tracked revision of the Word files among ``found``."""

    return _rows(found, read_revisions, REVISIONS)


def ocr_lines(words: DataFrame) -> DataFrame:
    """OCR word rows (doc, page, block, par, line, word, left, top, width, height, conf, text) as lines: text in word order, box, mean
    confidence (one decimal, half to even) and the lowest one."""
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    grouped = words.filter(F.trim("text") != "").groupBy("doc", "page", "block", "par", "line").agg(
        F.sort_array(F.collect_list(F.struct("word", "text"))).alias("w"), F.min("left").alias("left"), F.min("top").alias("top"),
        F.max(right).alias("right"), F.max(bottom).alias("bottom"), F.bround(F.avg("conf"), 1).alias("confidence"), F.min("conf").alias("lowest"),
    )
    return grouped.withColumn("text", F.array_join(F.transform("w", lambda x: x["text"]), " ")).drop("w")
