"""DOCX files as rows of blocks: paragraphs and tables in document order, with the headings above them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Limits of a package.
MOST_ENTRIES, MOST_BYTES = 5_000, 50 * 1024 * 1024
# The type of a main part without macros, and the names of styles that head sections.
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
HEADING = re.compile(r"(?:Heading|标题)\s*([1-3])", re.I)
_SPACES = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def problems(data: bytes) -> list[str]:
    """Reasons why a package is not read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as package:
            entries = package.infolist()
            found = [
                (len(entries) > MOST_ENTRIES, "entries"),
                (sum(e.file_size for e in entries) > MOST_BYTES, "size"),
                (any(e.filename.startswith("/") or "\\" in e.filename or ".." in e.filename.split("/") for e in entries), "paths"),
                (any(e.flag_bits & 1 for e in entries), "encrypted"),
                (not {"[Content_Types].xml", "word/document.xml"} <= {e.filename for e in entries}, "parts"),
            ]
            out = [name for bad, name in found if bad]
            if out or package.testzip():
                return out or ["checksum"]
            types = ElementTree.fromstring(package.read("[Content_Types].xml"))
            main = {x.get("ContentType") for x in types if x.tag.endswith("Override") and x.get("PartName") == "/word/document.xml"}
            return ["type"] if main and MAIN_TYPE not in main else []  # one that declares no type is read
    except zipfile.BadZipFile:
        return ["zip"]
    except ElementTree.ParseError:
        return ["types"]


def _words(node: ElementTree.Element) -> str:
    """A paragraph's text; tabs and breaks are white space, and runs of that one space."""
    return " ".join("".join((x.text or "") if x.tag == f"{_W}t" else _SPACES.get(x.tag, "") for x in node.iter()).split())


def _table(node: ElementTree.Element) -> str:
    """Rows that have text, cells apart by bars; a cell over several columns or rows counts for each."""
    lines, above = [], []
    for row in node.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            text = " ".join(filter(None, map(_words, cell.findall(f"{_W}p"))))
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue" and len(cells) < len(above):
                text = above[len(cells)]
            cells += [text] * (int(span.get(f"{_W}val", 1)) if span is not None else 1)
        above = cells
        lines += [" | ".join(cells)] * any(cells)
    return "\n".join(lines)


def _style_names(package: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in package.namelist():
        return {}
    named = ((x.get(f"{_W}styleId"), x.find(f"{_W}name")) for x in ElementTree.fromstring(package.read("word/styles.xml")).iter(f"{_W}style"))
    return {key: name.get(f"{_W}val", "") for key, name in named if key and name is not None}


def blocks(data: bytes) -> Iterator[tuple[str, int, str | None, str]]:
    """(kind, index from 1, section, text); what is empty is passed over but counted."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
        names = _style_names(package)
    path: dict[int, str] = {}
    counts = {"paragraph": 0, "table": 0}
    for node in body if body is not None else ():
        kind = {f"{_W}p": "paragraph", f"{_W}tbl": "table"}.get(node.tag)
        if not kind:
            continue
        counts[kind] += 1
        if kind == "table":
            text = _table(node)
        else:
            text = _words(node)
            style = node.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val", "") if style is not None else ""
            heading = HEADING.fullmatch(names.get(key, key))  # a style without a name goes by its id
            if heading and text:
                level = int(heading[1])
                path = {n: t for n, t in path.items() if n < level} | {level: text}
        if text.replace("|", "").strip():
            yield kind, counts[kind], " > ".join(path[n] for n in sorted(path)) or None, text


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, index, section, text and error of the .docx files of a folder; a file that is not read has one row, its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                bad = problems(data)
                rows += [(path, None, None, None, None, ",".join(bad))] if bad else [(path, *block, None) for block in blocks(data)]
            yield pd.DataFrame(rows, columns=["path", "kind", "index", "section", "text", "error"]).astype({"index": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.lower("path").endswith(".docx"))
    return files.select("path", "content").mapInPandas(parse, "path string, kind string, index long, section string, text string, error string")


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of the .txt and .md files of a folder, each whole, in path order by the caller's sort."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.filter(F.lower("path").rlike(r"\.(txt|md)$"))
