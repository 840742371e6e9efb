"""Documents as files: plain text and DOCX bytes to text, in Arrow batches with the standard library.

PDF bytes need a library that is not there: such files come back with the reason in ``error``.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import ship

RESULT = "struct<text:string,links:array<string>,error:string>"
#: Extensions that are read, and the namespaces of the format.
EXTENSIONS = ["pdf", "docx", "txt"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_HYPERLINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"
#: Bytes of unpacked XML that a file may hold; a larger one is an error, not a shortened text.
MOST_XML = 64 << 20


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > MOST_XML:
        raise ValueError(f"{name} is larger than {MOST_XML} bytes")
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:4096]:
        raise ValueError("document types are not read")
    return ElementTree.fromstring(raw)


def _paragraph(p: ElementTree.Element) -> str:
    marks = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    out = []
    for run in p.iter(_W + "r"):
        for child in run:
            out.append(child.text or "" if child.tag == _W + "t" else marks.get(child.tag, ""))
    return "".join(out).strip()


def docx_text(content: bytes) -> tuple[str, list[str]]:
    """Paragraphs and table rows in the body's order, cells joined by bars, and the targets of outside links."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        lines = []
        for child in _part(z, "word/document.xml").find(_W + "body"):
            if child.tag == _W + "p":
                lines.append(_paragraph(child))
            elif child.tag == _W + "tbl":
                for row in child.findall(_W + "tr"):
                    cells = ["\n".join(_paragraph(p) for p in cell.findall(_W + "p")).strip() for cell in row.findall(_W + "tc")]
                    lines.append(" | ".join(c for c in cells if c))
        rels = "word/_rels/document.xml.rels"
        found = _part(z, rels) if rels in z.namelist() else []
        return "\n".join(x for x in lines if x), [r.get("Target") for r in found if r.get("Type") == _HYPERLINK and r.get("TargetMode") == "External"]


def _read(extension: str, content: bytes | None) -> dict:
    text, links, error = None, [], None
    try:
        if extension not in EXTENSIONS:
            error = "unsupported file type"
        elif extension == "pdf":
            error = "no reader of PDF files"
        elif extension == "docx":
            text, links = docx_text(content or b"")
        else:
            text = (content or b"").decode("utf-8", errors="replace")
    except Exception as e:  # whatever a broken file raises belongs to that file's row
        error = f"{type(e).__name__}: {e}"
    return {"text": text, "links": links, "error": error}


def tidy(text: Column) -> Column:
    """Line ends as \\n, no white space at line ends, at most two blank lines in a row, none at the edges."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?U)[\s&&[^\n]]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(lines, "\n{4,}", "\n\n\n"), r"^\n+|\n+$", "")


def file_text(name: Column, content: Column) -> Column:
    """struct<text, links, error> of a file's bytes; the extension of its name decides how they are read.

    Null or empty text files have an empty text; unsupported, broken and PDF files have a null text and an error.
    """

    @F.pandas_udf(RESULT)
    def parsed(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(e, c) for e, c in zip(extension, content, strict=True)], columns=["text", "links", "error"])

    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    return parsed(F.coalesce(extension, F.lit("")), content)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, links, error) of every file below a folder that holds bytes; Spark's reader leaves empty files out."""
    ship(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return raw.withColumn("__f", file_text(F.col("path"), F.col("content"))).select("path", tidy(F.col("__f.text")).alias("text"), "__f.links", "__f.error")
