"""Lines of report documents: text, word-processor files, PDF through pdftotext, folders and zips of them."""

from __future__ import annotations

import io
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "source_file string, line_no long, line string"
SUFFIXES = (".pdf", ".docx", ".txt")


def docx_lines(data: bytes) -> list[str]:
    """Rows of tables first, cells joined by a space, then all paragraphs; so text in tables comes twice."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    rows = [" ".join(x for x in (said(c).strip() for c in r.findall(f"{_W}tc")) if x) for r in root.iter(f"{_W}tr")]
    return [x for x in [*rows, *(said(p) for p in root.iter(f"{_W}p"))] if x.strip()]


def pdf_lines(data: bytes) -> list[str]:
    if shutil.which("pdftotext") is None:
        raise RuntimeError("reading PDF needs the pdftotext program")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(data)
        f.flush()
        return subprocess.run(["pdftotext", "-layout", f.name, "-"], check=True, capture_output=True, text=True).stdout.splitlines()


def documents(name: str, data: bytes) -> Iterator[tuple[str, list[str]]]:
    """(file name, lines) of a document, or of all documents of a zip by name; lock files are skipped."""
    base, kind = PurePosixPath(name).name, PurePosixPath(name).suffix.lower()
    if base.startswith("~$"):
        return
    if kind == ".zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in sorted(z.namelist()):
                if PurePosixPath(n).suffix.lower() in SUFFIXES:
                    yield from documents(n, z.read(n))
    elif kind == ".docx":
        yield base, docx_lines(data)
    elif kind == ".pdf":
        yield base, pdf_lines(data)
    elif kind == ".txt":
        yield base, data.decode("utf-8", "replace").splitlines()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, line) of a document, a zip, or a folder and those below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                for file, lines in documents(name, data):
                    yield pd.DataFrame({"source_file": file, "line_no": range(1, len(lines) + 1), "line": lines})

    return files.mapInPandas(extract, SCHEMA)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a list file, without comments and blanks."""
    from pyspark.sql import functions as F

    line = F.trim("value")
    return spark.read.text(path).select(line.alias("path")).where((F.col("path") != "") & ~F.startswith("path", F.lit("#")))
