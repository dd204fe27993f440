"""Full texts: plain and Markdown files, Word documents and, where a reader is installed, PDF, as anchored text with their sections.

Files are read on the executors, one row each; a file that cannot be read is a row with its error.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "docx", "doc", "txt", "md", "markdown")
TEXT = "path string, sha256 string, text string, paragraphs long, tables long, pages long, characters long, needs_ocr boolean, error string"
FEW_CHARACTERS = 120
#: How headings of sections begin, in the order in which they are looked for (fixed values).
SECTIONS = {
    "abstract": r"^(?:abstract|摘要)\b",
    "introduction": r"^(?:\d+[.\s]*)?(?:introduction|引言|绪论)\b",
    "methods": r"^(?:\d+[.\s]*)?(?:methods?|methodology|材料与方法|研究方法)\b",
    "results": r"^(?:\d+[.\s]*)?(?:results?|结果)\b",
    "discussion": r"^(?:\d+[.\s]*)?(?:discussion|讨论)\b",
    "limitations": r"^(?:\d+[.\s]*)?(?:limitations?|局限)\b",
    "references": r"^(?:references|bibliography|参考文献)\b",
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word(content: bytes) -> dict:
    """A Word document: paragraphs with their anchors, headings marked, then the tables by rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines, n = [], 0
    for i, p in enumerate(tree.findall(f"{_W}p"), 1):
        if text := said(p).strip():
            style = p.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            mark = "## " if "heading" in name or "标题" in name else ""
            lines.append(f"<!-- paragraph:{i} -->\n{mark}[paragraph:{i}] {text}\n")
            n += 1
    tables = tree.findall(f"{_W}tbl")
    for i, t in enumerate(tables, 1):
        lines.append(f"\n## [table:{i}]\n")
        lines += ["| " + " | ".join(" ".join(said(p) for p in c.iter(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")) + " |" for r in t.findall(f"{_W}tr")]
    return {"text": "\n".join(lines), "paragraphs": n, "tables": len(tables), "characters": sum(map(len, lines)), "needs_ocr": False}


def pages(content: bytes) -> dict:
    """A PDF by pages; needs PyMuPDF. Pages of little text may need OCR, which is not done here."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        texts = [p.get_text("text").strip() for p in doc]
    whole = sum(map(len, texts))
    return {"text": "\n".join(f"<!-- page:{i} -->\n## [page:{i}]\n\n{t}\n" for i, t in enumerate(texts, 1)), "pages": len(texts), "characters": whole, "needs_ocr": whole / max(len(texts), 1) < FEW_CHARACTERS}


def lines(content: bytes) -> dict:
    """A plain text with an anchor before each line."""
    text = content.decode("utf-8-sig", "replace")
    return {"text": "\n".join(f"<!-- line:{i} -->\n{x}" for i, x in enumerate(text.splitlines(), 1)), "characters": len(text), "needs_ocr": False}


def extract(path: str, content: bytes) -> dict:
    end = path.rpartition(".")[2].lower()
    if end == "doc":
        raise ValueError("old Word format: save it as .docx")
    return {"docx": word, "pdf": pages}.get(end, lines)(content)


def texts_of(files: DataFrame) -> DataFrame:
    """TEXT rows of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TEXT.split(", ")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = extract(path, content)
                except Exception as e:  # noqa: BLE001  one file's error is a row
                    found = {"error": f"{type(e).__name__}: {e}"}
                rows.append(dict.fromkeys(names) | found | {"path": path, "sha256": hashlib.sha256(content).hexdigest()})
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in ("paragraphs", "tables", "pages", "characters")} | {"needs_ocr": "boolean"})

    return files.select("path", "content").mapInPandas(run, TEXT)


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Texts of all files under ``path`` of the suffixes in SUFFIXES."""
    ends = ",".join(sorted({f(s) for s in SUFFIXES for f in (str.lower, str.upper)}))
    return texts_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{ends}}}").load(path))


def section_of(line: Column) -> Column:
    """The section whose heading a line is, if it is one: 100 characters or less without marks."""
    clean = F.trim(F.regexp_replace(line, "[#*_]+", ""))
    name = F.coalesce(*[F.when(clean.rlike(f"(?i){p}"), F.lit(n)) for n, p in SECTIONS.items()])
    return F.when(F.char_length(clean) <= 100, name)


def detect_sections(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line, name, heading): lines, counted from 1, that are headings of sections."""
    x = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("i", "s"))
    return x.select(key, (F.col("i") + 1).cast("long").alias("line"), section_of(F.col("s")).alias("name"), F.trim(F.regexp_replace("s", "[#*_]+", "")).alias("heading")).where("name is not null")
