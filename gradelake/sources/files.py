"""Files to documents: routing by extension, text, DOCX and PDF readers, and the ingest plan.

Only what a format's library must do runs in Python, a batch of files at a time; routing,
gates, titles and statistics are expressions.
"""

from __future__ import annotations

import importlib.util
import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.operators import chunking

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ASIDE = "\ufdd0\ufdd1"  # noncharacters, which no text interchange has
LEAST_IMAGE_BYTES = 5000
LEAST_PAGE_TEXT = 100
KINDS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "text", "md": "text"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_kind(path: Column) -> Column:
    """pdf, docx or text by extension, else null: such files are rejected."""
    extension = T.file_extension(file_name(path))
    return F.coalesce(*[F.when(extension == e, k) for e, k in KINDS.items()])


def markdown(rows: list[list[str | None]]) -> str:
    """One table as Markdown; the expression for columns is ``gradelake.functions.text.table_markdown``."""
    if not rows or not rows[0]:
        return ""
    cells = [[(c or "").strip() for c in r] for r in rows]
    width = len(cells[0])
    lines = [cells[0], ["---"] * width, *[r + [""] * (width - len(r)) for r in cells[1:]]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, then tables as Markdown in [TABLE] marks, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    parts = [p for p in (said(n) for n in body.findall(f"{_WORD}p")) if p.strip()]
    for table in body.findall(f"{_WORD}tbl"):
        rows = [[said(c) for c in r.findall(f"{_WORD}tc")] for r in table.findall(f"{_WORD}tr")]
        if found := markdown(rows):
            parts.append(f"[TABLE]\n{found}\n[/TABLE]")
    return "\n".join(parts)


def pdf_text(content: bytes) -> str:
    """Text and tables of a PDF page by page; needs the optional library pdfplumber."""
    if importlib.util.find_spec("pdfplumber") is None:
        raise RuntimeError("reading PDF needs pdfplumber, which is not installed")
    import pdfplumber

    parts = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            if (found := page.extract_text() or "").strip():
                parts.append(found)
            parts += [f"[TABLE]\n{markdown(t)}\n[/TABLE]" for t in page.extract_tables() if t and len(t) > 1]
    return "\n\n".join(parts)


def passes(first: Column, fallback: Column, described: Column, ocr: Column) -> Column:
    """Which extraction counts: the second if the first is empty; OCR if under 100 characters are there and it is longer.

    Once text was found and no image described, OCR is not asked.
    """
    none = lambda c: F.coalesce(c, F.lit(""))
    text = F.when(none(first) != "", none(first)).otherwise(none(fallback))
    both = F.array_join(F.filter(F.array(text, none(described)), lambda p: p != ""), "\n\n")
    asked = (text == "") | (none(described) != "")
    return F.when(asked & (F.length(both) < 100) & (F.length(none(ocr)) > F.length(both)), none(ocr)).otherwise(both)


def worth_describing(content: Column) -> Column:
    """Images are described from 5,000 bytes on."""
    return F.coalesce(F.octet_length(content) >= LEAST_IMAGE_BYTES, F.lit(False))


def worth_rendering(page_text: Column, n_images: Column) -> Column:
    """A whole page is rendered if it has little text and no image."""
    return (F.length(F.coalesce(page_text, F.lit(""))) < LEAST_PAGE_TEXT) & (n_images == 0)


@dataclass
class PdfReaders:
    """What a PDF needs of libraries and models, each replaceable and each allowed to fail."""

    first: Callable[[bytes], str] = pdf_text
    fallback: Callable[[bytes], str] | None = None
    #: (text, images, rendered page) of each page
    pages: Callable[[bytes], list[tuple[str, list[bytes], bytes]]] | None = None
    describe: Callable[[bytes], str | None] | None = None
    ocr: Callable[[bytes], str] | None = None


def pdf_documents(found: DataFrame, readers: PdfReaders) -> DataFrame:
    """(path, text, error) of PDF files in up to three passes (see ``passes``).

    Pages are exploded, and only images and renderings worth it are described, each on its own;
    OCR reads only files that the first passes left with little text. A reader that fails
    counts as one that found nothing; where nothing was found at all, ``error`` is what the
    first reader that failed said.
    """

    def tried(reader, content, none, said=None):
        try:
            return none if reader is None else reader(content) or none
        except Exception as e:  # noqa: BLE001
            if said is not None:
                said.append(f"{type(e).__name__}: {e}")
            return none

    @F.pandas_udf("first string, fallback string, pages array<struct<text:string,images:array<binary>,rendered:binary>>, error string")
    def read(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contents:
            said: list[str] = []
            first = tried(readers.first, c, "", said)
            pages = [{"text": t, "images": list(images), "rendered": rendered} for t, images, rendered in (tried(readers.pages, c, []) if readers.describe else [])]
            rows.append((first, "" if first else tried(readers.fallback, c, "", said), pages, said[0] if said else None))
        return pd.DataFrame(rows, columns=["first", "fallback", "pages", "error"])

    @F.pandas_udf("string")
    def described(pictures: pd.Series) -> pd.Series:
        return pictures.map(lambda p: tried(readers.describe, p, None))

    @F.pandas_udf("string")
    def recognised(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else tried(readers.ocr, c, None))

    # Taken apart a step later, so that a file is read once a row.
    rows = found.select("path", "content", read.asNondeterministic()("content").alias("_r")).select("path", "content", "_r.*")
    pages = rows.select("path", F.posexplode("pages").alias("page", "p"))
    whole = F.when(worth_rendering(T.strip(F.col("p.text")), F.size("p.images")) & (F.octet_length("p.rendered") > LEAST_IMAGE_BYTES), F.array("p.rendered"))
    pictures = F.concat(F.filter("p.images", worth_describing), F.coalesce(whole, F.array().cast("array<binary>")))
    seen = pages.select("path", "page", F.posexplode(pictures).alias("i", "picture")).withColumn("said", described("picture")).where("said <> ''")
    block = F.concat(F.lit("\n[VISUAL CONTENT — Page "), (F.col("page") + 1).cast("string"), F.lit("]\n"), F.col("said"), F.lit("\n[/VISUAL CONTENT]\n"))
    listed = F.array_sort(F.collect_list(F.struct("page", "i", block.alias("b"))))
    visual = seen.groupBy("path").agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("described"))
    met = rows.join(visual, "path", "left")
    none = F.lit(None).cast("string")
    before = passes(F.col("first"), F.col("fallback"), F.col("described"), none)
    little = (F.length(before) < LEAST_PAGE_TEXT) & ((before == "") | (F.coalesce("described", F.lit("")) != ""))
    met = met.withColumn("ocr", recognised(F.when(little, F.col("content"))))
    met = met.select("path", passes(F.col("first"), F.col("fallback"), F.col("described"), F.col("ocr")).alias("text"), "error")
    return met.withColumn("error", F.when(F.col("text") == "", F.col("error")))


def extracted(found: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None, pdf: PdfReaders | None = None) -> DataFrame:
    """Files with ``kind``, ``text`` and ``error``: unsupported kinds and unreadable files say why.

    Text files are decoded by expression, broken bytes dropped; PDF files go through all their
    passes with the readers ``pdf``; the other kinds go through ``readers`` (bytes to text), of
    which a failing one does not fail the job.
    """
    readers = {"docx": docx_text} | (readers or {})

    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, contents in batches:
            out = []
            for kind, content in zip(kinds, contents, strict=True):
                try:
                    out.append((readers[kind](content), None) if kind in readers else (None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["text", "error"])

    rows = found.withColumn("kind", file_kind(F.col("path")))
    # Undecodable bytes become U+FFFD and go; one that the text holds itself is put aside meanwhile.
    aside = F.replace(F.col("content").cast("string"), F.lit("\ufffd"), F.lit(_ASIDE))
    plain = F.replace(F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit("")), F.lit(_ASIDE), F.lit("\ufffd"))
    is_text = F.coalesce(F.col("kind") == "text", F.lit(False))
    text_rows = rows.where(is_text).withColumns({"text": plain, "error": F.lit(None).cast("string")})
    unknown = rows.where("kind is null").withColumns({"text": F.lit(None).cast("string"), "error": F.lit("Unsupported file type")})
    binary = rows.where(F.col("kind").isin(*readers)).withColumn("_r", read("kind", "content"))
    binary = binary.withColumns({"text": F.col("_r.text"), "error": F.col("_r.error")}).drop("_r")
    out = text_rows.unionByName(binary).unionByName(unknown)
    if "pdf" in readers:
        return out
    pdfs = rows.where("kind = 'pdf'")
    read_pdfs = pdf_documents(pdfs.select("path", "content"), pdf or PdfReaders())
    return out.unionByName(pdfs.join(read_pdfs, "path").select(*out.columns))


def ingested(found: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None, pdf: PdfReaders | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with chunks and statistics, rejected files with the reason)."""
    rows = extracted(found, readers, pdf).withColumn("original_name", file_name(F.col("path")))
    enough = F.length(T.strip(F.coalesce("text", F.lit("")))) >= chunking.LEAST_TEXT
    reason = F.coalesce("error", F.when(~enough, "Not enough text"))
    good = rows.where(reason.isNull()).select(F.xxhash64("path").alias("id"), T.file_title(F.col("original_name")).alias("title"), "original_name", F.col("text").alias("content"), F.lit("parsed").alias("status"), F.col("modificationTime").alias("uploaded_at"))
    good = chunking.with_chunks(good, F.col("content"), F.col("title"))
    stats = F.struct(T.occurrences(F.col("content"), F.lit("[TABLE]")).alias("tables"), T.occurrences(F.col("content"), F.lit("[VISUAL CONTENT")).alias("visuals"), F.size("chunks").alias("chunks"))
    return good.withColumn("extraction_stats", stats), rows.where(reason.isNotNull()).select("path", reason.alias("reason"))


def written(documents: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append documents as Parquet, or as JSON lines."""
    documents.write.mode("append").format(fmt).save(path)


def results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that hold none) of a file of JSON results, one a line, whatever was printed before the first brace."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("_j", F.from_json(T.json_object(F.col("value")), f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    hit = F.contains("value", F.lit("{")) & F.col("_j").isNotNull() & F.col("_j._broken").isNull()
    return parsed.where(hit).select("_j.*").drop("_broken"), parsed.where(~hit).select("value")
