"""PDF files go through all passes of the ingest, in batch and in a stream, with stand-in readers."""

from pyspark.sql import functions as F

from gradelake.sources import files
from gradelake.streaming import sessions as streams

LONG = "A page with enough text to be kept as a document, and some more. "


def readers():
    """Functions of a function, which go to the workers by value."""

    def first(content):
        if content.startswith(b"broken"):
            raise ValueError("no such page")
        return content.decode() if content.startswith(b"A page") else ""

    def fallback(content):
        return "The second reader found this text, which is long enough to be kept." if content == b"second" else ""

    def pages(content):
        return [("", [b"i" * 6000, b"small"], b""), ("", [], b"r" * 7000)] if content in (b"images", b"broken images") else []

    def describe(picture):
        return f"a picture of {len(picture)} bytes"

    def ocr(content):
        return "Text that was recognised in the scanned page, longer than all else that had been found before it; so it counts." if content == b"scan" else ""

    return files.PdfReaders(first, fallback, pages, describe, ocr)


CONTENTS = {"text.pdf": LONG.encode(), "second.pdf": b"second", "images.pdf": b"images", "scan.PDF": b"scan", "broken.pdf": b"broken", "rescued.pdf": b"broken images", "little.pdf": b"little", "n.txt": LONG.encode()}


def check(good, bad):
    assert set(good) == {"text.pdf", "second.pdf", "images.pdf", "scan.PDF", "rescued.pdf", "n.txt"}
    assert good["text.pdf"].content == LONG and good["second.pdf"].content.startswith("The second reader")
    assert good["scan.PDF"].content.startswith("Text that was recognised")
    visual = good["images.pdf"].content
    assert "Page 1]\na picture of 6000 bytes" in visual and "Page 2]\na picture of 7000 bytes" in visual and "small" not in visual
    assert good["images.pdf"].extraction_stats.visuals == 2 and good["rescued.pdf"].content == visual
    assert bad == {"broken.pdf": "ValueError: no such page", "little.pdf": "Not enough text"}


def rows(good, bad):
    return {r.original_name: r for r in good.collect()}, {r.path.split("/")[-1]: r.reason for r in bad.collect()}


def test_ingest_takes_all_passes(spark, tmp_path):
    for name, content in CONTENTS.items():
        (tmp_path / name).write_bytes(content)
    check(*rows(*files.ingested(files.files(spark, str(tmp_path)), pdf=readers())))
    # Without a library for PDF the other files are ingested and these say why they are not.
    good, bad = rows(*files.ingested(files.files(spark, str(tmp_path)), pdf=files.PdfReaders(first=files.pdf_text)))
    assert set(good) == {"n.txt"} and len(bad) == 7 and (len(set(bad.values())) == 1 or "pdfplumber" not in str(bad))


def test_stream_takes_all_passes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in CONTENTS.items():
        (folder / name).write_bytes(content)
    out, bad = str(tmp_path / "docs"), str(tmp_path / "bad")
    streams.ingest_stream(spark, str(folder), out, bad, str(tmp_path / "ck"), readers())
    streams.ingest_stream(spark, str(folder), out, bad, str(tmp_path / "ck"), readers())
    found = spark.read.parquet(out)
    assert found.count() == 6 and found.select(F.count_distinct("id")).first()[0] == 6
    check(*rows(found, spark.read.parquet(bad)))
