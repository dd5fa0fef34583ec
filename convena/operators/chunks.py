"""Pages of a document: their quality, and chunks of them for a reader with a limit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MOST_BYTES, LEAST_CHUNK, CHUNK = 20 * 1024 * 1024, 500, 40_000


def file_error(data: Column, mime: Column) -> Column:
    """Why a file is no PDF that can be read, or null: size, then signature, then type."""
    kind = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return F.when(F.octet_length(data) > MOST_BYTES, F.lit("PDF_TOO_LARGE")).when(F.substring(data, 1, 5) != F.lit(b"%PDF-"), F.lit("INVALID_PDF_SIGNATURE")).when(~kind.isin("application/pdf", "application/octet-stream"), F.lit("INVALID_PDF_MIME"))


def page_quality(pages: DataFrame) -> DataFrame:
    """``pages`` (doc, page, text) with the text normalised, its quality, and whether it needs OCR."""
    clean = pages.withColumn("text", text.page_lines(F.coalesce("text", F.lit(""))))
    quality = text.text_quality(F.col("text"))
    return clean.withColumns({"quality": quality, "needs_ocr": text.needs_ocr(F.col("text"), quality), "method": F.lit("text_layer")})


def with_ocr(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Pages that need it take the text that OCR read (doc, page, ocr_text), where its quality is greater."""
    new = read.select("doc", "page", text.page_lines(F.col("ocr_text")).alias("ocr_text"))
    joined = pages.join(new, ["doc", "page"], "left")
    better = F.coalesce(F.col("needs_ocr") & (text.text_quality(F.col("ocr_text")) > F.col("quality")), F.lit(False))
    columns = {"text": F.col("ocr_text"), "quality": text.text_quality(F.col("ocr_text")), "needs_ocr": F.lit(False), "method": F.lit("ocr")}
    return joined.withColumns({c: F.when(better, new_).otherwise(F.col(c)) for c, new_ in columns.items()}).drop("ocr_text")


def document_quality(pages: DataFrame) -> DataFrame:
    """(doc, quality, status, warnings): failed without any text, partial if a page needs OCR, else success."""
    warned = F.transform(F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page")))), lambda p: F.concat(F.lit("OCR_CANDIDATE_PAGE_"), p))
    status = F.when(F.bool_and(F.col("text") == ""), F.lit("failed")).when(F.bool_or("needs_ocr"), F.lit("partial")).otherwise(F.lit("success"))
    return pages.groupBy("doc").agg(F.bround(F.avg("quality"), 4).alias("quality"), status.alias("status"), warned.alias("warnings"))


def chunk_pages(pages: list[tuple[int, str]], size: int) -> list[dict]:
    """Pages in order, each piece marked with its page, as many to a chunk as fit; a page too long for one is sliced."""
    pieces = []
    for number, body in pages:
        mark = f"[page {number}]\n"
        room = size - len(mark)
        pieces += [(number, mark + body[i : i + room]) for i in range(0, max(1, len(body)), room)]
    chunks: list[list[tuple[int, str]]] = []
    held = 0
    for number, piece in pieces:
        if not chunks or held + 1 + len(piece) > size:
            chunks.append([])
            held = -1
        chunks[-1].append((number, piece))
        # White space at the end of a chunk goes before the next piece is added.
        held = len("\n".join(p for _, p in chunks[-1]).strip()) if piece != piece.strip() or held < 0 else held + 1 + len(piece)
    out = []
    for i, parts in enumerate(chunks):
        joined = ""
        for _, p in parts:
            joined = f"{joined}\n{p}".strip()
        out.append({"chunk_index": i, "page_from": parts[0][0], "page_to": parts[-1][0], "text": joined, "text_hash": hashlib.sha256(joined.encode()).hexdigest()})
    return out


def chunks(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc, chunk_index, page_from, page_to, text, text_hash). A fold over the pages of a document: they come sorted, so only one document is held."""
    if size < LEAST_CHUNK:
        raise ValueError(f"chunk size must be at least {LEAST_CHUNK}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        frame = lambda: pd.DataFrame([{"doc": now, **c} for c in chunk_pages(held, size)], columns=["doc", "chunk_index", "page_from", "page_to", "text", "text_hash"])
        for b in batches:
            for doc, page, body in zip(b["doc"], b["page"], b["text"], strict=True):
                if doc != now:
                    if held:
                        yield frame()
                    now, held = doc, []
                held.append((int(page), body or ""))
        if held:
            yield frame()

    kind = pages.schema["doc"].dataType.simpleString()
    ordered = pages.select("doc", "page", "text").repartition("doc").sortWithinPartitions("doc", "page")
    return ordered.mapInPandas(run, f"doc {kind}, chunk_index int, page_from int, page_to int, text string, text_hash string")
