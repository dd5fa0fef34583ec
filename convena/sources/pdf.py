"""Pages of PDF files. The reader is a function from bytes to texts, so another one, or OCR, can take its place; pypdf is used where it is installed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import file_error

Reader = Callable[[bytes], list[str]]


def pypdf_pages(data: bytes) -> list[str]:
    import io

    from pypdf import PdfReader  # an optional dependency

    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        raise ValueError("PDF_ENCRYPTED")
    return [page.extract_text() or "" for page in reader.pages]


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), F.col("content").alias("data"), F.lit("application/pdf").alias("mime"))


def pages(documents: DataFrame, read: Reader = pypdf_pages) -> DataFrame:
    """(doc, page, text, error) of ``documents`` (doc, data, mime); a file that can't be read has one row with its error and neither page nor text, and doesn't stop others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, data, error in zip(b["doc"], b["data"], b["error"], strict=True):
                try:
                    if error:
                        raise ValueError(error)
                    rows += [(doc, i, t, None) for i, t in enumerate(read(bytes(data)), 1)]
                except Exception as e:  # noqa: BLE001  one file's failure is a row
                    rows.append((doc, None, None, str(e) if isinstance(e, ValueError) else type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "error"]).astype({"page": "Int32"})

    checked = documents.select("doc", "data", file_error(F.col("data"), F.col("mime")).alias("error"))
    kind = checked.schema["doc"].dataType.simpleString()
    return checked.mapInPandas(run, f"doc {kind}, page int, text string, error string")
