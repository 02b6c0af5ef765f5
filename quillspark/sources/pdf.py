"""PDF pages by an optional library, and inputs that cannot be read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T


def library_pages(data: bytes) -> list[str]:
    """Stripped text of each page, blank ones kept, by the installed PDF library; raises ImportError where there is none."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        return [(page.get_text("text") or "").strip() for page in doc]


def pdf_pages(files: DataFrame, parse: Callable[[bytes], list[str]] = library_pages) -> DataFrame:
    """(doc_id, name, page_number, page_text, error) of binary files (path, content): a row a page, numbered from 1.

    A file that parse cannot read gives one row with its error and no page; the others go on. Pages stay in physical
    order, blank ones too, so that numbers hold. doc_id is a prefix of the content's SHA-256.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, name = hashlib.sha256(data or b"").hexdigest()[:16], (path or "").rsplit("/", 1)[-1]
                try:
                    rows = [(own, name, i + 1, t, None) for i, t in enumerate(parse(data or b""))]
                except Exception as e:  # one unreadable file must not end the others
                    rows = [(own, name, None, None, f"{name}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    names = ["doc_id", "name", "page_number", "page_text", "error"]
    return files.select("path", "content").mapInArrow(run, "doc_id string, name string, page_number int, page_text string, error string")


def pdf_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]] = library_pages) -> DataFrame:
    return pdf_pages(spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path), parse)


def page_documents(pages: DataFrame, clean: bool = True) -> DataFrame:
    """(doc_id, text): each document's pages that are not blank, in order, parted by a blank line; cleaned page by page and as a whole."""
    body = T.clean_text(F.col("page_text")) if clean else F.col("page_text")
    rows = pages.withColumn("body", body).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("body") != "", F.struct("page_number", "body")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["body"]), "\n\n")
    return rows.select("doc_id", (T.clean_text(text) if clean else text).alias("text"))


NOTHING_READABLE = "no readable text or raster figures were found."


def routed(documents: DataFrame, figures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(readable documents, errors): documents (doc_id, name, text and, if any, error) without an error and with text or a figure; (doc_id, name, error) of the others."""
    rows = documents if "error" in documents.columns else documents.withColumn("error", F.lit(None).cast("string"))
    seen = figures.select("doc_id").distinct().withColumn("has_figure_", F.lit(True)) if figures is not None else None
    rows = rows.join(seen, "doc_id", "left") if seen is not None else rows.withColumn("has_figure_", F.lit(None).cast("boolean"))
    empty = (F.coalesce("text", F.lit("")) == "") & F.col("has_figure_").isNull()
    rows = rows.withColumn("error", F.coalesce("error", F.when(empty, F.concat("name", F.lit(f": {NOTHING_READABLE}"))))).drop("has_figure_")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("doc_id", "name", "error")
