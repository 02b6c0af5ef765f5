"""Text file sources, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

BINARY = "path string, modificationTime timestamp, length long, content binary"


def decoded(files: DataFrame) -> DataFrame:
    """(doc_id, name, text): bytes that are not UTF-8 are dropped, then the text is cleaned; doc_id is a prefix of the digest."""
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return files.select(
        F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), T.clean_text(text).alias("text")
    )


def text_files(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))
