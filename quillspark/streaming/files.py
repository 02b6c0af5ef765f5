"""Documents that arrive as files; every row operator works on the stream unchanged, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources import files


def text_file_stream(spark: SparkSession, path: str, glob: str = "*.{txt,md}", per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(files.BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger)
    return files.decoded(reader.load(path))
