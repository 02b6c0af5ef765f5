"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, langid, lines, neardup, packing
from quillspark.llm.common import same_schema, settle, shared_dir
from quillspark.llm.queries import tokenizer_path


def _bare(docs: DataFrame) -> DataFrame:
    """What an operator reads, and all columns but text in one: no column of the table clashes with an operator's own."""
    return docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others"))


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, with the operator's text and its length."""
    own = {"text": F.col("text"), "n_chars": F.length("text")}
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return out.select(*[own.get(c, F.col(f"others.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a calibrated model accepts; learned from the labelled rows outside the held-out fold.

    Null, empty and letterless texts go. With no labelled row there is no model, and no document is accepted.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return _back(langid.identify(_bare(docs), model).where("not rejected"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more of them hold; one that nothing is left of goes."""
    kept = lines.dedup_lines(_bare(docs)).where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return _back(kept, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the least doc_id, null being the greatest, and the first of its rows.

    Rows are told apart by a number of their own, so null and repeated doc_ids lose and keep no other row.
    """
    rows = settle(docs.withColumn("row_number_", F.monotonically_increasing_id()))
    classes = neardup.near_duplicates(rows.select(F.col("row_number_").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_number_"), "class_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_number_")
    kept = rows.select("row_number_", "doc_id").join(classes, "row_number_").groupBy("class_id").agg(F.min_by("row_number_", order).alias("row_number_"))
    return same_schema(rows.join(kept, "row_number_", "left_semi"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out; those that are mostly such passages go."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _back(decontam.decontaminate(_bare(docs), tests).where("not dropped"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(packing.tokenize(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language scores and weighted samples are not SQL; tests/llm/test_pipeline.py holds each stage, and run(), against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
