"""A workspace as one text: its documents follow each other, parted by blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators import documents as O


def target_documents(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, columns of docs): each target's documents; a target whose doc_id is null takes all of them."""
    t = targets.select("target_id", F.col("doc_id").alias("wanted_"))
    one = docs.join(t.where("wanted_ is not null"), F.col("doc_id") == F.col("wanted_"))
    every = docs.crossJoin(t.where("wanted_ is null"))
    return one.unionByName(every).select("target_id", *docs.columns)


def corpus_parts(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """(order, part): parts that make up the combined text when they follow each other in order; no row holds the whole."""
    last = docs.agg(F.max(order).alias("last_"))
    return docs.crossJoin(F.broadcast(last)).select(order, F.concat(F.coalesce("text", F.lit("")), F.when(F.col(order) < F.col("last_"), "\n\n").otherwise("")).alias("part"))


def corpus_keywords(docs: DataFrame, by: str = "workspace", order: str = "doc_id", top: int = 15, features: int = 500, stop: list[str] = L.STOP_WORDS) -> DataFrame:
    """(by, rank, keyword, score): keywords of each workspace's documents as one text.

    Terms are counted document by document and summed; the pair that ends one document and begins the next that has
    words is added. So no text is put together. Documents are cleaned one by one.
    """
    clean = T.clean_text(F.col("text"))
    words = F.filter(F.regexp_extract_all(F.lower(clean), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(stop))
    ends = T.once(words, lambda w: F.struct(F.get(w, F.lit(0)).alias("first"), F.get(w, F.size(w) - 1).alias("last")))
    counted = O.term_rows(docs.withColumn("clean_", clean), [by], "clean_", stop)
    edge = docs.select(by, order, ends.alias("e")).where("e.first is not null")
    pairs = edge.select(by, F.concat(F.lag("e.last").over(Window.partitionBy(by).orderBy(order)), F.lit(" "), "e.first").alias("term"), F.lit(1).alias("tf")).where("term is not null")
    tf = counted.unionByName(pairs).groupBy(by, "term").agg(F.sum("tf").alias("tf"))
    kept = tf.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("tf"), "term"))).where(F.col("rank") <= features)
    norm = F.sqrt(F.sum((F.col("tf") * F.col("tf")).cast("double")).over(Window.partitionBy(by)))
    return kept.withColumn("score", F.round(F.col("tf") / norm, 6)).where(F.col("rank") <= top).select(by, "rank", F.col("term").alias("keyword"), "score")


def workspace_signature(docs: DataFrame) -> DataFrame:
    """(n_docs, signature): changes when a document's name, length or text does."""
    own = F.xxhash64("name", F.length("text"), "text")
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.bit_xor(own).alias("signature"))
