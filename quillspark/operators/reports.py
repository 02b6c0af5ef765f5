"""Markdown reports: a part for each document and each saved question, joined in order only by the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def _listed(rows: DataFrame, order: str, line: str, name: str) -> DataFrame:
    """(doc_id, name): each document's lines in order."""
    joined = F.sort_array(F.collect_list(F.struct(order, line)))
    return rows.groupBy("doc_id").agg(F.transform(joined, lambda x: x[line]).alias(name))


def _or_else(lines: Column, sep: str, none: str) -> Column:
    return F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0, F.array_join(lines, sep)).otherwise(F.lit(none))


# Fixed values of a report.
HEADER_NOTE = "> Local, extractive analysis. Verify all evidence against the original papers."
NO_KEYWORDS, NO_EVIDENCE = "No keywords were detected.", "No domain-specific evidence was clearly detected."


def checked_names(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs with their name; raises ValueError unless names (doc_id, name) has one row for each document and no other."""
    met = docs.select("doc_id").join(names.select("doc_id", F.lit(1).alias("n_")), "doc_id", "full_outer")
    if not met.where("n_ is null").isEmpty() or names.count() != docs.count():
        raise ValueError("documents and names must go together one by one")
    return docs.join(names.select("doc_id", "name"), "doc_id")


def header_part(docs: DataFrame, title: str = "Document report") -> DataFrame:
    """(part): the report's head with the number of documents."""
    return docs.agg(F.concat(F.lit(f"# {title}\n\n{HEADER_NOTE}\n\nDocuments analyzed: "), F.count(F.lit(1)).cast("string")).alias("part"))


def document_parts(docs: DataFrame, summaries: DataFrame, keywords: DataFrame, hints: DataFrame) -> DataFrame:
    """(doc_id, part): title, summary, keywords and evidence by category of each document (doc_id, name).

    Takes the rows of summary_texts, keywords and domain_hints; hints with a page_number cite it. Categories without
    evidence are left out, and what is missing altogether is said in a sentence. A null or blank name is the doc_id.
    """
    title = F.coalesce(F.nullif(T.strip(F.col("name")), F.lit("")), F.col("doc_id").cast("string"))
    if "page_number" in hints.columns:
        hints = hints.withColumn("hint", T.cite(F.col("hint"), F.col("page_number")))
    found = hints.where("hint is not null").groupBy("doc_id", "category").agg(F.sort_array(F.collect_list(F.struct("hint_no", "hint"))).alias("h"))
    block = F.concat(F.lit("#### "), F.initcap(F.replace("category", F.lit("_"), F.lit(" "))), F.lit("\n"), F.array_join(F.transform("h", lambda x: F.concat(F.lit("- "), x["hint"])), "\n"))
    parts = (
        docs.select("doc_id", title.alias("title"))
        .join(summaries.select("doc_id", "summary"), "doc_id", "left")
        .join(_listed(keywords, "rank", "keyword", "words"), "doc_id", "left")
        .join(_listed(found.select("doc_id", "category", block.alias("block")), "category", "block", "evidence"), "doc_id", "left")
    )
    body = F.concat_ws(
        "\n\n",
        F.lit("---"),
        F.concat(F.lit("## "), F.col("title")),
        F.col("summary"),
        F.lit("### Keywords"),
        _or_else(F.col("words"), ", ", NO_KEYWORDS),
        F.lit("### Domain evidence"),
        _or_else(F.col("evidence"), "\n\n", NO_EVIDENCE),
    )
    return parts.select("doc_id", body.alias("part"))


def question_parts(history: DataFrame) -> DataFrame:
    """(asked_ord, part) of saved questions (asked_ord from 1, question, target, answer); blank ones go, numbers stay.

    A heading at the start of an answer is set one level lower; a null target is all papers.
    """
    asked = history.where(T.strip(F.coalesce("question", F.lit(""))) != "").where(T.strip(F.coalesce("answer", F.lit(""))) != "")
    answer = F.regexp_replace(T.strip(F.col("answer")), r"^### ", "#### ")
    heading = F.concat(F.lit("### Q"), F.col("asked_ord").cast("string"), F.lit(". "), T.strip(F.col("question")))
    target = F.concat(F.lit("**Target:** "), T.strip(F.coalesce("target", F.lit("All papers"))))
    return asked.select("asked_ord", F.concat_ws("\n\n", heading, target, answer).alias("part"))


def report_parts(header: DataFrame, documents: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(block, ord, part): head, documents by doc_id, and saved questions under a heading of their own, ready to be written in order."""
    rows = header.select(F.lit(0).alias("block"), F.lit(0).cast("long").alias("ord"), "part")
    rows = rows.unionByName(documents.select(F.lit(1).alias("block"), F.col("doc_id").cast("long").alias("ord"), "part"))
    if questions is None:
        return rows
    head = questions.limit(1).select(F.lit(2).alias("block"), F.lit(-1).cast("long").alias("ord"), F.lit("---\n\n## Questions and grounded answers").alias("part"))
    return rows.unionByName(head).unionByName(questions.select(F.lit(2).alias("block"), F.col("asked_ord").cast("long").alias("ord"), "part"))


def write_report(parts: DataFrame, path: str, *order: str) -> None:
    """Write parts as text files that follow each other in order; nothing is collected."""
    parts.orderBy(*(order or ("doc_id",))).select(F.concat("part", F.lit("\n")).alias("value")).write.text(path)
