"""Registered queries over whole tables; quillspark.plans.expected holds the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import markup as M
from quillspark.functions import text as T
from quillspark.operators import corpus as C
from quillspark.operators import documents as O
from quillspark.operators import evidence as E
from quillspark.operators import figures as G
from quillspark.operators import reports as R
from quillspark.plans import fixtures as X
from quillspark.sources import pdf

#: Headings and lexicons that the tables' invented prose has, beside the default ones.
ALIASES = {"abstract": ["abstract", "the"], "introduction": ["introduction"], "methods": ["methods", "of", "experimental"], "results": ["results", "and"], "conclusion": ["conclusions", "summary"], "references": ["references", "to"]}
GROUPS = {**L.DOMAIN, **L.COMMON}
ROLES = {**L.ROLES, "main_focus": [*L.ROLES["main_focus"], "with"], "result": [*L.ROLES["result"], "was"]}
DIMENSIONS = {**L.DIMENSIONS, "Relations": L.COMMON["relation"]}
QUESTIONS = [
    (1, "What material is studied?"), (2, "How is the sample prepared?"), (3, "What does the result show?"), (4, "What are the limitations?"),
    (5, "How is the oxide film grown?"), (6, "What temperature and voltage are used?"), (7, "Why?"), (8, "材料是什么？"), (9, "  "), (10, "qqqq zzzz xxxx"),
]


def _spread(df: DataFrame) -> DataFrame:
    """A table is dealt to all cores unless its splits fill them evenly; a file of one row group is read by one task alone.

    Counting the rows of the splits reads no column. Splits without rows do not count.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return df.repartition(4 * n) if max(held, default=0) * n > 1.5 * sum(held) else df


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "n_chars"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and the small texts of rules that they do not reach."""
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(X.TEXTS)], "doc_id long, text string")
    return _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(own))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = spark.createDataFrame(X.PAGES, "doc_id long, page_number int, page_text string")
    return turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("page_text")).unionByName(own)


def _paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.page_documents(_pages(spark, sf_dir))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id long, query string")


def clean_text_stats(spark, sf_dir):
    c = T.clean_text(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", F.length(c).cast("long").alias("clean_chars"), F.sha2(c, 256).alias("clean_sha256"))


def word_counts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


def logical_lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(T.logical_lines(F.col("text"))).alias("line_no", "line"))


def sentences(spark, sf_dir):
    return O.sentence_rows(_texts(spark, sf_dir))


def sentence_quality(spark, sf_dir):
    """Both filters on every end-marked piece of every line."""
    pieces = F.filter(F.flatten(F.transform(T.logical_lines(F.col("text")), lambda x: F.split(x, r"(?<=[.!?。！？]) "))), lambda x: x != "")
    rows = _texts(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("position", "s"))
    return rows.select("doc_id", "position", T.is_noisy(F.col("s")).alias("noisy"), T.is_bad_for_summary(F.col("s")).alias("bad_for_summary"))


def passages(spark, sf_dir):
    return O.page_passages(_pages(spark, sf_dir))


def document_passages(spark, sf_dir):
    return O.passage_rows(_texts(spark, sf_dir), 60)


def term_hits(spark, sf_dir):
    return O.term_hits(_texts(spark, sf_dir), GROUPS)


def domain_hints(spark, sf_dir):
    return O.domain_hints(_texts(spark, sf_dir), GROUPS)


def cited_hints(spark, sf_dir):
    return O.domain_hints(_paged_documents(spark, sf_dir), GROUPS, pages=_pages(spark, sf_dir))


def sections(spark, sf_dir):
    return O.sections(_texts(spark, sf_dir), ALIASES)


def summary_candidates(spark, sf_dir):
    return O.summary_candidates(_texts(spark, sf_dir), ALIASES)


def role_evidence(spark, sf_dir):
    return O.role_evidence(_texts(spark, sf_dir), ALIASES, ROLES)


def research_brief(spark, sf_dir):
    return O.research_brief(_paged_documents(spark, sf_dir), ALIASES, ROLES, pages=_pages(spark, sf_dir))


def keywords(spark, sf_dir):
    return O.keywords(_texts(spark, sf_dir))


def keyword_overlap(spark, sf_dir):
    return O.keyword_overlap(_texts(spark, sf_dir))


def keyword_table(spark, sf_dir):
    return E.keyword_table(_texts(spark, sf_dir))


def corpus_keywords(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return C.corpus_keywords(docs.withColumn("workspace", F.col("source")))


def corpus_parts(spark, sf_dir):
    parts = C.corpus_parts(_documents(spark, sf_dir))
    return parts.select("doc_id", F.length("part").cast("long").alias("part_chars"), F.sha2("part", 256).alias("part_sha256"))


def retrieve_multi(spark, sf_dir):
    hits = O.retrieve(O.passage_rows(_documents(spark, sf_dir)), _benchmark(spark, sf_dir))
    return hits.select("query_id", "doc_id", "passage_index", "score", "rank")


def evidence_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return O.evidence_pages(pages.select("doc_id", F.explode(T.sentences(F.col("page_text"))).alias("sentence")), pages)


def question_types(spark, sf_dir):
    return O.question_types(_benchmark(spark, sf_dir).unionByName(_questions(spark).withColumn("query_id", -F.col("query_id"))))


def query_expansion(spark, sf_dir):
    return E.expanded(_questions(spark))


def citation_strip(spark, sf_dir):
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(X.CITED)], "id long, s string")
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("s")).unionByName(own)
    c = T.strip_citations(F.col("s"))
    return every.where("s is not null").select("id", F.length(c).cast("long").alias("chars"), F.sha2(c, 256).alias("stripped_sha256"))


def heading_classes(spark, sf_dir):
    own = spark.createDataFrame([(-1, "\n".join(x or " " for x in X.LINES))], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(own)
    rows = docs.select("doc_id", F.explode(T.text_lines(T.clean_text(F.col("text")))).alias("line"))
    aliases = {**L.SECTION_ALIASES, "plain": ["the", "of"]}
    return rows.groupBy("doc_id", T.section_of(F.col("line"), aliases).alias("section")).agg(F.count(F.lit(1)).alias("n_lines"))


def unique_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("upload_ord"), F.col("source").alias("name"))
    own = spark.createDataFrame([(i - 1000, n) for i, n in enumerate(X.NAMES)], "upload_ord long, name string")
    return O.unique_names(docs.unionByName(own))


def upload_limits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("workspace"), F.col("n_chars").alias("size_bytes"))
    return O.upload_limits(docs, 49, 100_000)


def preview(spark, sf_dir):
    p = T.preview(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.length(p).cast("long").alias("preview_chars"), F.sha2(p, 256).alias("preview_sha256"))


def target_documents(spark, sf_dir):
    """Every document as a target of its own, and one target that takes all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    targets = docs.select(F.col("doc_id").alias("target_id"), "doc_id").unionByName(spark.createDataFrame([(-1, None)], "target_id long, doc_id long"))
    return C.target_documents(docs, targets)


def summary_scores(spark, sf_dir):
    cands = O.summary_candidates(_texts(spark, sf_dir), ALIASES)
    return E.summary_scores(cands, vectors=False).select("doc_id", "ord", F.round("score", 6).alias("score"))


def summaries(spark, sf_dir):
    return E.summaries(O.summary_candidates(_texts(spark, sf_dir), ALIASES))


def summary_texts(spark, sf_dir):
    return E.summary_texts(_paged_documents(spark, sf_dir), ALIASES, 3, _pages(spark, sf_dir), ROLES)


def answers(spark, sf_dir):
    return E.answers(O.page_passages(_pages(spark, sf_dir), 60), _questions(spark))


def answer_texts(spark, sf_dir):
    names = spark.createDataFrame([(-1, "gauge.pdf"), (-2, " ")], "doc_id long, name string")
    return E.answer_texts(O.page_passages(_pages(spark, sf_dir), 60), _questions(spark), names)


def answer_bonuses(spark, sf_dir):
    """What every sentence would get for each type of question."""
    kinds = spark.createDataFrame([(t,) for t in L.ANSWER_TERMS], "question_type string")
    rows = O.sentence_rows(_texts(spark, sf_dir)).crossJoin(F.broadcast(kinds))
    return rows.select("doc_id", "position", "question_type", F.round(E.answer_bonus(F.col("sentence"), F.col("question_type")), 6).alias("bonus")).where("bonus > 0")


def dimension_scores(spark, sf_dir):
    rows = O.sentence_rows(_texts(spark, sf_dir))
    scores = F.arrays_zip(F.array(*map(F.lit, DIMENSIONS)).alias("dimension"), E.dimension_scores(F.col("sentence"), DIMENSIONS).alias("score"))
    return rows.select("doc_id", "position", F.explode(scores).alias("s")).select("doc_id", "position", "s.*").where("score > 0")


def comparison(spark, sf_dir):
    return E.comparison(_texts(spark, sf_dir), DIMENSIONS)


def comparison_cells(spark, sf_dir):
    return E.comparison_cells(E.comparison(_paged_documents(spark, sf_dir), DIMENSIONS, pages=_pages(spark, sf_dir)))


def comparison_table(spark, sf_dir):
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(X.TEXTS)], "doc_id long, text string")
    return E.comparison_table(E.comparison_cells(E.comparison(own)), {-7: "film.pdf", -9: "", -3: "buoys.txt"})


def comparison_note(spark, sf_dir):
    return E.comparison_note(_documents(spark, sf_dir))


def corpus_metrics(spark, sf_dir):
    return E.corpus_metrics(_documents(spark, sf_dir))


IMAGES = [  # doc_id, page_number, image_no, x0, y0, x1, y1, width, height
    (1, 1, 1, 40.0, 100.0, 300.0, 240.0, 79, 400), (1, 1, 2, 40.0, 100.0, 300.0, 240.0, 400, 300), (1, 1, 3, 40.0, 500.0, 300.0, 640.0, 100, 119), (1, 1, 4, 40.0, 500.0, 300.0, 640.0, 100, 120),
    (1, 2, 1, None, None, None, None, 640, 480), (2, 1, 1, 10.0, 10.0, 90.0, 90.0, 200, 200), (2, 1, 2, 10.0, 700.0, 90.0, 780.0, 200, 200),
]
BLOCKS = [  # doc_id, page_number, block_no, x0, y0, x1, y1, text
    (1, 1, 0, 40.0, 20.0, 300.0, 40.0, "Harbour plans were drawn in\nthe year of the flood. They show each pier."), (1, 1, 1, 40.0, 262.0, 300.0, 280.0, "Figure 1. Map of the two piers ( north ) ."),
    (1, 1, 2, 40.0, 60.0, 300.0, 80.0, "Fig. S2 Height versus time."), (1, 1, 3, 40.0, 300.0, 300.0, 320.0, "The northern pier is older than the other. Its stones came from afar."),
    (1, 1, 4, 40.0, 960.0, 300.0, 980.0, "图 3 示意图"), (1, 2, 0, 0.0, 0.0, 50.0, 10.0, "Nothing ends here"), (2, 1, 0, 10.0, 330.0, 90.0, 350.0, "FIGURE 4 Yield of the season."),
    (2, 1, 1, 10.0, 200.0, 90.0, 210.0, "The yield of the season was fair to all. Prices fell by a third in May. The dealers left the town in June. The nets were mended at home. The boats were sold."),
    (2, 1, 2, 10.0, 600.0, 90.0, 640.0, "Figured oak is not a caption at all."), (2, 1, 3, 500.0, 600.0, 600.0, 640.0, "Text that stands beside the page is not on it at all."),
]
PAGE_SIZES = [(1, 1, 400.0, 1000.0), (1, 2, 400.0, 1000.0), (2, 1, 400.0, 800.0)]


def _geometry(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    box = "x0 double, y0 double, x1 double, y1 double"
    return (
        spark.createDataFrame(IMAGES, f"doc_id long, page_number int, image_no int, {box}, width int, height int"),
        spark.createDataFrame(BLOCKS, f"doc_id long, page_number int, block_no int, {box}, text string"),
        spark.createDataFrame(PAGE_SIZES, "doc_id long, page_number int, page_width double, page_height double"),
    )


def caption_candidates(spark, sf_dir):
    """Captions among inline blocks, and documents that begin like one."""
    docs = _documents(spark, sf_dir).select("doc_id", F.lit(0).alias("page_number"), F.lit(0).alias("block_no"), "text")
    blocks = _geometry(spark)[1].select((-F.col("doc_id")).alias("doc_id"), "page_number", "block_no", "text")
    return O.captions(blocks.unionByName(docs)).select("doc_id", "page_number", "block_no", F.col("text").alias("caption"))


def nearest_captions(spark, sf_dir):
    images, blocks, _ = _geometry(spark)
    return O.nearest_captions(images.where("x0 is not null"), blocks)


def figures(spark, sf_dir):
    names = spark.createDataFrame([(1, "plans.pdf"), (2, "nets.pdf")], "doc_id long, name string")
    out = G.extract_figures(*_geometry(spark)).join(names, "doc_id")
    return out.select("doc_id", "page_number", "image_no", "image_index", "width", "height", "caption", "nearby_text", G.source_label(F.col("name"), F.col("page_number")).alias("label"))


def figure_explanations(spark, sf_dir):
    out = G.extract_figures(*_geometry(spark))
    rows = [
        out.select("doc_id", "page_number", "image_no", F.lit(lang).alias("language"), *[F.array_join(G.explained(F.col("caption"), F.col("nearby_text"), lang)[k], "|").alias(k) for k in ("direct", "inference", "unknown")])
        for lang in G.SAYINGS
    ]
    return rows[0].unionByName(rows[1])


def figure_purposes(spark, sf_dir):
    """The purpose that a text would have as a caption."""
    return _documents(spark, sf_dir).select("doc_id", E.figure_purpose(F.col("text"), F.lit("")).alias("purpose"))


MARKUP = ["### Grounded summary\n\nA Strong wind.", "**Evidence strength:** `Weak`\n**Why:** Only weak lexical support was found; verify the cited passage before using the answer.", "Plain."]


def localized_markup(spark, sf_dir):
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(MARKUP)], "doc_id long, text string")
    docs = _documents(spark, sf_dir).select("doc_id", "text").unionByName(own)
    c = M.localized(F.col("text"))
    return docs.select("doc_id", F.length(c).cast("long").alias("chars"), F.sha2(c, 256).alias("localized_sha256"))


def unreadable_inputs(spark, sf_dir):
    """Documents without text, and files that a parser cannot read, beside those that stay."""

    def parse(data: bytes) -> list[str]:
        if not data.startswith(b"OK"):
            raise ValueError("not a document")
        return data.decode().split("\f")[1:]

    files = spark.createDataFrame([("/in/a.pdf", b"OK\fOne page here.\f"), ("/in/b.pdf", b"junk"), ("/in/c.pdf", b"OK\f\f ")], "path string, content binary")
    pages = pdf.pdf_pages(files, parse)
    texts = pdf.page_documents(pages).join(pages.groupBy("doc_id").agg(F.first("name").alias("name"), F.max("error").alias("error")), "doc_id")
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), T.clean_text(F.col("text")).alias("text"), F.col("source").alias("name"), F.lit(None).cast("string").alias("error"))
    good, errors = pdf.routed(docs.unionByName(texts))
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(errors.select("doc_id", "error"))


def recent_questions(spark, sf_dir):
    """The last questions of each source, as if every document were one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("workspace"), F.col("doc_id").alias("asked_ord"))
    return E.recent_questions(docs)


def question_reports(spark, sf_dir):
    """Conversations as saved questions: a user's turn and the answer after it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.select("conv_id", F.col("turn").alias("t"), F.col("text").alias("question"))
    told = turns.select("conv_id", (F.col("turn") - 1).alias("t"), F.concat(F.lit("### "), "text").alias("answer"))
    rows = asked.join(told, ["conv_id", "t"]).select((F.col("conv_id") * 1000 + F.col("t")).alias("asked_ord"), "question", F.when(F.col("t") % 2 == 0, F.lit("a.pdf")).alias("target"), "answer")
    return R.question_parts(rows).select("asked_ord", F.sha2("part", 256).alias("part_sha256"))


def document_reports(spark, sf_dir):
    docs, pages = _paged_documents(spark, sf_dir), _pages(spark, sf_dir)
    said = E.summary_texts(docs, ALIASES, 3, pages, ROLES)
    own = R.document_parts(docs.withColumn("name", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))), said, O.keywords(docs), O.domain_hints(docs, GROUPS, pages=pages))
    return R.report_parts(R.header_part(docs), own)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        clean_text_stats, word_counts, logical_lines, sentences, sentence_quality, passages, document_passages, term_hits, domain_hints, cited_hints, sections,
        summary_candidates, role_evidence, research_brief, keywords, keyword_overlap, keyword_table, corpus_keywords, corpus_parts, retrieve_multi, evidence_pages,
        question_types, query_expansion, citation_strip, heading_classes, unique_names, upload_limits, preview, target_documents, summary_scores, summaries,
        summary_texts, answers, answer_texts, answer_bonuses, dimension_scores, comparison, comparison_cells, comparison_table, comparison_note, corpus_metrics,
        caption_candidates, nearest_captions, figures, figure_explanations, figure_purposes, localized_markup, unreadable_inputs, recent_questions, question_reports,
        document_reports,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from quillspark.plans import expected

    return expected.oracle_sql()
