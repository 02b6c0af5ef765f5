"""Summaries, grounded answers, comparison of documents and text of figures."""

from __future__ import annotations

import math
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain, groupby, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators import documents as O
from quillspark.tables import settle


# The Markdown of summaries and answers.
SUMMARY_ROLES = {"main_focus": "Main focus", "method": "Approach / method", "result": "Key result", "limitation": "Limitation / future work"}
SUMMARY_HEAD, SUMMARY_POINTS = "### Grounded summary", "### Supporting points"
SUMMARY_NOTE = "> Note: This is a grounded extractive summary. The wording is lightly cleaned, but the factual content is selected from the original document."
NO_SUMMARY = "No clean readable sentence was found. The uploaded PDF may contain mostly equations, scanned text, or broken encoding."
ANSWER_HEAD = "### Grounded answer"
ANSWER_NOTE = "> Note: This QA mode is extractive and grounded. It answers by selecting relevant sentences from the uploaded document, not by inventing new claims."
ANSWER_WEAK = "> The answer below is based on weak textual evidence. Please verify it against the original paper."
NOTHING_ASKED = ("Please enter a question.", "No question was provided.")
NOTHING_FOUND = (
    "I could not find relevant evidence in the uploaded document. Try asking a more specific question, or upload a cleaner PDF/text file.",
    "No relevant passage was retrieved.",
)
NOTHING_CLEAN = (
    "I found potentially relevant passages, but they were too noisy to form a clean answer. The PDF may contain dense formulas, broken text, or scanned content.",
    "Retrieved passages were too noisy for a clean answer.",
)
STRENGTHS = {
    "Strong": "The top answer sentence and its passage both had strong lexical support.",
    "Moderate": "Relevant complete source sentences passed the filters, but lexical support was not consistently strong.",
    "Weak": "Only weak lexical support was found; verify the cited passage before using the answer.",
}


def tfidf(units: DataFrame, group: list[str], unit: list[str], text: str, max_df: float = 1.0) -> DataFrame:
    """(group, unit, term, w): L2-normalized smoothed TF-IDF of each unit within its group.

    Terms in more than max_df of a group's units are dropped; a unit left without terms has no rows.
    """
    keys = group + unit
    tf = O.term_rows(units, keys, text)
    n = units.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df")).join(n, group).where(F.col("df") <= max_df * F.col("n"))
    raw = tf.join(df, [*group, "term"]).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("w") / norm).alias("w"))


def role_bonus(sentence: Column, roles: dict[str, list[str]] = L.ROLES, domain: dict[str, list[str]] = L.DOMAIN) -> Column:
    def of(seen: Column) -> Column:
        named = sum((T.words_have_any(seen, terms).cast("int") for terms in roles.values()), F.lit(0))
        hits = T.words_count(seen, [t for terms in domain.values() for t in terms])
        return 0.25 * named + F.least(0.06 * hits, F.lit(0.36))

    return T.once(T.term_words(sentence, [t for terms in [*roles.values(), *domain.values()] for t in terms]), of)


def _weights(words: dict[int, list[list[str]]], n: int, max_df: float) -> dict[int, dict[str, float]]:
    """The L2-normalized smoothed TF-IDF of one document's sentences, as tfidf has it; n counts its sentences."""
    tf = {}
    for ord_, rows in words.items():
        count = tf[ord_] = {}
        for ws in rows:
            for t in (*ws, *map(" ".join, pairwise(ws))):
                count[t] = count.get(t, 0) + 1
    df = Counter(chain.from_iterable(tf.values()))
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if d <= max_df * n}
    out = {}
    for ord_, count in tf.items():
        raw = {t: c * idf[t] for t, c in count.items() if t in idf}
        norm = math.sqrt(math.fsum(x * x for x in raw.values()))
        out[ord_] = {t: x / norm for t, x in raw.items()}
    return out


def _alike(a: dict[str, float], b: dict[str, float]) -> float:
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    return sum(x * many[t] for t, x in few.items() if t in many)


def _chosen(ords: list[int], scores: list[float], most: float, vectors: dict[int, dict[str, float]], k: int, alike: float) -> set[int]:
    if len(ords) <= k or most == 0:
        return set(sorted(ords)[:k])
    got: list[int] = []
    for _, ord_ in sorted((-s, o) for s, o in zip(scores, ords, strict=True)):
        if len(got) >= k:
            break
        if all(_alike(vectors.get(o, {}), vectors.get(ord_, {})) <= alike for o in got):
            got.append(ord_)
    return set(got)


def _weighed(candidates: DataFrame, max_df: float = 0.9, k: int | None = None, alike: float = 0.68, vectors: bool = False) -> DataFrame:
    """candidates with base, score and, with k, only the k best of each document; with vectors also the weights by term.

    Candidates are dealt by document and read in order, as a stream: what is kept is one document at a time. Only words
    are split in the row; counting terms and comparing sentences needs hash tables, which expressions lack.
    """
    place = {c: f"c{i}" for i, c in enumerate(candidates.columns)}
    session = candidates.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    weight = F.coalesce(*[F.when(F.col("section") == s, F.lit(w)) for s, w in L.SECTION_WEIGHTS.items()], F.lit(1.0))
    early = F.when(F.col("position") <= 2, 1.10).otherwise(1.0)
    dealt = candidates.repartition(n, "doc_id").sortWithinPartitions("doc_id", "ord").select(
        "doc_id", "ord", F.array_join(O.term_list(F.col("sentence")), " ").alias("words"), weight.alias("weight"), early.alias("early"),
        role_bonus(F.col("sentence")).alias("bonus"), *[F.col(f"`{c}`").alias(at) for c, at in place.items()],
    )

    def document(own: list[tuple], doc_id: object) -> tuple[list, list, list]:
        words: dict[int, list[list[str]]] = {}
        if doc_id is not None:  # rows without a document share no terms
            for ord_, ws, *_ in own:
                if ws:
                    words.setdefault(ord_, []).append(ws.split(" "))
        vecs = {o: v for o, v in _weights(words, len(own), max_df).items() if v}
        sums = {o: math.fsum(v.values()) for o, v in vecs.items()}
        base = [sums.get(o, 0.0) for o, *_ in own]
        if k is None:
            return base, [True] * len(own), [sorted(vecs[o].items()) if o in vecs else None for o, *_ in own] if vectors else []
        scores = [float(Decimal(repr(x * w * e + b)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for x, (_, _, w, e, b) in zip(base, own, strict=True)]
        picked = _chosen([o for o, *_ in own], scores, max(base), vecs, k, alike)
        return base, [o in picked for o, *_ in own], []

    def run(batches):
        import pyarrow as pa

        def told(parts: list) -> list:
            rows = pa.Table.from_batches(parts).combine_chunks()
            base, keep, vecs = [], [], []
            units = zip(*(rows.column(i).to_pylist() for i in range(6)), strict=True)
            for doc_id, own in groupby(units, lambda r: r[0]):
                for out, got in zip((base, keep, vecs), document([r[1:] for r in own], doc_id), strict=True):
                    out.extend(got)
            out = rows.select([*place.values(), "weight", "early", "bonus"]).append_column("base", pa.array(base, pa.float64()))
            if vectors:
                out = out.append_column("vector", pa.array(vecs, pa.map_(pa.string(), pa.float64())))
            return (out if k is None else out.filter(pa.array(keep))).to_batches()

        held: list = []  # of the document that the next batch may go on with
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            cut = len(ids)
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if cut or (held and held[-1].column(0)[0].as_py() != ids[-1]):
                if parts := [*held, *([batch.slice(0, cut)] if cut else [])]:
                    yield from told(parts)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from told(held)

    fields = [f"{place[f.name]} {f.dataType.simpleString()}" for f in candidates.schema.fields]
    schema = ", ".join([*fields, "weight double, early double, bonus double, base double", *["vector map<string,double>"] * vectors])
    score = F.round(F.col("base") * F.col("weight") * F.col("early") + F.col("bonus"), 9)
    more = ["base", *["vector"] * vectors]
    return dealt.mapInArrow(run, schema).select(*[F.col(at).alias(c) for c, at in place.items()], *more, score.alias("score"))


def summary_scores(candidates: DataFrame, vectors: bool = True) -> DataFrame:
    """candidates with base (sum of a sentence's TF-IDF weights within its document), vector, and score.

    The base counts by the section's weight, a tenth more among its first three sentences, and the role bonus is added.
    vectors: whether the weights by term come along, null where a sentence has none.
    """
    return _weighed(candidates, vectors=vectors)


def summaries(candidates: DataFrame, k: int = 5, alike: float = 0.68) -> DataFrame:
    """(doc_id, ord, section, sentence): the k best sentences of each document, none alike to a better one.

    One document's candidates meet in one task, best first; each is compared with the chosen ones only, k at most.
    Documents of k candidates or fewer keep all; where no term is left, the first k stay. Ties keep the earlier sentence.
    """
    return _weighed(candidates, k=k, alike=alike).select("doc_id", "ord", "section", "sentence")


def summary_texts(
    docs: DataFrame,
    aliases: dict[str, list[str]] = L.SECTION_ALIASES,
    k: int = 5,
    pages: DataFrame | None = None,
    roles: dict[str, list[str]] = L.ROLES,
    preferred: dict[str, list[str]] = L.ROLE_SECTIONS,
) -> DataFrame:
    """(doc_id, summary): Markdown of the chosen sentences in text order and, below them, of role sentences not among them.

    With pages (doc_id, page_number, page_text) each sentence cites its page. A document without a fit sentence gets a
    fixed text.
    """
    chosen = summaries(O.summary_candidates(docs, aliases), k)
    overview = chosen.groupBy("doc_id").agg(F.collect_set("sentence").alias("shown"))
    found = docs.select("doc_id", O.candidate_array(F.col("text"), aliases).alias("cands")).join(overview, "doc_id").select(
        "doc_id", "shown", *[O.best_by_role(F.col("cands"), roles[r], preferred.get(r, []), F.col("shown"))["sentence"].alias(f"role{i}") for i, r in enumerate(SUMMARY_ROLES)]
    )
    said = F.array(*[F.struct(F.lit(1).alias("block"), F.lit(i).alias("no"), F.lit(f"- **{label}:** ").alias("label"), F.col(f"role{i}").alias("sentence")) for i, label in enumerate(SUMMARY_ROLES.values())])
    new = F.filter(said, lambda r, i: r["sentence"].isNotNull() & ~F.array_contains("shown", r["sentence"]) & ~F.exists(F.slice(said, 1, i), lambda e: e["sentence"].eqNullSafe(r["sentence"])))
    lines = found.select("doc_id", F.explode(new).alias("r")).select("doc_id", "r.*")
    lines = lines.unionByName(chosen.select("doc_id", F.lit(0).alias("block"), F.col("ord").alias("no"), F.lit("").alias("label"), "sentence"))
    if pages is not None:
        lines = O.with_pages(lines, pages, "sentence").withColumn("sentence", T.cite(F.col("sentence"), F.col("page_number")))
    rows = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block", "no", F.concat("label", "sentence").alias("line")))).alias("lines"))
    block = lambda b, sep: F.array_join(F.transform(F.filter("lines", lambda x: x["block"] == b), lambda x: x["line"]), sep)
    points = F.when(block(1, "\n") != "", F.concat(F.lit(f"\n\n{SUMMARY_POINTS}\n"), block(1, "\n"))).otherwise("")
    text = F.concat(F.lit(f"{SUMMARY_HEAD}\n\n"), block(0, " "), points, F.lit(f"\n\n{SUMMARY_NOTE}"))
    return docs.select("doc_id").join(rows.select("doc_id", text.alias("t")), "doc_id", "left").select("doc_id", F.coalesce("t", F.lit(NO_SUMMARY)).alias("summary"))


def expanded(queries: DataFrame, types: dict[str, list[str]] = L.QUESTION_TYPES, terms: dict[str, list[str]] = L.QUERY_EXPANSION) -> DataFrame:
    """(query_id, question_type, query): blank queries go, others get the terms of their type behind them."""
    asked = queries.where(T.strip(F.coalesce("query", F.lit(""))) != "")
    typed = asked.join(O.question_types(asked, types), "query_id")
    more = F.coalesce(*[F.when(F.col("question_type") == t, F.lit(" ".join(ws))) for t, ws in terms.items()], F.lit(" ".join(terms["general"])))
    return typed.select("query_id", "question_type", F.concat_ws(" ", "query", more).alias("query"))


def answer_bonus(sentence: Column, question_type: Column, terms: dict[str, list[str]] = L.ANSWER_TERMS) -> Column:
    """0.08 for each term of the question's type, 0.15 for a claim phrase, 0.5 at most."""

    def of(seen: Column) -> Column:
        hits = F.coalesce(*[F.when(question_type == t, T.words_count(seen, ws)) for t, ws in terms.items() if ws], F.lit(0))
        return F.least(0.08 * hits + F.when(T.words_have_any(seen, L.CLAIMS), 0.15).otherwise(0.0), F.lit(0.5))

    return T.once(T.term_words(sentence, [t for ws in [*terms.values(), L.CLAIMS] for t in ws]), of)


def strength(answer_score: Column, passage_score: Column) -> Column:
    return F.when((answer_score >= 0.35) & (passage_score >= 0.08), "Strong").when(answer_score >= 0.18, "Moderate").otherwise("Weak")


def _retrieved(passages: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """(query_id, evidence_id, doc_id, passage_index, page_number, passage, passage_score): evidence_id is the passage's rank."""
    if "page_number" not in passages.columns:
        passages = passages.withColumn("page_number", F.lit(None).cast("int"))
    hits = O.retrieve(passages, asked, top)
    return hits.select("query_id", F.col("rank").alias("evidence_id"), "doc_id", "passage_index", "page_number", "passage", F.col("score").alias("passage_score"))


def _fit_sentences(hits: DataFrame) -> DataFrame:
    rows = hits.select("query_id", "evidence_id", "doc_id", "passage_index", "page_number", "passage_score", F.posexplode(T.sentences(F.col("passage"))).alias("sentence_index", "raw"))
    return rows.withColumn("sentence", T.strip_citations(F.col("raw"))).drop("raw").where(~T.is_bad_for_summary(F.col("sentence")))


def _selected(fit: DataFrame, asked: DataFrame, most: int, terms: dict[str, list[str]]) -> DataFrame:
    unit = ["evidence_id", "sentence_index"]
    # the query stands as one more sentence of its group, under ids of -1
    both = fit.select("query_id", *unit, "sentence").unionByName(
        asked.join(fit.select("query_id").distinct(), "query_id", "left_semi").select("query_id", *[F.lit(-1).alias(u) for u in unit], F.col("query").alias("sentence"))
    )
    w = tfidf(both, ["query_id"], unit, "sentence", 0.95)
    q = w.where("sentence_index = -1").select("query_id", "term", F.col("w").alias("qw"))
    alike = w.where("sentence_index >= 0").join(q, ["query_id", "term"]).groupBy("query_id", *unit).agg(F.sum(F.col("w") * F.col("qw")).alias("cosine"))
    scored = fit.join(alike, ["query_id", *unit], "left").join(asked.select("query_id", "question_type"), "query_id")
    score = F.coalesce("cosine", F.lit(0.0)) + 0.35 * F.col("passage_score") + answer_bonus(F.col("sentence"), F.col("question_type"), terms)
    scored = scored.withColumn("answer_score", F.round(score, 6)).withColumn("key", T.dedup_key(F.col("sentence")))
    place = [F.desc("answer_score"), *unit]
    once = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*place))).where("n = 1")
    whole = Window.partitionBy("query_id")
    ranked = once.withColumn("least", F.greatest(F.lit(0.10), 0.35 * F.max("answer_score").over(whole))).withColumn("item", F.row_number().over(whole.orderBy(*place)))
    kept = ranked.where((F.col("item") == 1) | ((F.col("item") <= most) & (F.col("answer_score") >= F.col("least"))))
    return kept.withColumn("strength", strength(F.max("answer_score").over(whole), F.max("passage_score").over(whole))).drop("key", "n", "least")


_ITEM = ["query_id", "item", "evidence_id", "doc_id", "passage_index", "page_number", "sentence_index", "sentence", "passage_score", "answer_score", "question_type", "strength"]


def answers(passages: DataFrame, queries: DataFrame, top: int = 4, most: int = 4, terms: dict[str, list[str]] = L.ANSWER_TERMS) -> DataFrame:
    """Answer sentences: query_id, item (by score), evidence_id, doc_id, passage_index, page_number, sentence_index, sentence, scores, question_type, strength.

    Sentences of the query's best passages by cosine, passage score and terms of the question's type; the same words are
    kept once, then those within 35 % of the best (0.10 at least), else the best alone. evidence_id is the rank of the
    sentence's passage. passages: doc_id, passage_index, passage and, if known, page_number.
    """
    asked = settle(expanded(queries))
    return _selected(settle(_fit_sentences(_retrieved(passages, asked, top))), asked, most, terms).select(*_ITEM)


def with_names(rows: DataFrame, names: DataFrame, name: str = "source") -> DataFrame:
    """rows with the document's name; a missing or blank one is `Document` and doc_id."""
    known = names.select("doc_id", T.strip(F.coalesce("name", F.lit(""))).alias("known_"))
    label = F.coalesce(F.nullif("known_", F.lit("")), F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    return rows.join(known, "doc_id", "left").select(*rows.columns, label.alias(name))


def sources(items: DataFrame) -> DataFrame:
    """(query_id, source_no, label): distinct sources of the answer's sentences by the best sentence, with their page."""
    label = F.when(F.col("page_number").isNull(), F.col("source")).otherwise(F.concat("source", F.lit(", p. "), F.col("page_number").cast("string")))
    first = items.groupBy("query_id", label.alias("label")).agg(F.min("item").alias("first"))
    return first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("source_no"), "label")


def answer_texts(passages: DataFrame, queries: DataFrame, names: DataFrame, top: int = 4, most: int = 4, terms: dict[str, list[str]] = L.ANSWER_TERMS) -> DataFrame:
    """(query_id, question_type, strength, reason, answer): Markdown of each query's answer, one row per query.

    Sentences follow in text order with their evidence number and page, grouped by source where there are several; then
    the sources, best first. Blank queries, queries without a passage and those whose passages are noise get fixed texts.
    """
    asked = settle(expanded(queries))
    hits = settle(_retrieved(passages, asked, top))
    items = settle(with_names(_selected(settle(_fit_sentences(hits)), asked, most, terms), names))
    cited = F.concat("sentence", F.lit(" [E"), F.col("evidence_id").cast("string"), F.lit("]"), F.when(F.col("page_number").isNotNull(), F.concat(F.lit(" [p. "), F.col("page_number").cast("string"), F.lit("]"))).otherwise(""))
    at = F.struct("doc_id", "passage_index", "sentence_index")
    by_source = items.groupBy("query_id", "source").agg(F.min(at).alias("at"), F.sort_array(F.collect_list(F.struct(at.alias("at"), cited.alias("line")))).alias("lines"))
    said = by_source.select("query_id", "at", "source", F.array_join(F.transform("lines", lambda x: x["line"]), " ").alias("said"))
    body = said.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "source", "said"))).alias("parts"))
    bullets = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("- **"), p["source"], F.lit(":** "), p["said"])), "\n")
    body = body.select("query_id", F.when(F.size("parts") == 1, F.col("parts")[0]["said"]).otherwise(bullets).alias("body"))
    listed = sources(items).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("source_no", "label"))).alias("s"))
    listed = listed.select("query_id", F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["label"])), "\n").alias("listed"))
    state = items.groupBy("query_id").agg(F.first("strength").alias("strength"))
    rows = queries.select("query_id").join(asked.select("query_id", "question_type"), "query_id", "left")
    rows = rows.join(hits.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left")
    for part in (state, body, listed):
        rows = rows.join(part, "query_id", "left")
    reason = F.coalesce(*[F.when(F.col("strength") == k, F.lit(v)) for k, v in STRENGTHS.items()])
    whole = F.concat_ws(
        "\n",
        F.lit(f"{ANSWER_HEAD}\n"),
        F.concat(F.lit("**Detected question type:** `"), F.col("question_type"), F.lit("`")),
        F.concat(F.lit("**Evidence strength:** `"), F.col("strength"), F.lit("`")),
        F.concat(F.lit("**Why:** "), reason, F.lit("\n")),
        F.when(F.col("strength") == "Weak", F.lit(f"{ANSWER_WEAK}\n")),
        F.lit("**Answer:**"),
        F.concat("body", F.lit("\n")),
        F.lit("**Evidence sources:**"),
        F.concat("listed", F.lit("\n")),
        F.lit(ANSWER_NOTE),
    )
    blank, unfound = F.col("question_type").isNull(), F.col("found").isNull()
    return rows.select(
        "query_id",
        F.coalesce("question_type", F.lit("general")).alias("question_type"),
        F.coalesce("strength", F.lit("Weak")).alias("strength"),
        F.when(blank, NOTHING_ASKED[1]).when(unfound, NOTHING_FOUND[1]).when(F.col("strength").isNull(), NOTHING_CLEAN[1]).otherwise(reason).alias("reason"),
        F.when(blank, NOTHING_ASKED[0])
        .when(unfound, f"{ANSWER_HEAD}\n\n{NOTHING_FOUND[0]}")
        .when(F.col("strength").isNull(), f"{ANSWER_HEAD}\n\n{NOTHING_CLEAN[0]}")
        .otherwise(whole)
        .alias("answer"),
    )


def _dimension_score(sentence: Column, seen: Column, dimension: str, terms: list[str]) -> Column:
    score = T.words_count(seen, terms) * F.lit(1.0)
    if dimension == "Parameters / settings":
        units = r"(?U)\b\d+(\.\d+)?[\s\x1c-\x1f]?(" + "|".join(L.UNITS) + r")\b"
        measured = F.when(sentence.rlike(r"\p{Nd}"), F.regexp_count(sentence, F.lit(units))).otherwise(0)
        score = score + 1.5 * measured + F.when(T.words_have_any(seen, L.CONDITIONS), 0.8).otherwise(0.0)
    if dimension == "Research focus":
        score = score + F.when(T.word_count(sentence) <= 35, 0.3).otherwise(0.0)
    if dimension == "Key results / performance":
        score = score + F.when(T.words_have_any(seen, L.OUTCOMES), 0.8).otherwise(0.0)
    return F.round(score, 6)


def dimension_scores(sentence: Column, dimensions: dict[str, list[str]]) -> Column:
    """Array of the sentence's scores, one for each dimension in order; its words are looked up once for all of them."""
    every = [*L.CONDITIONS, *L.OUTCOMES, *(t for terms in dimensions.values() for t in terms)]
    return T.once(T.term_words(sentence, every), lambda seen: F.array(*[_dimension_score(sentence, seen, d, terms) for d, terms in dimensions.items()]))


def dimension_score(sentence: Column, dimension: str, terms: list[str]) -> Column:
    return dimension_scores(sentence, {dimension: terms})[0]


def comparison(docs: DataFrame, dimensions: dict[str, list[str]] = L.DIMENSIONS, most: int = 3, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, dimension, snippet_ord, snippet): each document's best sentences of a dimension in text order; null where none.

    Sentences of one score keep their order, those of the same words count once. Built in the row. With pages snippets
    cite their page.
    """

    def told(text: Column) -> Column:
        stripped = F.transform(T.sentences(text), lambda x, i: F.struct(i.alias("position"), T.strip_citations(x).alias("sentence")))
        return F.transform(
            F.filter(stripped, lambda r: ~T.is_bad_for_summary(r["sentence"])),
            lambda r: F.struct(r["position"], r["sentence"], T.dedup_key(r["sentence"]).alias("key"), dimension_scores(r["sentence"], dimensions).alias("scores")),
        )

    def of(rows: Column, at: int, d: str) -> Column:
        scored = F.sort_array(
            F.transform(
                F.filter(rows, lambda r: r["scores"][at] > 0),
                lambda r: F.struct((-r["scores"][at]).alias("neg"), r["position"].alias("position"), r["sentence"].alias("sentence"), r["key"].alias("key")),
            )
        )

        def top(found: Column) -> Column:
            keys = F.slice(F.array_distinct(F.transform(found, lambda r: r["key"])), 1, most)
            best = F.transform(keys, lambda k: F.get(F.filter(found, lambda r: r["key"] == k), F.lit(0)))
            return F.transform(F.sort_array(F.transform(best, lambda r: F.struct(r["position"], r["sentence"]))), lambda r, i: F.struct(i.alias("snippet_ord"), r["sentence"].alias("snippet")))

        none = F.array(F.struct(F.lit(None).cast("int").alias("snippet_ord"), F.lit(None).cast("string").alias("snippet")))
        return T.once(T.once(scored, top), lambda s: F.struct(F.lit(d).alias("dimension"), F.when(F.size(s) > 0, s).otherwise(none).alias("snippets")))

    cells = T.once(T.by_script(F.col("text"), told), lambda rows: F.array(*[of(rows, i, d) for i, d in enumerate(dimensions)]))
    out = docs.select("doc_id", F.explode(cells).alias("c")).select("doc_id", "c.dimension", F.explode("c.snippets").alias("s")).select("doc_id", "dimension", "s.*")
    if pages is None:
        return out
    return O.with_pages(out, pages, "snippet").withColumn("snippet", T.cite(F.col("snippet"), F.col("page_number"))).drop("page_number")


def comparison_cells(snippets: DataFrame, none: str = "Not clearly detected.") -> DataFrame:
    """(doc_id, dimension, cell): snippets of a cell joined, or the text for an empty one."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("snippet").isNotNull(), F.struct("snippet_ord", "snippet")))), lambda x: x["snippet"]), " ")
    return snippets.groupBy("doc_id", "dimension").agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(none)).alias("cell"))


def comparison_table(cells: DataFrame, names: dict[int, str], dimensions: dict[str, list[str]] = L.DIMENSIONS) -> DataFrame:
    """(Dimension, one column per named document): the wide table of a few documents, in the order of the dimensions.

    names: doc_id to column name; a blank name is `Document` and its place. Fewer than two documents: no rows.
    """
    safe = {d: name if name and name.strip() else f"Document {i + 1}" for i, (d, name) in enumerate(names.items())}
    place = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(i)) for i, d in enumerate(dimensions)])
    wide = cells.where(F.col("doc_id").isin(list(safe))).groupBy("dimension").agg(*[F.max(F.when(F.col("doc_id") == d, F.col("cell"))).alias(name) for d, name in safe.items()])
    return wide.where(F.lit(len(safe) >= 2)).orderBy(place).withColumnRenamed("dimension", "Dimension")


COMPARISON_NOTES = (
    "Please upload at least two documents for comparison.",
    "This comparison is extractive and evidence-based. Each cell is built from sentences detected in the uploaded documents.",
)


def comparison_note(docs: DataFrame) -> DataFrame:
    """(note): what is said beside the tables; a single document has nothing to be compared with."""
    return docs.limit(2).agg(F.when(F.count(F.lit(1)) < 2, COMPARISON_NOTES[0]).otherwise(COMPARISON_NOTES[1]).alias("note"))


def keyword_table(docs: DataFrame, top: int = 15, none: str = "None detected") -> DataFrame:
    """(doc_id, shared, distinctive): keywords that all documents have, and those of the document alone, sorted and joined."""
    found = settle(O.keywords(docs, top).select("doc_id", F.lower("keyword").alias("keyword")).distinct())
    n = docs.count()
    counts = found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("doc_id"))
    join = lambda c: F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_list(c)), ", "), F.lit("")), F.lit(none))
    shared = counts.where(F.col("n_docs") == n).agg(join("keyword").alias("shared"))  # at most `top` words
    alone = counts.where("n_docs = 1").groupBy("doc_id").agg(join("keyword").alias("distinctive"))
    return docs.select("doc_id").join(alone, "doc_id", "left").crossJoin(F.broadcast(shared)).select("doc_id", "shared", F.coalesce("distinctive", F.lit(none)).alias("distinctive"))


def nearby_text(images: DataFrame, blocks: DataFrame, sentences: int = 4, chars: int = 1600) -> DataFrame:
    """(doc_id, page_number, image_no, nearby): first sentences of the page's blocks from 180 above to 260 below an image.

    Images have y0, y1, caption, page_width and page_height; blocks have block_no, x0, y0, x1, y1 and text.
    """
    keys = ["doc_id", "page_number", "image_no"]
    neat = F.replace(T.clean_text(F.col("text")), F.lit("\n"), F.lit(" "))
    b = blocks.select("doc_id", "page_number", "block_no", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1"), neat.alias("snippet"))
    top, bottom = F.greatest(F.lit(0.0), F.col("y0") - 180), F.least(F.col("page_height"), F.col("y1") + 260)
    meets = (F.col("bx0") < F.col("page_width")) & (F.col("bx1") > 0) & (F.col("by0") < bottom) & (F.col("by1") > top)
    wanted = meets & (F.col("snippet") != "") & ~F.col("snippet").eqNullSafe(F.col("caption"))
    met = images.join(b, keys[:2], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(wanted, F.struct("block_no", "snippet")))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["snippet"]), " ")
    return met.select(*keys, F.left(F.array_join(F.slice(T.sentences(body), 1, sentences), " "), F.lit(chars)).alias("nearby"))


def figure_purpose(caption: Column, nearby: Column, purposes: dict[str, list[str]] = L.FIGURE_PURPOSES) -> Column:
    """The first purpose one of whose words caption or nearby text holds; `provisional` if none, null without a caption."""
    seen = F.lower(F.concat_ws(" ", caption, T.clean_text(nearby)))
    cases = [F.when(F.contains(seen, F.lit(w)), F.lit(p)) for p, ws in purposes.items() for w in ws]
    return F.when(F.coalesce(caption, F.lit("")) != "", F.coalesce(*cases, F.lit("provisional")))


def corpus_metrics(docs: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """(n_docs, n_words, n_figures, mode) of a workspace."""
    n = F.lit(0).cast("long") if figures is None else F.lit(figures.count())
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(T.word_count(F.col("text")).cast("long")).alias("n_words")).withColumn("n_figures", n).withColumn("mode", F.when(F.col("n_docs") > 1, "multi").otherwise("single"))


def recent_questions(history: DataFrame, keep: int = 8, by: str = "workspace") -> DataFrame:
    """The last `keep` questions of each workspace."""
    return history.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("asked_ord")))).where(F.col("n") <= keep).drop("n")
