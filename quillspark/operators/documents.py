"""Operators over document tables: sentences, sections, passages, hints, keywords, retrieval, names and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.tables import settle


def sentence_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, position, sentence) of every kept sentence."""
    return docs.select("doc_id", F.posexplode(T.sentences(F.col(text))).alias("position", "sentence"))


def passage_rows(docs: DataFrame, max_words: int = 120, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.passages(T.sentences(F.col(text)), max_words)).alias("passage_index", "passage"))


def page_passages(pages: DataFrame, max_words: int = 120) -> DataFrame:
    """Passages of (doc_id, page_number, page_text) rows; a document's passages are numbered across its pages."""
    rows = pages.select("doc_id", "page_number", F.posexplode(T.passages(T.sentences(F.col("page_text")), max_words)).alias("at", "passage"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "at")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("passage_index"), "page_number", "passage")


def term_hits(docs: DataFrame, groups: dict[str, list[str]], text: str = "text") -> DataFrame:
    """(doc_id, term_group, hits): how many of a group's terms a text has."""
    pairs = T.once(
        T.term_words(F.coalesce(F.col(text), F.lit("")), [t for terms in groups.values() for t in terms]),
        lambda seen: F.array(*[F.struct(F.lit(g).alias("term_group"), T.words_count(seen, terms).cast("long").alias("hits")) for g, terms in groups.items()]),
    )
    return docs.select("doc_id", F.explode(F.filter(pairs, lambda p: p["hits"] > 0)).alias("h")).select("doc_id", "h.*")


def domain_hints(docs: DataFrame, groups: dict[str, list[str]] = L.DOMAIN, most: int = 4, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, category, hint_no, hint): the first `most` sentences of each document that hold a term of the category.

    A category without one has a row with null hint_no and hint. Built in the row. With pages (doc_id, page_number,
    page_text) a column page_number says where the sentence stands.
    """
    every = [t for ts in groups.values() for t in ts]
    tagged = F.transform(
        T.sentences(F.col("text")),
        lambda x: F.struct(
            x.alias("sentence"),
            T.once(T.term_words(x, every), lambda seen: F.filter(F.array(*[F.when(T.words_have_any(seen, ts), F.lit(g)) for g, ts in groups.items()]), lambda g: g.isNotNull())).alias("of"),
        ),
    )

    def of_group(rows: Column, g: str) -> Column:
        hits = F.transform(F.slice(F.filter(rows, lambda r: F.array_contains(r["of"], g)), 1, most), lambda r, i: F.struct((i + 1).alias("hint_no"), r["sentence"].alias("hint")))
        none = F.array(F.struct(F.lit(None).cast("int").alias("hint_no"), F.lit(None).cast("string").alias("hint")))
        return F.struct(F.lit(g).alias("category"), F.when(F.size(hits) > 0, hits).otherwise(none).alias("hints"))

    found = T.once(tagged, lambda rows: F.array(*[of_group(rows, g) for g in groups]))
    rows = docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.category", F.explode("f.hints").alias("h")).select("doc_id", "category", "h.*")
    return rows if pages is None else with_pages(rows, pages, "hint")


def section_array(c: Column, aliases: dict[str, list[str]]) -> Column:
    """Array of (section, section_text): lines under the last heading before them.

    `references` is skipped, body is first, then sections follow by their first heading; those without lines are left out.
    """
    return T.by_script(c, lambda x: _section_array(x, aliases))


def _section_array(c: Column, aliases: dict[str, list[str]]) -> Column:
    lines = F.transform(T.text_lines(T.clean_text(c)), lambda x: F.struct(x.alias("line"), T.section_of(x, aliases).alias("heading")))

    def parts(rows: Column) -> Column:
        """(section, lines) from each heading to the next, and of what stands before the first."""
        at = F.concat(F.array(F.lit(-1)), F.filter(F.transform(rows, lambda r, i: F.when(r["heading"].isNotNull(), i)), lambda i: i.isNotNull()))
        return T.once(
            at,
            lambda heads: F.transform(
                heads,
                lambda i, k: F.struct(
                    F.coalesce(F.get(rows, i)["heading"], F.lit("body")).alias("section"),
                    F.transform(F.slice(rows, i + 2, F.coalesce(F.get(heads, k + 1), F.size(rows)) - i - 1), lambda r: r["line"]).alias("lines"),
                ),
            ),
        )

    def merged(found: Column) -> Column:
        names = F.filter(F.array_distinct(F.transform(found, lambda p: p["section"])), lambda n: n != "references")
        texts = F.transform(names, lambda n: F.struct(n.alias("section"), F.array_join(F.flatten(F.transform(F.filter(found, lambda p: p["section"] == n), lambda p: p["lines"])), "\n").alias("section_text")))
        return F.filter(texts, lambda t: t["section_text"] != "")

    return T.once(T.once(lines, parts), merged)


def sections(docs: DataFrame, aliases: dict[str, list[str]] = L.SECTION_ALIASES, text: str = "text") -> DataFrame:
    """(doc_id, section, section_ord, section_text), built in the row: no text is shuffled."""
    found = section_array(F.col(text), aliases)
    return docs.select("doc_id", F.posexplode(found).alias("section_ord", "s")).select("doc_id", "s.section", "section_ord", "s.section_text")


def candidate_array(c: Column, aliases: dict[str, list[str]]) -> Column:
    """Array of (section, position, ord, sentence): sentences of the sections, citations stripped, fit for a summary."""
    return T.by_script(c, lambda x: _candidate_array(x, aliases))


def _candidate_array(c: Column, aliases: dict[str, list[str]]) -> Column:
    def of_section(s: Column) -> Column:
        rows = F.transform(
            T.sentences(s["section_text"]), lambda x, i: F.struct(s["section"].alias("section"), i.alias("position"), T.strip_citations(x).alias("sentence"))
        )
        return F.filter(rows, lambda r: ~T.is_bad_for_summary(r["sentence"]))

    found = F.flatten(F.transform(section_array(c, aliases), of_section))
    return F.transform(found, lambda r, i: F.struct(r["section"].alias("section"), r["position"].alias("position"), i.alias("ord"), r["sentence"].alias("sentence")))


def summary_candidates(docs: DataFrame, aliases: dict[str, list[str]] = L.SECTION_ALIASES) -> DataFrame:
    """(doc_id, section, position, ord, sentence): sentences of the sections, citations stripped, fit for a summary."""
    return docs.select("doc_id", F.explode(candidate_array(F.col("text"), aliases)).alias("c")).select("doc_id", "c.*")


def best_by_role(candidates: Column, terms: list[str], preferred: list[str], chosen: Column | None = None, chosen_bonus: float = 0.35) -> Column:
    """The best of a candidate array for a role as (score, neg_ord, sentence, section), null if none has a term.

    Twice the terms, 0.35 for each place of its section before the end of the preferred ones, up to 0.25 for an early
    position, and chosen_bonus if the sentence is among the chosen ones. Ties: the earlier candidate. The section is that
    of the first candidate of the same text.
    """

    def scored(r: Column) -> Column:
        rank = F.coalesce(*[F.when(r["section"] == s, F.lit(i)) for i, s in enumerate(preferred)], F.lit(len(preferred)))
        extra = F.lit(0.0) if chosen is None else F.when(F.array_contains(chosen, r["sentence"]), chosen_bonus).otherwise(0.0)
        return T.once(
            T.count_terms(r["sentence"], terms),
            lambda hits: F.when(
                hits > 0,
                F.struct(
                    F.round(2.0 * hits + 0.35 * (len(preferred) - rank) + F.greatest(F.lit(0.0), 0.25 - 0.03 * r["position"]) + extra, 6).alias("score"),
                    (-r["ord"]).alias("neg_ord"),
                    r["sentence"].alias("sentence"),
                ),
            ),
        )

    best = F.array_max(F.filter(F.transform(candidates, scored), lambda x: x.isNotNull()))
    return T.once(
        best, lambda b: F.when(b.isNotNull(), b.withField("section", F.get(F.filter(candidates, lambda r: r["sentence"] == b["sentence"]), F.lit(0))["section"]))
    )


def role_evidence(
    docs: DataFrame,
    aliases: dict[str, list[str]] = L.SECTION_ALIASES,
    roles: dict[str, list[str]] = L.ROLES,
    preferred: dict[str, list[str]] = L.ROLE_SECTIONS,
) -> DataFrame:
    """(doc_id, role, score, section, ord, sentence): the best candidate of each document and role, built in the row."""
    best = T.once(
        candidate_array(F.col("text"), aliases),
        lambda cands: F.array(*[F.struct(F.lit(r).alias("role"), best_by_role(cands, terms, preferred.get(r, [])).alias("b")) for r, terms in roles.items()]),
    )
    rows = docs.select("doc_id", F.explode(best).alias("r")).where("r.b is not null")
    return rows.select("doc_id", "r.role", "r.b.score", "r.b.section", (-F.col("r.b.neg_ord")).alias("ord"), "r.b.sentence")


def research_brief(
    docs: DataFrame,
    aliases: dict[str, list[str]] = L.SECTION_ALIASES,
    roles: dict[str, list[str]] = L.ROLES,
    preferred: dict[str, list[str]] = L.ROLE_SECTIONS,
    pages: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, role, evidence, section, detected, detected_count, coverage): one row per document and role.

    Null evidence where no candidate has a term of the role. With pages a column page_number says where it stands.
    """

    def items(cands: Column) -> Column:
        return F.array(*[F.struct(F.lit(r).alias("role"), best_by_role(cands, terms, preferred.get(r, [])).alias("b")) for r, terms in roles.items()])

    counted = T.once(
        T.once(candidate_array(F.col("text"), aliases), items),
        lambda rows: F.struct(rows.alias("rows"), F.size(F.filter(rows, lambda r: r["b"].isNotNull())).alias("n")),
    )
    rows = docs.select("doc_id", counted.alias("c")).select("doc_id", F.explode("c.rows").alias("r"), F.col("c.n").alias("detected_count"))
    out = rows.select(
        "doc_id", "r.role", F.col("r.b.sentence").alias("evidence"), "r.b.section", F.col("r.b").isNotNull().alias("detected"), "detected_count", F.round(F.col("detected_count") / len(roles), 6).alias("coverage")
    )
    return out if pages is None else with_pages(out, pages, "evidence")


def evidence_pages(sentences: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, sentence, page_number): the first page whose normalized text holds the normalized sentence, else null."""
    s = sentences.select("doc_id", "sentence").distinct().withColumn("k", T.page_key(F.col("sentence")))
    p = pages.select("doc_id", "page_number", T.page_key(F.col("page_text")).alias("page"))
    met = s.join(p, "doc_id", "left").groupBy("doc_id", "sentence").agg(F.min(F.when((F.col("k") != "") & F.contains(F.col("page"), F.col("k")), F.col("page_number"))).alias("page_number"))
    return met


def with_pages(rows: DataFrame, pages: DataFrame, sentence: str) -> DataFrame:
    """rows with page_number, the page that holds the sentence of their document, null if none does."""
    wanted = rows.where(F.col(sentence).isNotNull()).select("doc_id", F.col(sentence).alias("sentence"))
    found = evidence_pages(wanted, pages).select("doc_id", F.col("sentence").alias(sentence), "page_number")
    return rows.join(found, ["doc_id", sentence], "left").select(*rows.columns, "page_number")


def term_list(c: Column, stop: list[str] = L.STOP_WORDS) -> Column:
    """Array of a text's words of two characters or more that are no stop words, in order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(T.by_script(low, lambda x: F.regexp_extract_all(x, F.lit(T.term_pattern()), F.lit(0))), lambda w: ~w.isin(stop))


def term_counts(c: Column, stop: list[str] = L.STOP_WORDS) -> Column:
    """Array of (term, tf) of a text, by term: words of two characters or more, and pairs of what stop words leave."""
    found = term_list(c, stop)
    pair = lambda ws: F.filter(F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())

    def runs(terms: Column) -> Column:
        at = F.filter(F.transform(terms, lambda x, i: F.when((i == 0) | (x != F.get(terms, i - 1)), i)), lambda i: i.isNotNull())
        return T.once(at, lambda a: F.transform(a, lambda i, k: F.struct(F.get(terms, i).alias("term"), (F.coalesce(F.get(a, k + 1), F.size(terms)) - i).alias("tf"))))

    return T.once(T.once(found, lambda ws: F.sort_array(F.concat(ws, pair(ws)))), runs)


def term_rows(units: DataFrame, keys: list[str], text: str, stop: list[str] = L.STOP_WORDS) -> DataFrame:
    """(keys, term, tf) of each unit's terms, counted in the row."""
    return units.select(*keys, F.explode(term_counts(F.col(text), stop)).alias("t")).select(*keys, "t.*")


def keywords(docs: DataFrame, top: int = 15, features: int = 500, text: str = "text", stop: list[str] = L.STOP_WORDS) -> DataFrame:
    """(doc_id, rank, keyword, score): each document's most frequent terms, scored by the L2-normalized frequency.

    Of one document alone every idf is 1, so the score is the frequency over the norm of the `features` most frequent
    (of one frequency the first by term). Built in the row.
    """
    by_tf = F.sort_array(F.transform(term_counts(T.clean_text(F.col(text)), stop), lambda t: F.struct((-t["tf"]).alias("neg"), t["term"].alias("term"))))
    best = T.once(
        F.slice(by_tf, 1, features),
        lambda kept: T.once(
            F.sqrt(F.aggregate(kept, F.lit(0.0), lambda acc, t: acc + t["neg"] * t["neg"])),
            lambda norm: F.transform(F.slice(kept, 1, top), lambda t, i: F.struct((i + 1).alias("rank"), t["term"].alias("keyword"), F.round(-t["neg"] / norm, 6).alias("score"))),
        ),
    )
    return docs.select("doc_id", F.explode(best).alias("k")).select("doc_id", "k.*")


def keyword_overlap(docs: DataFrame, top: int = 15) -> DataFrame:
    """(keyword, n_docs, doc_id): doc_id where a keyword is one document's alone."""
    return keywords(docs, top).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs"), F.when(F.count(F.lit(1)) == 1, F.min("doc_id")).alias("doc_id"))


def retrieve(passages: DataFrame, queries: DataFrame, top: int = 4, stop: list[str] = L.STOP_WORDS) -> DataFrame:
    """Each query's passages by TF-IDF cosine similarity: (query_id, doc_id, passage_index, score, rank).

    The corpus of a query is all passages and the query itself, so document frequencies count it. Terms are counted in
    the row; frequencies and squared norms take one exchange by term each, and only terms that a query has are matched.
    Ties rank the larger doc_id, then the later passage, first. Further columns of passages come along.
    """
    keys = ["doc_id", "passage_index"]
    counted = settle(passages.withColumn("terms_", term_counts(F.col("passage"), stop)))
    n = counted.count()
    tf = counted.select(*keys, F.explode("terms_").alias("t")).select(*keys, "t.*")
    df = settle(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    # idf without the query's own terms is one per term; a query adds one to the frequency of its terms
    base = F.log(F.lit(2 + n) / (1 + F.col("df"))) + 1
    mine = F.log(F.lit(2 + n) / (2 + F.coalesce("df", F.lit(0)))) + 1
    asked = settle(
        term_rows(queries, ["query_id"], "query", stop).withColumnRenamed("tf", "qtf").join(df, "term", "left").withColumn("idf", mine).withColumn("old", F.when(F.col("df").isNotNull(), base))
    )
    qnorm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("qnorm"))
    hits = tf.join(asked.select("query_id", "term", "qtf", "idf", "old"), "term").groupBy("query_id", *keys).agg(
        F.sum(F.col("tf") * F.col("qtf") * F.col("idf") * F.col("idf")).alias("dot"), F.sum(F.pow(F.col("tf") * F.col("idf"), 2) - F.pow(F.col("tf") * F.col("old"), 2)).alias("shift")
    )
    met = tf.join(asked.select("term").distinct(), "term", "left_semi").select(*keys).distinct()
    plain = tf.join(met, keys, "left_semi").join(df, "term").groupBy(*keys).agg(F.sum(F.pow(F.col("tf") * base, 2)).alias("square"))
    score = F.round(F.col("dot") / (F.col("qnorm") * F.sqrt(F.col("square") + F.col("shift"))), 6)
    rows = hits.join(plain, keys).join(qnorm, "query_id").withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"), F.desc("passage_index"))
    best = rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= top) & (F.col("score") > 1e-9)).select("query_id", *keys, "score", "rank")
    more = [c for c in passages.columns if c not in keys]
    return best.join(counted.select(*keys, *more), keys).select("query_id", *keys, "score", "rank", *more)


def question_types(queries: DataFrame, types: dict[str, list[str]] = L.QUESTION_TYPES) -> DataFrame:
    """(query_id, question_type): the type with the most matched patterns, longer ones counting more; none: general."""
    score = {t: sum((T.contains_intent(F.col("query"), p).cast("int") * (1 + 0.35 * min(len(p.split()) - 1, 2)) for p in ps), F.lit(0.0)) for t, ps in types.items()}
    found = F.array(*[F.struct(F.round(s, 6).alias("score"), F.lit(-i).alias("place"), F.lit(t).alias("type")) for i, (t, s) in enumerate(score.items())])
    best = T.once(F.array_max(found), lambda b: F.when(b["score"] > 0, b["type"]).otherwise("general"))
    return queries.select("query_id", best.alias("question_type"))


def unique_names(uploads: DataFrame) -> DataFrame:
    """(upload_ord, name, unique_name): a name already in use gets the least free ` (k)` before its suffix, in order.

    Only names that differ in such numbers alone can meet, so they are dealt by the rest of the name and read in order,
    as a stream: what is kept is one entry per distinct name, whatever the number of uploads.
    """

    def run(batches):
        import re
        from pathlib import PurePath

        import pyarrow as pa

        family, given, least = None, set(), {}
        numbered = re.compile(r"(.*) \(([1-9][0-9]*)\)", re.S)

        def free(name: str) -> bool:
            if name in given:
                return False
            path = PurePath(name)
            m = numbered.fullmatch(path.stem)
            return not (m and 2 <= int(m[2]) < least.get((m[1], path.suffix), 2) and str(path) == path.name)

        for batch in batches:
            out = []
            for own, name in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != family:
                    family, given, least = own, set(), {}
                if name is None or free(name):
                    given.add(name)
                    out.append(name)
                    continue
                path = PurePath(name)
                k = least.get((path.stem, path.suffix), 2)
                while not free(f"{path.stem} ({k}){path.suffix}"):
                    k += 1
                    least[path.stem, path.suffix] = k
                least[path.stem, path.suffix] = k + 1
                out.append(f"{path.stem} ({k}){path.suffix}")
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.string())], ["upload_ord", "name", "unique_name"])

    family = F.regexp_replace(F.regexp_replace("name", "(?s)^.*/", ""), r"(?s)( \(\d+\))+(\.[^.]*)?$", "$2")
    n = int(uploads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = uploads.select(family.alias("family"), "upload_ord", "name").repartition(n, "family").sortWithinPartitions("family", "upload_ord")
    kind = uploads.schema["upload_ord"].dataType.simpleString()
    return dealt.mapInArrow(run, f"upload_ord {kind}, name string, unique_name string")


def upload_limits(uploads: DataFrame, most_files: int, most_bytes: int, by: str = "workspace") -> DataFrame:
    n, size = F.count(F.lit(1)), F.sum("size_bytes")
    return uploads.groupBy(by).agg(F.when(n > most_files, "too_many_files").when(size > most_bytes, "total_size_exceeded").alias("violation"))


def captions(blocks: DataFrame) -> DataFrame:
    """Blocks of a page that begin like a figure's caption, their text cleaned and in one line."""
    neat = F.replace(T.clean_text(F.col("text")), F.lit("\n"), F.lit(" "))
    return blocks.withColumn("text", neat).where(F.col("text").rlike(r"(?iU)^[\s\x1c-\x1f]*(fig(ure)?s?\.?[\s\x1c-\x1f]*[a-z]?\d+|图[\s\x1c-\x1f]*[a-z]?\d+)"))


def nearest_captions(images: DataFrame, blocks: DataFrame, most: float = 220.0) -> DataFrame:
    """(doc_id, page_number, image_no, caption): the nearest caption of the page; one above counts 35 further off."""
    c = captions(blocks).select("doc_id", "page_number", "block_no", F.col("y0").alias("cy0"), F.col("y1").alias("cy1"), F.col("text").alias("caption"))
    d = F.when(F.col("cy0") >= F.col("y1"), F.col("cy0") - F.col("y1")).when(F.col("cy1") <= F.col("y0"), F.col("y0") - F.col("cy1") + 35).otherwise(F.abs(F.col("cy0") - F.col("y1")) + 15)
    met = images.join(c, ["doc_id", "page_number"], "left").withColumn("d", d)
    best = met.groupBy("doc_id", "page_number", "image_no").agg(F.min_by("caption", F.struct("d", "block_no")).alias("caption"), F.min("d").alias("d"))
    return best.select("doc_id", "page_number", "image_no", F.when(F.col("d") <= most, F.col("caption")).alias("caption"))
