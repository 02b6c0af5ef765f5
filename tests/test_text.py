"""Rules of text and sentences: boundary values, marks, marks with closers, and lines; texts are about a harbour."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markup
from quillspark.functions import text as T
from quillspark.operators import documents as O


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).head()[0]


def many(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("Nets were\nmended at\nnight. Boats left\nearly on Monday.", ["Nets were mended at night.", "Boats left early on Monday."]),
        ("Nets were mended.\n\nat night they slept ashore.", ["at night they slept ashore."]),  # three words, then a new paragraph
        ("TIDES\nThe pier was closed all winter.\nRESULTS:\nIt was opened again in May.", ["The pier was closed all winter.", "It was opened again in May."]),
        ("- Ropes were sold by weight.\n- Tar was sold\nby the barrel.", ["Ropes were sold by weight.", "Tar was sold by the barrel."]),
        ("5 He wrote \"all boats are in.\"\nThen he went home to sleep.", ["5 He wrote \"all boats are in.\"", "Then he went home to sleep."]),  # numbered, but ends in a mark and a quote
        ("5 boats in the bay\nThen he went home to sleep.", ["Then he went home to sleep."]),  # numbered without a mark: a heading
        ("It rained (as it always does.) So they stayed in.", ["It rained (as it always does.)", "So they stayed in."]),
        ("See Refs. 22 and 31 for it. Ask Prof. Lund or et\nal. about that one.", ["See Refs. 22 and 31 for it.", "Ask Prof. Lund or et al. about that one."]),
        ("船只在清晨离开港口前往外海。他说：“天气非常好适合远航！”随后大家回家休息去了。", ["船只在清晨离开港口前往外海。", "他说：“天气非常好适合远航！”", "随后大家回家休息去了。"]),
        ("This line goes on without any", []),
        ("Four words are enough. Three are not.", ["Four words are enough."]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, T.sentences) == want


def test_noise_and_summary_filters(spark):
    fill = " ".join(["word"] * 80)
    cases = [
        ("The appendix and the long table are bound.", True, True),  # two markers
        ("The appendix alone is bound in red.", False, False),
        ("One tab. of it and a figure are here.", False, False),  # only the listed markers count
        (f"{fill} and six more words stand here.", False, True),  # 87 words: 90 and 85 are the limits
        (f"{fill} and four more.", False, False),
        ("Write to the keeper at email: pier today.", False, True),
        ("It was a preprint of the town press.", True, False),
        ("The sum is a = b + c / d + e = f + g here.", True, True),
        ("On days 11 12 13 14 15 16 17 18 it rained without any end here.", False, False),
        ("On days 11 12 13 14 15 16 17 18 19 it rained without any end here.", True, True),
        ("12345-678 is the number of that boat.", True, False),
        ("No end mark stands after these words", True, True),
        ("", True, True),
    ]
    texts = [c[0] for c in cases]
    assert many(spark, texts, T.is_noisy) == [c[1] for c in cases]
    assert many(spark, texts, T.is_bad_for_summary) == [c[2] for c in cases]


def test_headings(spark):
    lines = ["Results:", "3.2 Methods", "iv. Nets and ropes", "THE OLD PIER", "THE OLD PIER IS LONG AND IT WAS BUILT BY HAND", "12 boats came.", "12 boats came.”", "12 boats came", "Mid tide", "The results"]
    assert many(spark, lines, T.is_heading) == [True, True, True, True, False, False, False, True, True, False]


def test_citations(spark):
    cases = [("Ropes [1] hold [2,3] .", "Ropes hold."), ("Kept [ 4 ] and [5,6,].", "Kept and."), ("A dash [1–3] stays.", "A dash [1–3] stays."), (" So [a] ,  too ", "So [a], too")]
    assert many(spark, [c[0] for c in cases], T.strip_citations) == [c[1] for c in cases]
    assert one(spark, "Net[1]mended, at Night!", T.page_key) == "net mended at night"


def test_clean_text(spark):
    cases = [("a-\n b", "ab"), ("x (cid:7) y", "x y"), ("\r\nA ( b ) ;\tc■■d", "A (b); c d"), ("a\n\n\n\nb", "a\n\nb"), (None, "")]
    assert many(spark, [c[0] for c in cases], T.clean_text) == [c[1] for c in cases]


def test_passages(spark):
    rows = [(["a b c.", "d e.", "f g h i j k.", "l."],)]
    df = spark.createDataFrame(rows, "a array<string>")
    got = {n: df.select(T.passages(F.col("a"), n)).head()[0] for n in (1, 4, 5, 100)}
    assert got[1] == ["a b c.", "d e.", "f g h i j k.", "l."]
    assert got[4] == got[1] and got[5] == ["a b c. d e.", "f g h i j k.", "l."] and len(got[100]) == 1


def test_terms(spark):
    cases = [("Nets were sold.", "net", False), ("A net, sold.", "net", True), ("net2 was sold", "net", False), ("the_net_", "net", True), ("渔net网", "net", True), ("渔网很大", "渔网", True), ("old  oak\nboat", "old oak boat", True), ("Ox-Bow lake", "ox-bow", True), ("", "net", False), ("any", " ", False)]
    for text, term, want in cases:
        assert one(spark, text, lambda c, t=term: T.contains_term(c, t)) is want, (text, term)
        assert one(spark, text, lambda c, t=term: T.any_term(c, [t, "zzz"])) is want
        assert one(spark, text, lambda c, t=term: T.count_terms(c, [t, t, "zzz"])) == 2 * want
    assert one(spark, "the_net_", lambda c: T.contains_intent(c, "net")) is False
    assert one(spark, "渔net网", lambda c: T.contains_intent(c, "net")) is False


def test_sections_follow_their_headings(spark):
    text = "Before any.\nResults\nMethods\nBy hand.\nReferences\nA book.\nResults\nIt held."
    got = O.sections(spark.createDataFrame([(1, text), (2, "References\nonly"), (3, None)], "doc_id int, text string")).collect()
    assert [(r.doc_id, r.section, r.section_ord, r.section_text) for r in got] == [(1, "body", 0, "Before any."), (1, "results", 1, "It held."), (1, "methods", 2, "By hand.")]


def test_names_in_use(spark):
    names = ["n.txt", "n (2).txt", "n.txt", "n.txt", "n (3).txt", "n (2).txt", ".rc", ".rc", "deep.tar.gz", "deep.tar.gz", "m", "m (3)", "m", "m", None, "n (2) (2).txt"]
    rows = spark.createDataFrame(list(enumerate(names)), "upload_ord int, name string")
    used, want = set(), []
    for n in names:
        if n is not None and n in used:
            stem, dot, suffix = n.rpartition(".")
            stem, suffix = (stem, dot + suffix) if stem else (n, "")
            n = next(c for k in range(2, 99) if (c := f"{stem} ({k}){suffix}") not in used)
        used.add(n)
        want.append(n)
    assert [r.unique_name for r in O.unique_names(rows).orderBy("upload_ord").collect()] == want
    assert len(set(want)) == len(want)


def test_keywords(spark):
    got = O.keywords(spark.createDataFrame([(1, "net boat net"), (2, None), (3, "the of")], "doc_id long, text string")).orderBy("doc_id", "rank").collect()
    assert [(r.doc_id, r.keyword, r.score) for r in got] == [(1, "net", 0.755929), (1, "boat", 0.377964), (1, "boat net", 0.377964), (1, "net boat", 0.377964)]


def test_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Boats come in at dusk."), (1, 2, None), (1, 3, "Nets[4]dry on the wall. Boats come in at dusk.")], "doc_id long, page_number int, page_text string")
    s = spark.createDataFrame([(1, "Boats come in at dusk."), (1, "Nets dry on the wall."), (1, "Nobody came."), (2, "Nets dry on the wall."), (1, "...")], "doc_id long, sentence string")
    assert {(r.doc_id, r.sentence): r.page_number for r in O.evidence_pages(s, pages).collect()} == {(1, "Boats come in at dusk."): 1, (1, "Nets dry on the wall."): 3, (1, "Nobody came."): None, (2, "Nets dry on the wall."): None, (1, "..."): None}


def test_localized(spark):
    assert one(spark, "**Why:** Weak light", markup.localized) == "**判断依据：** 弱 light"


def test_patterns_of_ascii_texts_find_the_same(spark):
    from quillspark.plans import fixtures as X

    texts = [(x,) for x in [*X.TEXTS, *X.LINES, *X.CITED, "A\x1cB \x0b C. D\te (cid:4) f", "one\x1f. (two. ) 3 nm"]]
    docs = spark.createDataFrame(texts, "t string").where("octet_length(t) = length(t)")
    for f in (T.sentences, T.logical_lines, T.clean_text, T.strip_citations, T.tokens, T.is_noisy, T.is_bad_for_summary, T.normalize_heading):
        plain = T._PLAIN.set(True)
        try:
            fast = f(F.col("t"))
        finally:
            T._PLAIN.reset(plain)
        general = T._PLAIN.set(False)
        try:
            slow = f(F.col("t"))
        finally:
            T._PLAIN.reset(general)
        assert docs.where(~fast.eqNullSafe(slow)).count() == 0, f.__name__


def test_single_blanks_need_no_match(spark):
    texts = ["a b", " a  b ", "a\tb", "A, b. c", "x \n y\x1cz", " a b", "a . b", "..", " ", "", "é a-b (c)"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    assert docs.where(T.dedup_key(t) != F.trim(F.regexp_replace(F.lower(t), "[^a-zA-Z0-9]+", " "))).count() == 0
    assert docs.where(F.regexp_replace(t, T.SPACED, " ") != F.regexp_replace(t, T.WHITE + "+", " ")).count() == 0
    assert docs.select(F.sum(F.regexp_count(t, F.lit(T.SPACED)))).first()[0] < docs.select(F.sum(F.regexp_count(t, F.lit(T.WHITE + "+")))).first()[0]


def test_a_filter_folds_a_sentence_once(spark):
    for judged in (T.is_noisy, T.is_bad_for_summary):
        plan = spark.range(1).select(judged(F.concat("id", F.lit("x"))).alias("bad"))._jdf.queryExecution().analyzed().toString()
        assert 1 <= plan.count("lower(") <= 2  # once for ASCII, once for all else


def test_blanks_are_those_of_unicode(spark):
    df = spark.range(1, 0x3100).select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    own = df.select("c", *[c.rlike(p).alias(f"p{i}") for i, (c, p) in enumerate([(F.col("c"), r"(?U)[\s\x1c-\x1f]"), (F.col("c"), T._p(r"(?U)[\s\x1c-\x1f]")), (F.col("c"), T._p(r"(?U)[^\s\x1c-\x1f]"))])])
    assert own.where("p0 != p1 or p0 = p2").count() == 0 and own.where("p0").count() > 20
