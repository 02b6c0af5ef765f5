"""Every stage of the corpus pipeline against plain Python, and run() as their chain."""

import random
from collections import defaultdict

import pytest
from test_neardup import brute
from test_packing import plain as token_ids

import corpus_pipeline as P
from quillspark.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, row int, class_id long"
LICENSE = "This very line of a license stands in many of the documents."
ITEM = "which of the twelve grey harbours lies north of the old salt road near the mill"


def rows_of():
    rng = random.Random(21)
    parts = {"xx": ["ka", "ro", "mi", "tek", "sol", "un", "der"], "yy": ["eau", "lé", "ñi", "gar", "sch", "ve", "ouz"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(300):
        lang = ("xx", "yy")[i % 2]
        text = " ".join(word(lang) for _ in range(rng.randint(30, 120)))
        rows.append([i, text, lang])
    for i in range(6):  # a line that they share
        rows[10 + i][1] += f"\n {LICENSE}\nend {rows[10 + i][2]}"
    rows.append([400, rows[20][1] + " sol", "xx"])  # near and exact copies
    rows.append([401, rows[24][1].upper(), "xx"])
    rows.append([None, rows[22][1], "xx"])
    rows.append([402, rows[30][1] + f" ({ITEM.title()}) " + rows[32][1], "xx"])  # a benchmark passage
    rows.append([403, ITEM + " karo", None])  # little else than one
    rows.append([404, "это совсем другой язык и другая азбука " * 3, None])
    rows.append([405, None, "xx"])
    rows.append([406, "", "yy"])
    rows.append([407, "12 34 !", None])
    rows.append([408, f"{LICENSE}", "xx"])  # the last that holds the line
    rows.append([None, "kato misol unka rotek", "xx"])
    return [(i, t, lang, "s", len(t or ""), "own kept", 3, 4, 5) for i, t, lang in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows_of(), SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def by_id(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def lines(rows):
    """Lines of 40 characters or more that five documents hold stay in the largest one; what is left empty by that goes."""
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[x.strip(" \t\n\v\f\r").lower()].add(i)
    out = []
    for i, t, *_ in rows:
        kept = [x for x in (t or "").split("\n") if len(k := x.strip(" \t\n\v\f\r").lower()) < 40 or len(held[k]) < 5 or i == max(d for d in held[k] if d is not None)]
        if len(kept) == len((t or "").split("\n")) or "\n".join(kept).strip(" "):
            out.append((i, "\n".join(kept)))
    return out


def firsts(rows):
    """Of each group of near-duplicates the row of the least doc_id (null last)."""
    group, _ = brute([t for _, t in rows])
    best = {}
    for k, (i, t) in enumerate(rows):
        order = (i is None, i or 0, k)
        if not (t or "").strip():
            best[k, "alone"] = (order, k)
        elif group[k] not in best or order < best[group[k]][0]:
            best[group[k]] = (order, k)
    return [rows[k] for _, k in best.values()]


def test_language_id(spark, docs, sf_dir):
    out = P.language_id(spark, docs, sf_dir)
    assert out.dtypes == docs.dtypes and {(r.kept, r.score, r["row"], r.class_id) for r in out.collect()} == {("own kept", 3, 4, 5)}
    gone = {404, 405, 406, 407}
    assert pairs(out.where("doc_id not in (403, 408) or doc_id is null")) == by_id(r for r in rows_of() if r[0] not in gone | {403, 408})


def test_line_dedup(spark, docs, sf_dir):
    out = P.line_dedup(spark, docs, sf_dir)
    assert out.dtypes == docs.dtypes
    assert pairs(out) == by_id(lines(rows_of()))
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_near_dedup(spark, docs, sf_dir):
    out = P.near_dedup(spark, docs, sf_dir)
    assert out.dtypes == docs.dtypes
    got, want = pairs(out), by_id(firsts([(r[0], r[1]) for r in rows_of()]))
    assert got == want and len(got) == len(rows_of()) - 3


def test_decontamination(spark, docs, sf_dir):
    out = {r.doc_id: r.text for r in P.decontamination(spark, docs, sf_dir).collect()}
    assert 403 not in out and ITEM.title() not in out[402] and out[402].startswith(rows_of()[30][1]) and out[402].endswith(rows_of()[32][1])
    same = {r[0]: r[1] for r in rows_of() if r[0] not in (402, 403, None)}
    assert {i: t for i, t in out.items() if i in same} == same


def test_best_fit_packing(spark, docs, sf_dir):
    check_packed(P.best_fit_packing(spark, docs, sf_dir).collect(), [(r[0], r[1]) for r in rows_of()])


def check_packed(got, rows):
    assert sorted((str(r.doc_id), r.length) for r in got) == sorted((str(i), len(token_ids(t)) + 1) for i, t in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [at for at, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= packing.CAPACITY
    total = sum(n for own in bins.values() for _, n in own)
    assert len(bins) <= 1 + 1.1 * total / packing.CAPACITY


def test_run_is_the_chain(spark, sf_dir):
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    got = P.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {400, 401, 403, 404, 405, 406, 407} and {402, *range(10, 16), *range(100, 300)} <= ids
    rows = [r for r in rows_of() if r[0] not in (403, 404, 405, 406, 407, 408)]
    texts = dict(firsts([(i, t) for i, t in lines([*rows, rows_of()[-2]])]))
    texts[402] = texts[402].replace(ITEM.title(), "")
    check_packed([r for r in got if r.doc_id != 408], [(i, t) for i, t in texts.items() if i != 408])


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables(spark, docs, sf_dir, stage):
    out = P.STAGES[stage][1](spark, docs.limit(0), sf_dir)
    assert out.count() == 0 and (stage == 4 or out.columns == docs.columns)
