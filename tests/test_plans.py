"""Shapes of plans, and queries against their SQL on small tables."""

import re

import duckdb
import pytest

from quillspark.plans import registry


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    texts = ["The boats came in.\nOf nets\nThey were mended by hand at night. See Fig. 2 for it.", None, "", "Summary\nWe report that the oxide film shows an increase [1]. It was prepared at 300 K with care."]
    spark.createDataFrame([(i, t, ("a.txt", "b.txt")[i % 2], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    turns = [(5, 0, "user", "How are nets mended?"), (5, 1, "assistant", "The nets are mended by hand at night. They dry on the wall.")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(1, "nets mended by hand"), (2, "oxide film")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_operators_have_no_exchange(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(registry, "_spread", lambda df: df)
    for name in ("sentences", "sections", "summary_candidates", "domain_hints", "keywords", "role_evidence", "comparison", "term_hits"):
        text = plan(registry.queries()[name](spark, sf_dir))
        assert not re.search(r"Exchange|Python|Pandas|Arrow", text), name


def test_retrieval_ranks_in_the_tasks_first(spark, sf_dir):
    assert plan(registry.retrieve_multi(spark, sf_dir)).count("WindowGroupLimit") == 2


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", ["sentences", "sentence_quality", "role_evidence", "keyword_table", "retrieve_multi", "answers", "unique_names", "figures", "summary_texts"])
def test_query_is_its_sql(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    with duckdb.connect() as con:
        for table in ("documents", "conversations", "benchmark"):
            con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet/*.parquet'")
        want = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_one_row_group_beside_empty_splits_is_dealt_to_all_cores(spark, tmp_path):
    texts = [(i, f"The boat number {i} came in late.") for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = registry._texts(spark, str(tmp_path))
    held = [len(p) for p in docs.rdd.glom().collect()]
    assert sum(held) == 400 + len(registry.X.TEXTS) and max(held) <= sum(held) / 4


@pytest.mark.parametrize("name", ["summary_scores", "summaries"])
def test_summaries_read_the_documents_once(spark, sf_dir, name):
    assert plan(registry.queries()[name](spark, sf_dir)).count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["summary_scores", "summaries"])
def test_summary_query_is_its_sql(spark, sf_dir, name):
    test_query_is_its_sql(spark, sf_dir, name)
