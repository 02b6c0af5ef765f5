import pytest

from quillspark.operators import reports as R


def test_document_parts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.txt"), (2, None)], "doc_id long, name string")
    said = spark.createDataFrame([(1, "First. Later.")], "doc_id long, summary string")
    words = spark.createDataFrame([(1, 2, "film"), (1, 1, "oxide")], "doc_id long, rank int, keyword string")
    hints = spark.createDataFrame([(1, "future_work", 1, "It remains.", 3), (1, "method", None, None, None), (2, "method", None, None, None)], "doc_id long, category string, hint_no int, hint string, page_number int")
    parts = R.document_parts(docs, said, words, hints)
    got = {r.doc_id: r.part for r in parts.collect()}
    assert got[1].split("\n\n") == ["---", "## a.txt", "First. Later.", "### Keywords", "oxide, film", "### Domain evidence", "#### Future Work\n- It remains. [p. 3]"]
    assert "## 2" in got[2] and got[2].count("No ") == 2
    whole = R.report_parts(R.header_part(docs), parts, R.question_parts(spark.createDataFrame([(1, "Why?", None, "So.")], "asked_ord int, question string, target string, answer string")))
    R.write_report(whole, str(tmp_path / "report"), "block", "ord")
    text = "\n".join(r.value for r in sorted(spark.read.text(str(tmp_path / "report")).selectExpr("value", "input_file_name() f", "monotonically_increasing_id() i").collect(), key=lambda r: (r.f, r.i)))
    at = [text.index(x) for x in ("# Document report", "Documents analyzed: 2", "## a.txt", "## 2", "## Questions and grounded answers", "### Q1. Why?", "**Target:** All papers")]
    assert at == sorted(at)


def test_question_parts(spark):
    rows = [(1, "Why?", "a.txt", "### Grounded answer\n\nBecause."), (2, " ", "a.txt", "x"), (3, "How?", "all", "So."), (4, "When?", "all", None)]
    got = R.question_parts(spark.createDataFrame(rows, "asked_ord int, question string, target string, answer string")).collect()
    assert [(r.asked_ord, r.part) for r in got] == [(1, "### Q1. Why?\n\n**Target:** a.txt\n\n#### Grounded answer\n\nBecause."), (3, "### Q3. How?\n\n**Target:** all\n\nSo.")]


def test_names_go_with_documents(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, name string")
    assert R.checked_names(docs, names).count() == 2
    for wrong in (names.limit(1), names.unionByName(names.limit(1))):
        with pytest.raises(ValueError):
            R.checked_names(docs, wrong)
