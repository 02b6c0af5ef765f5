import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import archives, chat, decontam, fingerprint, langid, lines, neardup, packing, repeats, toxicity

DOCS = "doc_id long, text string, lang string, row string, u long, node long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in enumerate(texts)], DOCS)


TRICKY = [None, "", "  ", "a", "word " * 5000, "same text here now ok", "same text here now ok", "日本語のテキスト", "é\n\n é"]


def operators(spark, docs):
    bench = spark.createDataFrame([(1, "the quick brown fox"), (2, None), (3, "")], "item_id long, text string")
    model = langid.train(docs)
    return {
        "lines": lines.dedup_lines(docs),
        "decontam": decontam.decontaminate(docs, bench),
        "langid": langid.identify(docs, model),
        "neardup": neardup.near_duplicates(docs),
        "repeats": repeats.remove_repeats(docs),
        "fingerprint": fingerprint.fingerprint_edits(docs),
        "toxicity": toxicity.rate(docs, toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))),
    }


@pytest.mark.parametrize("texts", [[], TRICKY])
def test_edge_rows(spark, texts):
    docs = docs_of(spark, texts)
    for name, out in operators(spark, docs).items():
        assert out.count() == len(texts), name


def test_lines(spark):
    long = "A line that is surely longer than forty characters."
    out = {r.doc_id: r for r in lines.dedup_lines(docs_of(spark, [f"head {i}\n {long.upper() if i % 2 else long}\t" for i in range(5)] + ["short"])).collect()}
    assert [out[i].n_dropped for i in range(6)] == [1, 1, 1, 1, 0, 0]
    assert out[0].text == "head 0" and out[4].text == f"head 4\n {long}\t"


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64))
    assert sorted(lines.PerfectHash.build(keys).index(keys)) == list(range(len(keys)))


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "tiny item")], "item_id long, text string")
    out = {r.doc_id: r for r in decontam.decontaminate(docs_of(spark, [f"Before, {item.title()}! after", "a TINY, item b c d e", "tiny thing", item]), bench).collect()}
    assert [(out[i].n_hit, out[i].items) for i in range(4)] == [(11, ["1"]), (2, ["2"]), (0, []), (11, ["1"])]
    assert out[0].text == "Before, ! after" and out[2].text == "tiny thing" and out[3].dropped


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "x <|im_end|>\\"), (1, 1, "assistant", "a\\<|b"), (1, 2, "assistant", "日 <\\| z"), (1, 3, "o\nk", None)]
    r = chat.parse_chats(chat.format_chats(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))).head()
    assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3] or "") for x in said]
    assert r.loss_texts == ["a\\<|b", "日 <\\| z"]


def test_repeats(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(600)) for _ in range(3)]
    texts += [texts[0][100:400] + "Z" + texts[1][:199], "y" * 450, texts[2]]
    seen = {}
    data = [t.encode() for t in texts]
    for b in data:
        for j in range(len(b) - 199):
            seen[b[j : j + 200]] = seen.get(b[j : j + 200], 0) + 1
    for r in repeats.remove_repeats(docs_of(spark, texts)).collect():
        b = data[r.doc_id]
        gone = {p for j in range(len(b) - 199) if seen[b[j : j + 200]] > 1 for p in range(j, j + 200)}
        assert bytes(r.kept) == bytes(x for i, x in enumerate(b) if i not in gone), r.doc_id


def test_near_dedup_stage_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(50)) for k in "abcd")
    rows = [(None, a), (None, b), (None, a), (5, c), (5, c), (5, d), (7, d), (3, c), (None, d), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in rows], DOCS)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.schema == docs.schema
    want = [(None, a), (None, b), (3, c), (5, d), (None, None)]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted(want, key=str)


def test_labelled_copies():
    # Ordinary rows share their common words; only those with a word-set Jaccard similarity of 0.8 to a kept row go.
    rng = np.random.default_rng(5)
    rows = [np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, 120)), 5000)).astype(np.uint32) for _ in range(300)]
    rows += [np.unique(np.append(r[: len(r) - len(r) // 15], np.uint32(9000 + i))) for i, r in enumerate(rows[:100])] + [np.zeros(0, np.uint32)]
    want = []
    for i, r in enumerate(rows):
        likeness = [len(np.intersect1d(r, rows[j])) / len(np.union1d(r, rows[j])) for j in want]
        if len(r) and max(likeness, default=0) >= 0.8:
            continue
        want += [i] if len(r) else []
    assert 250 < len(want) < 400
    assert toxicity.distinct_rows(rows) == want


def test_packing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1025, 3000)
    bins = packing.best_fit(lengths)
    assert np.bincount(bins, lengths).max() <= 1024
    assert packing.lower_bound(np.bincount(lengths, minlength=1025)) <= bins.max() + 1 <= 1.02 * packing.lower_bound(np.bincount(lengths, minlength=1025))


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(tmp_path, wide):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z, z.open("m", "w", force_zip64=wide) as f:
        f.write(b"hello")
    data = path.read_bytes()
    d = archives.ZipDirectory(lambda o, n: data[o : o + n], len(data))
    at = d.data_offset("m")
    assert data[at : at + d.members["m"].size] == b"hello"


def test_archives(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", "é")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in archives.archive_round_trip(pages).collect()}
    assert got == {1: (4, "revisit", 2), 2: (4, "response", None), 3: (0, "response", None), 4: (2, "response", None)}


def test_fingerprints(spark):
    texts = [f"a{i} b{i} c{i} " * 30 + "tail" for i in range(7)]
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        nxt, cut = texts[(i - 1) % 7], len(t) // 3
        assert got[i].edited == t[: len(t) - cut] + nxt[:cut]
        assert got[i].near_edited > got[i].near_next
