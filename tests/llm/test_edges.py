"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing names, with the values they give."""

import os
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, decontam, lines, repeats
from quillspark.llm.common import rows_per_batch
from quillspark.llm.queries import op5_chat_format

LINE = "A line that is surely longer than forty characters."
LONG = "Deep " * 20_000
ROWS = [(None, LINE), (1, LINE), (2, f" {LINE.upper()}\t"), (3, f"{LINE}\n{LINE}"), (4, None), (5, ""), (6, LINE), (6, LINE), (7, LONG), (8, "\n\n"), (9, "é" * 39 + " "), (10, LINE + "\r")]


def table(spark, rows=ROWS, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in more.pop("names", ()):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def test_lines(spark):
    names = ["row", "id", "lost", "h1", "shard", "kept", "n_dropped"]
    out = lines.dedup_lines(table(spark, names=names))
    assert out.columns == ["doc_id", "text", "row", "id", "lost", "h1", "shard", "kept", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str)
    want = [(None, "", 1, 1), (1, "", 1, 1), (2, "", 1, 1), (3, "", 2, 2), (4, "", 1, 0), (5, "", 1, 0), (6, "", 1, 1), (6, "", 1, 1), (7, LONG, 1, 0), (8, "\n\n", 3, 0), (9, "é" * 39 + " ", 1, 0), (10, LINE + "\r", 1, 0)]
    assert got == sorted(((*w, "own kept") for w in want), key=str)
    four = lines.dedup_lines(table(spark, [(i, LINE) for i in range(4)]))
    assert {r.n_dropped for r in four.collect()} == {0}
    assert lines.dedup_lines(table(spark).limit(0)).count() == 0


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "Two THREE"), (None, "é ü"), (3, None), (4, ""), (5, " ".join(f"t{i}" for i in range(12)))], "item_id long, text string")
    rows = [(1, "one two three four"), (2, None), (3, ""), (4, "é, ü"), (4, "é, ü"), (None, "zero"), (5, "x " * 30_000 + " ".join(f"t{i}" for i in range(1, 12)) + " y"), (6, " ".join(f"t{i}" for i in range(9)))]
    out = decontam.decontaminate(table(spark, rows, names=["row", "kept", "items", "n_hit"]), bench)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and out.columns[:4] == ["doc_id", "text", "row", "kept"] and got[1].kept == "own kept"
    assert (got[1].n_words, got[1].n_hit, got[1]["items"], got[1].text) == (4, 3, ["1", "2"], " four")
    assert (got[2].n_words, got[2].text, got[2].dropped) == (0, None, False) and (got[3].n_words, got[3].text) == (0, "")
    assert (got[4].n_hit, got[4]["items"], got[4].dropped) == (2, [""], True)
    assert (got[5].n_hit, got[5]["items"]) == (11, ["5"]) and got[6].n_hit == 0 and got[None].n_hit == 0
    none = decontam.decontaminate(table(spark, rows), bench.limit(0))
    assert {r.n_hit for r in none.collect()} == {0} and decontam.decontaminate(table(spark, rows).limit(0), bench).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 9])
def test_decontamination_in_several_passes(spark, blocks):
    items = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(4 + i % 13))) for i in range(30)]
    rows = [(k, " ".join(f"w{(k * 3 + j * (1 + k % 2)) % 44}" for j in range(60)), f"x{k}") for k in range(12)] + [(99, None, "x")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string, runs string")
    one = decontam.decontaminate(docs, bench, 6).orderBy("doc_id").collect()
    assert one == decontam.decontaminate(docs, bench, 6, block_words=40, blocks=blocks).orderBy("doc_id").collect()
    for r, (_, text, _) in zip(one, rows, strict=True):
        ws = (text or "").split()
        hit, found = set(), set()
        for i, item in items:
            w = item.split()
            for p in range(max(len(w) - 6, 0) + 1):
                own = w[p : p + 6]
                for q in range(len(ws) - len(own) + 1):
                    if ws[q : q + len(own)] == own:
                        hit |= set(range(q, q + len(own)))
                        found.add(str(i))
        assert (r.n_words, r.n_hit, r["items"]) == (len(ws), len(hit), sorted(found))


def test_repeats(spark):
    body = "".join(chr(97 + i * i % 23) + str(i) for i in range(200))
    rows = [(1, body), (None, body), (2, None), (3, ""), (4, "x" * 199), (5, "y" * 200), (6, "z" * 201), (7, "own " + body[:230] + " end"), (8, "日本" * 100 + "語" * 40)]
    out = repeats.remove_repeats(table(spark, rows, names=["row", "u", "kept", "spans"]))
    assert out.columns == ["doc_id", "text", "row", "u", "kept", "n_bytes", "n_removed", "n_spans", "spans"]
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in data:
        for j in range(len(b) - 199):
            seen[b[j : j + 200]] = seen.get(b[j : j + 200], 0) + 1
    want = []
    for i, b in data:
        gone = {p for j in range(len(b) - 199) if seen[b[j : j + 200]] > 1 for p in range(j, j + 200)}
        want.append((str(i), len(b), len(gone), sum(p - 1 not in gone for p in gone), bytes(x for p, x in enumerate(b) if p not in gone)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == sorted(want)
    assert repeats.remove_repeats(table(spark, rows).limit(0)).count() == 0


def test_chats(spark):
    said = [
        (1, 2, "user", "second"), (1, 1, "user", "first"), (1, 1, "user", "first"), (1, None, None, None), (2, 0, "assistant", ""), (3, 0, "as\nsistant", "<|im_start|>"), (3, 1, "assistant", "\\<|part|>\\"),
        (None, 0, "assistant", "no id"), (4, 0, "assistant", "long " * 30_000),
    ]
    turns = spark.createDataFrame([(*x, 1, "own") for x in said], "conv_id long, turn long, role string, text string, chunk int, rows string")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(turns)).collect()}
    order = {}
    for c, t, r, x in sorted(said, key=lambda s: (s[1] is not None, s[1] or 0, s[2] or "", s[3] or "")):
        order.setdefault(c, []).append((r or "", x or ""))
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == order
    assert {c: list(r.loss_texts) for c, r in got.items()} == {c: [x for r, x in ts if r == "assistant"] for c, ts in order.items()}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_query_on_a_small_table(spark, tmp_path):
    spark.createDataFrame([(7, 0, "user", "a"), (7, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in op5_chat_format(spark, str(tmp_path)).collect()}
    assert got == {7: (2, 1), -1: (2, len("<|im_end|><|im_start|>assistant ok"))}


@pytest.mark.parametrize("n", [1, 5000])
def test_perfect_hash_probes(n):
    import numpy as np

    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
    shard = lines.Shard(lines.pack_shard(h1, h2, np.arange(n) + 5, np.arange(n) * 3))
    counts, keepers = shard.probe(h1, h2)
    assert counts.tolist() == list(range(5, n + 5)) and keepers.tolist() == [3 * i for i in range(n)]
    other, _ = shard.probe(h1, h2 ^ np.uint64(1))
    assert not other.any() and not shard.probe(rng.integers(0, 1 << 63, 1000, np.uint64), rng.integers(0, 1 << 63, 1000, np.uint64))[0].any()


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux")
def test_unused_memory_is_given_back():
    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    left = [pa.array(["x" * 1000] * 200) for _ in range(500)][::25]
    before = held()
    assert [b.num_rows for b in rows_per_batch(iter([pa.RecordBatch.from_arrays([pa.array([1, 2])], ["n"])]))] == [2]
    assert held() < before - 50 and len(left) == 20  # of about 100 MB
