"""Order MinHash against plain Python."""

import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from quillspark.llm import fingerprint

TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^ \t\n\x0b\f\r぀-ヿ㐀-鿿]{1,16}")


def chained(*parts):
    """Spark's xxhash64 of columns: each hash is the next one's seed."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p
        h = xxhash.xxh64(data, seed=h).intdigest()
    return h


def long(x):
    return struct.pack("<Q", x & (1 << 64) - 1)


def plain(text, groups=32, picks=2, k=2):
    h = [chained(t) for t in TOKEN.findall(text or "")]
    if not h:
        return ""
    at = range(max(len(h) - k, 0) + 1)
    kinds = [chained(*[long(h[i + j]) for j in range(k) if i + j < len(h)]) & (1 << 33) - 1 for i in at]
    seen, numbered = {}, []
    for i, x in enumerate(kinds):
        seen[x] = n = seen.get(x, 0) + 1
        numbered.append((x if n == 1 else chained(long(x), struct.pack("<i", n - 1)) & (1 << 33) - 1, i))
    out = []
    for g in range(groups):
        own = sorted(e for e in numbered if e[0] >> 28 == g)[:picks]
        if own:
            tuple_hash = chained(*[long(x) for x, _ in sorted(own, key=lambda e: e[1])])
            out.append(f"{g:02X}{tuple_hash & 0xFFFFFFFF:08X}")
    return ",".join(out)


def texts_of():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(12)]
    out += ["", " \n ", "one", "two words", "x" * 60, "日本語のテキストです。" * 9, "mixed 漢字 and kana かな " * 5, "same same same same", "é ü " * 30, "\t tabs\tand \r\n ends "]
    return out


def test_fingerprint_is_the_definition(spark):
    rows = spark.createDataFrame(list(enumerate([*texts_of(), None])), "i int, t string")
    got = rows.select("i", fingerprint.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [plain(t) for t in [*texts_of(), None]]


def test_likeness(spark):
    a, b = plain(texts_of()[0]), plain(texts_of()[1])
    parts = lambda x: {e[:2]: e for e in x.split(",") if e}
    cases = [(a, a), (a, b), (a, ""), ("", ""), ("0011111111", "0011111111,01AAAAAAAA")]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, c struct<_1:string,_2:string>").orderBy("i").select(fingerprint.likeness(F.col("c._1"), F.col("c._2")).alias("x")).collect()
    for (x, y), r in zip(cases, got, strict=True):
        p, q = parts(x), parts(y)
        want = sum(p.get(g) == q.get(g) for g in p.keys() | q.keys()) / len(p.keys() | q.keys()) if p or q else 1.0
        assert abs(r.x - want) < 1e-12


def test_edits(spark):
    texts = [*texts_of(), None, "tail " * 3000]
    rows = [(i * 3, t, 1, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, following string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i * 3]
        assert (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint) == (len(t), edited, plain(t), plain(edited))
    assert fingerprint.fingerprint_edits(docs.limit(0)).count() == 0
    small = fingerprint.with_next(docs.select("doc_id", F.col("text").alias("t")), "doc_id", F.col("t"), "t", per_bucket=3).collect()
    assert {r.doc_id: r.next for r in small} == {i * 3: texts[i - 1] for i in range(len(texts))}


def test_order_counts():
    # A set of words in another order has other tuples: the signature follows order, unlike a plain set's.
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    other = words[150:] + words[:150]
    mixed = rng.sample(words, len(words))
    share = lambda x, y: len(set(plain(" ".join(x)).split(",")) & set(plain(" ".join(y)).split(","))) / 32
    assert share(words, words) == 1 and share(words, words[:290]) > 0.7 and share(words, other) > 0.3 and share(words, mixed) < 0.1
