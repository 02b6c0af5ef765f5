"""Token ids against the plain tokenizer, packing against its own definition."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import packing
from quillspark.llm.queries import tokenizer_path

PARTS = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "\r\n", "a", "Bc,", "'s", "12", "!", "..", "é", "日本", "<|endoftext|>", "\0", "\1", "x<|end", "oftext|>", ". ", ","]


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def texts_of(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encoder_is_the_plain_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path(), limit=50)
    for text in [*texts_of(4000), "one two, three. " * 300, "x <|endoftext|> y"]:
        assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_tokenize(spark):
    texts = [None, "", "word " * 3000, "<|endoftext|>", *texts_of(20, 2)]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = defaultdict(list)
    for r in packing.tokenize(docs, tokenizer_path(), with_ids=True).collect():
        got[r.doc_id].append(r)
    for i, text, _ in rows:
        ids, own = [*plain(text), 2], sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [t for r in own for t in r.ids] == ids
        assert all(r.length == packing.CAPACITY for r in own[1:]) and (len(own) == 1 or len(ids) > packing.CAPACITY)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert packing.tokenize(docs.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("group_rows", [20_000, 40])
def test_pack(spark, group_rows):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(50)]), k, 0, rng.choice([1, 7, 1024, rng.randint(1, 1024)]), 9) for k in range(400)]
    rows += rows[:30]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    for c in ("part", "bin", "row_id", "gap", "loose", "offset", "sequence_id", "c0"):
        pieces = pieces.withColumn(c, F.lit(f"own {c}"))
    out = packing.pack(pieces, group_rows=group_rows)
    assert sorted(out.columns) == sorted(pieces.columns)
    got = out.collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in got) == sorted((str(r[0]), r[1], r[3]) for r in rows)
    assert all(r[c] == f"own {c}" for r in got for c in ("part", "bin", "row_id", "gap", "loose", "c0"))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    least = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=1025))
    assert least <= len(bins) <= least + (1 if group_rows > 400 else 0.1 * least)
    assert packing.pack(pieces.limit(0)).count() == 0


def test_bounds_hold_for_every_packing():
    # Against the true least number of bins of small instances.
    def fits(lengths, bins, capacity):
        if not lengths:
            return True
        seen = set()
        for i, room in enumerate(bins):
            if room >= lengths[0] and room not in seen:
                seen.add(room)
                if fits(lengths[1:], [*bins[:i], room - lengths[0], *bins[i + 1 :]], capacity):
                    return True
        return False

    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        n = next(n for n in range(1, 10) if fits(lengths, [12] * n, 12))
        assert packing.lower_bound(np.bincount(lengths, minlength=13), 12) <= n <= packing.best_fit(np.array(lengths), 12).max() + 1


def test_texts_of_a_batch_share_calls_and_keep_their_ids():
    rnd = random.Random(3)
    parts = ["foo", "bar.", "Ünï,", "  ", "\n", "\t", "潮位", "<|endoftext|>", "\x1c", "\xa0", "'s", "3.", "a,", "\r\n", "😀", "<|end", "x\ty"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 9))) for _ in range(3000)] + [None]
    for limit in (50, 500_000):
        enc = packing.Encoder(tokenizer_path(), limit)
        usual = [t for t in texts if t and not enc.unsafe.search(t)]
        calls = []
        whole, cut = enc._whole, enc._cut
        enc._whole, enc._cut = lambda t: calls.append(1) or whole(t), lambda t: calls.append(1) or cut(t)
        enc.batch(usual)
        assert len(calls) <= 2
        for at in range(0, len(texts), 37):
            for text, ids in zip(texts[at : at + 37], enc.batch(texts[at : at + 37]), strict=True):
                assert ids.tolist() == (enc.tok.encode(text, add_special_tokens=False).ids if text else [])
