"""Near-duplicates against all pairs with exact document frequencies."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import neardup


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "own", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, class_id string, class_size int")


def weights(texts):
    """Of each text: shingles with tf times 1 + ln(1 / share), share = (1 + df) / (1 + n), 0.02 at least."""
    grams = []
    for t in texts:
        ws = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (t or "").lower()).split()
        k = min(5, len(ws))
        grams.append(Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else Counter())
    df = Counter(g for c in grams for g in c)
    return [{g: tf * (1 + np.log(1 / max(0.02, (1 + df[g]) / (1 + len(texts))))) for g, tf in c.items()} for c in grams]


def likeness(a, b):
    least = sum(min(w, b[g]) for g, w in a.items() if g in b)
    total = sum(a.values()) + sum(b.values()) - least
    return least / total if total else 0.0


def brute(texts, similarity=neardup.SIMILARITY):
    """The least index of each text's group, and the linked pairs."""
    w = weights(texts)
    links = [(j, i) for i in range(len(w)) for j in range(i) if w[i] and w[j] and likeness(w[i], w[j]) >= similarity - 1e-9]
    group = list(range(len(texts)))
    for j, i in links:
        lo, hi = sorted((group[i], group[j]))
        group = [lo if g == hi else g for g in group]
    return dict(enumerate(group)), links


def classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def edited(words, rng, share):
    return [f"e{rng.randint(0, 9999)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("n", [30, 140])
def test_against_all_pairs(spark, n):
    rng = random.Random(n)
    base = [[f"w{rng.randint(0, 800)}" for _ in range(rng.randint(40, 200))] for _ in range(n // 7)]
    texts = [" ".join(b) for b in base]
    while len(texts) < n:
        texts.append(" ".join(edited(rng.choice(base), rng, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))))
    want, links = brute(texts)
    got = classes(neardup.near_duplicates(docs_of(spark, texts)))
    assert len(links) > n
    assert sum(got[j] == got[i] for j, i in links) == len(links)
    assert got == want


def test_recall_of_single_links(spark):
    # Pairs that nothing else connects, from just above the threshold: what the bands miss is missed for good.
    rng = random.Random(11)
    texts = []
    for k in range(150):
        words = [f"p{k}w{i}" for i in range(rng.randint(60, 160))]
        texts += [" ".join(words), " ".join(edited(words, rng, 0.015))]
    _, links = brute(texts)
    got = classes(neardup.near_duplicates(docs_of(spark, texts)))
    found = sum(got[j] == got[i] for j, i in links)
    assert len(links) > 90 and found / len(links) >= 0.97
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(150)) == found  # and none below the threshold


@pytest.mark.parametrize("block", [256, 4])
def test_drifting_chains(spark, monkeypatch, block):
    # Each version is near the one before it and not the one before that.
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(3)
    texts = []
    for chain in range(2):
        text = [f"c{chain}w{i}" for i in range(400)]
        for version in range(25):
            texts.append(" ".join(text))
            for at in rng.sample(range(0, 400, 10), 3):
                text[at] = f"c{chain}v{version}at{at}"
    want, links = brute(texts)
    assert len(set(want.values())) == 2 and len(links) < 150
    assert classes(neardup.near_duplicates(docs_of(spark, texts))) == want


def test_edges(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(None, a), (5, a.upper()), (5, a), (7, b), (7, a + " z"), (8, None), (None, None), (9, " ."), (10, "two words"), (11, "Two, words!"), (12, "日本語の テキスト"), (3, "x " * 30_000), (4, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, band int")
    got = sorted([tuple(r) for r in neardup.near_duplicates(docs).collect()], key=str)
    want = [(None, 5, 4), (5, 5, 4), (5, 5, 4), (7, 7, 1), (7, 5, 4), (8, 8, 1), (None, None, 1), (9, 9, 1), (10, 10, 2), (11, 10, 2), (12, 12, 1), (3, 3, 2), (4, 3, 2)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(2)
    sampler = neardup.Sampler(4.0, n=1500)
    h = np.sort(rng.integers(0, 1 << 63, 300, np.uint64))
    a, b = rng.choice([1.0, 2.0, 4.0, 8.0], 300), rng.choice([1.0, 2.0, 4.0, 8.0], 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = np.concatenate([(neardup.Sampler(4.0, n=36, seed=s).samples(h, a) == neardup.Sampler(4.0, n=36, seed=s).samples(h, b)) for s in range(40)]).mean()
    assert abs(same - want) < 0.05 and sampler.samples(h, a).shape == (1500,)


def test_sketch_follows_document_frequencies(spark):
    texts = [" ".join(f"w{j}" for j in range(i % 4, 60)) for i in range(90)]
    scan = neardup._scan(docs_of(spark, texts).select("doc_id", "text")).cache()
    freq = neardup._frequencies(scan, scan.where(F.col("chunk").isNull()).count())
    want = {g: w / tf for c in zip(weights(texts), strict=True) for g, w in c[0].items() for tf in [1]}
    grams = neardup.shingles(texts[0], {})
    own = [tuple(f"w{j + k}" for k in range(5)) for j in range(56)]
    assert np.allclose(freq.idf(grams), [want[g] for g in own], atol=1e-5)
