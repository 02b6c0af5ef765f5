"""Kneser-Ney by hand and by aggregation, accuracy on the held-out fold, and rejection."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid

ORDER = 3


def grams(texts, order=ORDER):
    out = Counter()
    for t in texts:
        for w in langid.WORD.findall(t.lower()):
            w = f"\n{w}\n"
            for i in range(1, len(w)):
                out[w[max(0, i - order + 1) : i + 1]] += 1
    return out


def by_hand(counts, order=ORDER):
    """p(symbol, symbols before it) from the definition."""
    levels = [Counter() for _ in range(order)]
    for g, c in counts.items():
        levels[len(g) - 1][g] += c
    for k in range(order - 2, -1, -1):
        before = defaultdict(set)
        for g in levels[k + 1]:
            before[g[1:]].add(g[0])
        for g, seen in before.items():
            levels[k][g] += len(seen)
    alphabet = {g[-1] for g in levels[0]}

    def p(s, h):
        k = len(h)
        lower = p(s, h[1:]) if k else 1 / (len(alphabet) + 1)
        own = {g: c for g, c in levels[k].items() if g[:-1] == h}
        if not own:
            return lower
        n1, n2 = (sum(c == i for c in levels[k].values()) for i in (1, 2))
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))
        total = sum(own.values())
        return max(own.get(h + s, 0) - d, 0) / total + d * len(own) / total * lower

    return p, alphabet


TEXTS = ["the net the nets then ten tents", "a boat at the bay, boats bob at bay", "ñandú é été"]


def log_probability(model, word, order=ORDER):
    sym, of = langid._symbols([word])
    return model.score([langid._grams(sym, of, k + 1) for k in range(order)])


@pytest.mark.parametrize("word", ["the", "net", "zebra", "boats", "été", "ñ", "日本"])
def test_model_is_the_definition(word):
    p, _ = by_hand(grams(TEXTS))
    got = log_probability(langid.fit(dict(grams(TEXTS)), ORDER), word)
    marked = f"\n{word}\n"
    want = [math.log(p(marked[i], marked[max(0, i - ORDER + 1) : i])) for i in range(1, len(marked))]
    assert np.allclose(got[1:], want, atol=1e-5)


def test_probabilities_sum_to_one():
    p, alphabet = by_hand(grams(TEXTS))
    for h in ("", "t", "th", "zz", "\nb"):
        assert abs(sum(p(s, h) for s in alphabet) + p("☃", h) - 1) < 1e-9


def corpus(spark, n=300):
    rng = random.Random(5)
    parts = {"xx": ["ka", "ro", "mi", "tek", "sol", "un"], "yy": ["eau", "lé", "ñi", "gar", "sch", "ve"]}
    rows = []
    for i in range(n):
        lang = ("xx", "yy")[i % 2]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 80))]
        rows.append((i, " ".join(words), "yy" if i == 14 else lang))  # one row has a wrong label
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_aggregation_is_fit(spark):
    rows = [("xx", g, c) for g, c in grams(TEXTS).items()] + [("yy", g, c) for g, c in grams(TEXTS[:1]).items()]
    names, models = langid._fitted(spark.createDataFrame(rows, "lang string, gram string, n long"), ORDER, 100_000)
    assert names == ["xx", "yy"]
    for model, texts in zip(models, (TEXTS, TEXTS[:1]), strict=True):
        want = langid.fit(dict(grams(texts)), ORDER)
        for a, b in zip((*model.grams, *model.contexts, *model.logp, *model.backoff), (*want.grams, *want.contexts, *want.logp, *want.backoff), strict=True):
            assert np.allclose(a, b, atol=1e-6)
        assert abs(model.unseen - want.unseen) < 1e-9
    # A bounded model keeps the discounts of the whole table and stays near it.
    _, (small, _) = langid._fitted(spark.createDataFrame(rows, "lang string, gram string, n long"), ORDER, 25)
    assert sum(map(len, small.grams)) == 25
    assert np.abs(log_probability(small, "the") - log_probability(langid.fit(dict(grams(TEXTS)), ORDER), "the")).max() < 2


def test_held_out_accuracy_and_rejection(spark):
    docs = corpus(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    odd = spark.createDataFrame([(-1, "это русский текст о море и о кораблях", None), (-2, None, None), (-3, "123 !", "xx"), (-4, "", None), (-5, "ka" * 50_000, None), (None, "rosol kami", None)], docs.schema)
    clash = docs.unionByName(odd).withColumn("score", F.lit("own")).withColumn("rejected", F.lit(7)).withColumn("row", F.lit(1))
    out = langid.identify(clash, model)
    assert out.columns == ["doc_id", "text", "lang", "row", "lang_pred", "score", "rejected"]
    got = {r.doc_id: r for r in out.collect()}
    held = [r for i, r in got.items() if i is not None and i >= 0 and i != 14 and r.lang is not None]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and not any(r.rejected for r in held)
    assert got[-1].rejected and all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (-2, -3, -4))
    assert got[-5].lang_pred == "xx" and got[None].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
