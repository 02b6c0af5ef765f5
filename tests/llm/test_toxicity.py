"""The ordinal model: its likelihood by plain Python, ordered thresholds, and held-out rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import toxicity


def sample(n=600, seed=3):
    """Rows of features: 0 to 199 are common; 1000 to 1009 speak for grade 1, 2000 to 2009 for grade 2."""
    rng = random.Random(seed)
    rows, grades = [], []
    for _ in range(n):
        g = rng.choice([0, 0, 0, 1, 2])
        own = set(rng.sample(range(200), 20))
        own |= {1000 * k + rng.randrange(10) for k in range(1, g + 1) for _ in range(3)}
        if rng.random() < 0.1:
            own.add(1000 + rng.randrange(10))
        rows.append(np.array(sorted(own), np.uint32))
        grades.append(g)
    return rows, np.array(grades)


def loss(model, rows, grades, weights=None, thresholds=None):
    """Mean negative log likelihood of the cumulative-link model, row by row."""
    w = dict(zip(model.features.tolist(), model.weights if weights is None else weights, strict=True))
    th = model.thresholds if thresholds is None else thresholds
    total = 0.0
    for r, g in zip(rows, grades.tolist(), strict=True):
        s = sum(w.get(f, 0.0) for f in r.tolist())
        above = [1.0, *(1 / (1 + math.exp(-(s - t))) for t in th), 0.0]
        total -= math.log(max(above[g] - above[g + 1], 1e-12))
    return total / len(rows)


def test_fit_is_near_the_least_loss():
    rows, grades = sample()
    model = toxicity.fit(rows, grades, 3)
    assert np.all(np.diff(model.thresholds) >= 0) and len(model.features) > 10
    best = loss(model, rows, grades)
    assert best < 0.6 * loss(model, rows, grades, weights=np.zeros(len(model.weights)), thresholds=[math.log(0.6 / 0.4), math.log(0.8 / 0.2)])
    for k in (0, 1):
        for step in (-0.1, 0.1):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(model, rows, grades, thresholds=moved) > best - 2e-3
    for j in range(0, len(model.weights), 7):
        for step in (-0.2, 0.2):
            moved = model.weights.copy()
            moved[j] += step
            assert loss(model, rows, grades, weights=moved) > best - 2e-3  # up to the l1 penalty


def test_scores_and_severity_of_held_out_rows():
    rows, grades = sample()
    model = toxicity.fit(rows, grades, 3)
    fresh, want = sample(400, 9)
    above = model.above(model.score(fresh))
    assert np.all(above[:, 0] >= above[:, 1]) and np.all((above > 0) & (above < 1))
    hand = [sum(dict(zip(model.features.tolist(), model.weights, strict=True)).get(f, 0.0) for f in r.tolist()) for r in fresh[:20]]
    assert np.allclose(model.score(fresh)[:20], hand)
    toxic = above[:, 0] >= model.cut
    tp = (toxic & (want > 0)).sum()
    assert 2 * tp / (toxic.sum() + (want > 0).sum()) > 0.9
    severity = above.sum(1)
    assert severity[want == 2].mean() > severity[want == 1].mean() > severity[want == 0].mean()


def test_cut_is_the_best_f1():
    rows, grades = sample(300, 5)
    model = toxicity.fit(rows, grades, 3)
    p = model.above(model.score(rows))[:, 0]
    f1 = lambda cut: 2 * ((p >= cut) & (grades > 0)).sum() / ((p >= cut).sum() + (grades > 0).sum())
    assert f1(model.cut) >= max(f1(c) for c in p) - 1e-12


def test_train_and_rate(spark):
    rng = random.Random(2)
    common, bad = [f"w{i}" for i in range(300)], [f"vile{i}" for i in range(6)]
    texts, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        words = rng.choices(common, k=rng.randint(20, 60)) + (rng.choices(bad, k=rng.randint(1, 6)) if toxic else [])
        rng.shuffle(words)
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 7 else None))
    odd = [(600, None), (601, ""), (602, "..."), (None, "vile1 vile2 vile3"), (603, "VILE1, vile2! " * 4000), (1, texts[1][1])]
    docs = spark.createDataFrame([(i, t, 1, "own") for i, t in texts + odd], "doc_id long, text string, p_toxic int, row string")
    marks = spark.createDataFrame([*labels, (None, 1), (9999, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    out = toxicity.rate(docs, model)
    assert out.columns == ["doc_id", "text", "row", "p_toxic", "expected_severity", "severity", "toxic"]
    got = {r.doc_id: r for r in out.collect()}
    unseen = [i for i in range(500) if i % 7 == 0]
    assert np.mean([got[i].toxic == (i % 5 == 0) for i in unseen]) > 0.97
    assert got[600].p_toxic == got[601].p_toxic == got[602].p_toxic < model.cut and got[603].toxic and got[None].toxic
    assert all(0 <= r.expected_severity <= 2 and r.severity in (0, 1, 2) for r in got.values()) and out.count() == len(texts) + len(odd)
    assert toxicity.rate(docs.limit(0), model).count() == 0
    one = toxicity.train(docs, marks.withColumn("toxic", F.lit(0)))
    assert not any(r.toxic for r in toxicity.rate(docs, one).collect())
