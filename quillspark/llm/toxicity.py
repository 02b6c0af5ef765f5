"""Toxicity: cumulative-link ordinal regression on sparse word features, one weight vector for all ordered thresholds."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import others, rows_per_batch, words

#: Features are 32-bit word hashes; training reads about SAMPLE_ROWS labelled rows at most.
SAMPLE_ROWS, GRADES = 8000, 3
COPY = 0.8  # word-set Jaccard similarity from which a labelled row is a copy


def _features(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    out = set()
    for w in set(words(text)):
        if w not in memo:
            if len(memo) > 500_000:
                memo.clear()
            memo[w] = zlib.crc32(w)
        out.add(memo[w])
    return np.fromiter(sorted(out), np.uint32, len(out))


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - thresholds[k]); x marks the features (sorted word hashes) that a text has.

    cut: the P(grade > 0) from which a text is called toxic, chosen for the best F1 on the training rows.
    """

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not len(self.features):
            return np.zeros(len(rows))
        flat = np.concatenate([*rows, np.zeros(0, np.uint32)])
        at = np.minimum(np.searchsorted(self.features, flat), len(self.features) - 1)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return np.bincount(owner, np.where(self.features[at] == flat, self.weights[at], 0.0), len(rows))

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 1e-4, steps: int = 400, evidence: float = 20.0) -> OrdinalModel:
    """Proximal gradient descent on the ordinal likelihood, over the words that speak for or against a grade above 0.

    A word is a feature if its likelihood ratio against "any grade" exceeds `evidence` (chance words of a large
    vocabulary stay below); the l1 penalty leaves features that add nothing at zero.
    """
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.uint32)])
    used, col = np.unique(flat, return_inverse=True)
    df = np.bincount(col, minlength=len(used))
    pos = np.bincount(col, (grades > 0)[owner], len(used))
    rate = (grades > 0).mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, e: np.where(k > 0, k * np.log(k / e), 0.0)
        ratio = 2 * (part(pos, df * rate) + part(df - pos, df * (1 - rate)))
    ok = (ratio > evidence)[col]
    owner, col = owner[ok], col[ok]
    scale = 1 / np.sqrt(np.maximum(df, 1) / n + 1e-2)  # rare words move as fast as frequent ones
    w = np.zeros(len(used))
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    th = np.log((1 - share) / share)
    y, step, momentum, last = grades, 2.0, 0.9, np.zeros(len(used))
    one = np.arange(n)
    for _ in range(steps):
        s = np.bincount(owner, (w * scale)[col], n)
        ext = np.concatenate([np.full((n, 1), 1.0), 1 / (1 + np.exp(-np.clip(s[:, None] - th[None, :], -40, 40))), np.zeros((n, 1))], 1)
        upper, lower = ext[one, y], ext[one, y + 1]  # P(grade >= y), P(grade > y)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        g = (dl - du) / p / n
        grad = np.bincount(col, g[owner], len(used)) * scale
        gth = np.zeros(n_grades - 1)
        np.add.at(gth, (y - 1)[y > 0], (du / p / n)[y > 0])
        np.add.at(gth, y[y < n_grades - 1], -(dl / p / n)[y < n_grades - 1])
        last = momentum * last - step * 0.1 * grad
        w = w + last
        w = np.sign(w) * np.maximum(np.abs(w) - step * 0.1 * l1, 0)
        th = np.sort(th - 0.5 * gth)
    kept = w != 0
    model = OrdinalModel(used[kept], (w * scale)[kept], th)
    p = model.above(model.score(rows))[:, 0]
    order = np.argsort(-p, kind="stable")
    tp = np.cumsum((grades > 0)[order])
    last = np.flatnonzero(np.append(np.diff(p[order]) < 0, True))  # equal scores fall on one side
    f1 = 2 * tp[last] / (last + 1 + (grades > 0).sum())
    b = int(np.argmax(f1))
    low = p[order][last[b + 1]] if b + 1 < len(last) else 0.0
    model.cut = float((p[order][last[b]] + low) / 2)
    return model


def grade(rows: list[np.ndarray], toxic: np.ndarray, n_grades: int) -> np.ndarray:
    """Ordered grades from 0/1 labels: 0 is not toxic; toxic rows are ranked by how many marked words they hold.

    A word is marked if its smoothed log-odds for toxic rows exceed 3; equal shares of the toxic rows' ranks get the
    grades 1 to n_grades - 1 (equal counts get equal grades).
    """
    used, col = np.unique(np.concatenate([*rows, np.zeros(0, np.uint32)]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pos = np.bincount(col, toxic[owner], len(used))
    neg = np.bincount(col, minlength=len(used)) - pos
    n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    marked = np.log((pos + 0.1) / (n1 + 0.2)) - np.log((neg + 0.1) / (n0 + 0.2)) > 3
    marked &= pos >= 5
    count = np.bincount(owner, marked[col], len(rows))
    out = np.zeros(len(rows), np.int64)
    if toxic.any():
        cuts = np.quantile(count[toxic == 1], [i / (n_grades - 1) for i in range(1, n_grades - 1)])
        out[toxic == 1] = 1 + (count[toxic == 1][:, None] > cuts[None, :]).sum(1)
    return out


def distinct_rows(rows: list[np.ndarray], similarity: float = COPY) -> list[int]:
    """Rows with words, without those whose words have a Jaccard similarity of `similarity` or more with an earlier kept row's.

    One copied text would otherwise lend its words the evidence of many. Exact: words are put in order of rarity, and two
    rows that similar share one of their first n - ceil(similarity * n) + 1 (of n words), by which kept rows are found.
    """
    used, df = np.unique(np.concatenate([*rows, np.zeros(0, np.uint32)]), return_counts=True)
    places: dict[int, list[int]] = {}  # kept rows by each of their rarest words
    out = []
    for i, r in enumerate(rows):
        n = len(r)
        if not n:
            continue
        rare = r[np.argsort(df[np.searchsorted(used, r)], kind="stable")][: n - math.ceil(similarity * n - 1e-9) + 1].tolist()
        met = {j for w in rare for j in places.get(w, ()) if min(n, len(rows[j])) >= similarity * max(n, len(rows[j])) - 1e-9}
        for j in met:
            both = len(np.intersect1d(r, rows[j], assume_unique=True))
            if both >= similarity * (n + len(rows[j]) - both) - 1e-9:
                break
        else:
            out.append(i)
            for w in rare:
                places.setdefault(w, []).append(i)
    return out


def train(docs: DataFrame, labels: DataFrame, n_grades: int = GRADES, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on about sample_rows rows at most (by a hash of doc_id) that have a toxic label; null labels teach nothing.

    Word features of whole texts are made on the executors; only the sample's feature numbers reach the driver. Rows of
    one doc_id in labels: toxic if any says so; repeated documents and other copies teach once. Null doc_ids teach
    nothing. Without rows, or with rows of one label only, the model knows no feature and rates all texts alike.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit("toxic sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.select("doc_id", "text").join(known.where(u < min(1.0, sample_rows / max(n, 1))), "doc_id").select("doc_id", "text", "toxic")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in rows_per_batch(batches):
            found = [_features(t, memo).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "x"])

    got = sorted(((r["doc_id"], r["toxic"], bytes(r["x"])) for r in sample.mapInArrow(featured, "doc_id long, toxic int, x binary").toLocalIterator()))
    rows = [np.frombuffer(x, np.uint32) for _, _, x in got]
    toxic = np.array([t for _, t, _ in got], np.int64)
    own = distinct_rows(rows)
    rows, toxic = [rows[i] for i in own], toxic[own]
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(0, np.uint32), np.zeros(0), np.full(n_grades - 1, -40.0 if len(toxic) and toxic.all() else 40.0))
    return fit(rows, grade(rows, toxic, n_grades), n_grades)


def rate(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with p_toxic (P(grade > 0)), expected_severity (0 to n_grades - 1), severity (likeliest grade) and toxic (p_toxic at the model's cut or above).

    Null and wordless texts get the model's base rate, for which no feature speaks. Of equally likely grades the lower
    one is taken; equal texts get equal rates. Whole texts are read; other columns stay, the four added ones replace any
    of their names; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("p_toxic", "expected_severity", "severity", "toxic")
    rows = docs.select(others(docs, *added).alias("row"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        for batch in rows_per_batch(batches):
            s = m.score([_features(t, memo) for t in batch.column(1).to_pylist()])
            p = m.above(s)
            ext = np.concatenate([np.ones((len(s), 1)), p, np.zeros((len(s), 1))], 1)
            cols = [pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array((ext[:, :-1] - ext[:, 1:]).argmax(1).astype(np.int32)), pa.array(p[:, 0] >= m.cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["row", "text", *added])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, p_toxic double, expected_severity double, severity int, toxic boolean")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)
