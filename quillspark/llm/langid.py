"""Language identification: interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import mix, others, rows_per_batch, settle

WORD = re.compile(r"[^\W\d_]+")
ORDER = 4
#: The labelled sample: documents a language at most (expected), and grams of a language's model at most.
SAMPLE_DOCS, MODEL_GRAMS = 3000, 400_000
FAR = 0.8  # see KneserNey.rejects
_EDGE = 0x110000  # stands before and after each word


def _word_counts(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words of all texts; for each occurrence its text's number and its word's number."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    codes, names = pd.factorize(np.array([w for x in found for w in x], object)) if len(owner) else (np.zeros(0, np.int64), [])
    return list(names), owner, codes


def _symbols(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points, each word followed by the edge sign and led by one, and the word of each symbol."""
    lengths = np.array([len(w) for w in names], np.int64)
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(names)), lengths + 2)
    out = np.full(int((lengths + 2).sum()), _EDGE, np.uint64)
    ends = np.cumsum(lengths + 2)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - lengths - 2] = False
    out[inner] = flat
    return out, word


def _grams(sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within words by their last symbol's place, and which places have one."""
    h = np.full(len(sym), n, np.uint64)
    ok = np.zeros(len(sym), bool)
    if len(sym) >= n:
        ok[n - 1 :] = word[n - 1 :] == word[: len(word) - n + 1]
        with np.errstate(over="ignore"):
            for i in range(n):
                h[n - 1 :] = h[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + sym[i : len(sym) - n + 1 + i] + np.uint64(1)
    return mix(h), ok


@dataclass
class KneserNey:
    """Per order: sorted gram hashes with log probabilities, sorted context hashes with log back-off weights."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: float
    mean: float = 0.0
    spread: tuple[float, float] = (1.0, 1.0)
    limit: float = 1e9
    uniform: float = 0.0  # entropy of symbols drawn evenly

    def score(self, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log probability of each symbol after those before it in its word (0 for the leading edge)."""
        n = len(hashes[0][0])
        out = np.zeros(n)
        left = np.flatnonzero(hashes[1][1]) if len(hashes) > 1 else np.arange(n)
        for k in range(len(hashes) - 1, -1, -1):
            h, ok = hashes[k]
            own = left[ok[left]]
            at, hit = _find(self.grams[k], h[own])
            out[own[hit]] += self.logp[k][at[hit]]
            miss = own[~hit]
            if k:
                ctx = hashes[k - 1][0][miss - 1]
                at, seen = _find(self.contexts[k], ctx)
                out[miss[seen]] += self.backoff[k][at[seen]]
            else:
                out[miss] += self.unseen
            left = np.concatenate([left[~ok[left]], miss])
        return out

    def calibrate(self, entropies: np.ndarray, chars: np.ndarray) -> None:
        """Centre and spread of the language's own texts, and the limit of rejection, by medians and quantiles.

        A few rows with a wrong label move none of them. The variance of a text of n symbols is spread[0] + spread[1] / n;
        the limit is 8 such deviations, or twice what 95 of 100 own texts stay below.
        """
        long = chars >= np.median(chars)
        self.mean = float(np.median(entropies[long]))
        within = max((1.4826 * float(np.median(np.abs(entropies[long] - self.mean)))) ** 2, 1e-4)
        short = float(np.median(np.maximum((entropies - self.mean) ** 2 / 0.4549 - within, 0) * chars))
        self.spread = (within, max(short, 1.0))
        z = np.array([self.excess(e, n) for e, n in zip(entropies, chars, strict=True)])
        self.limit = max(8.0, 2.0 * float(np.quantile(z, 0.95)))

    def rejects(self, entropy: float, chars: float) -> bool:
        """Beyond the limit, and FAR of the way from the language's own texts to evenly drawn symbols: no odd text of its own."""
        return self.excess(entropy, chars) > self.limit and entropy - self.mean > FAR * max(self.uniform - self.mean, 0.0)

    def excess(self, entropy: float, chars: int) -> float:
        return (entropy - self.mean) / np.sqrt(self.spread[0] + self.spread[1] / max(chars, 1))


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def discount(n1: float, n2: float) -> float:
    """What each count of an order gives up: n1 / (n1 + 2 n2), from how many grams occur once and twice."""
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))


def assemble(grams: list[dict[str, tuple[float, float, float]]], discounts: list[float], n_symbols: int) -> KneserNey:
    """The model's arrays from, by order, each gram's count and its context's sum of counts and number of grams.

    A gram that is left out has the probability that its context's back-off weight and its shorter form give it.
    n_symbols: distinct symbols; the lowest order is mixed with a uniform distribution over them and an unseen one.
    """
    weights = [{g[:-1]: d * kinds / total for g, (_, total, kinds) in level.items()} for d, level in zip(discounts, grams, strict=True)]
    probs: list[dict[str, float]] = []

    def lower(g: str) -> float:
        scale = 1.0
        for k in range(len(g) - 1, -1, -1):
            if g in probs[k]:
                return scale * probs[k][g]
            scale *= weights[k].get(g[:-1], 1.0)
            g = g[1:]
        return scale / (n_symbols + 1)

    for k, level in enumerate(grams):
        d = discounts[k]
        probs.append({g: max(c - d, 0) / total + weights[k][g[:-1]] * (lower(g[1:]) if k else 1 / (n_symbols + 1)) for g, (c, total, _) in level.items()})
    arrays: list[list[np.ndarray]] = [[], [], [], []]
    for p, w in zip(probs, weights, strict=True):
        for own, table in ((arrays[:2], p), (arrays[2:], w)):
            h = _hash_strings(list(table))
            o = np.argsort(h)
            own[0].append(h[o])
            own[1].append(np.log(np.maximum(np.array(list(table.values())), 1e-12))[o].astype(np.float32) if len(h) else np.zeros(0, np.float32))
    return KneserNey(*arrays, unseen=float(np.log(weights[0].get("", 1.0) / (n_symbols + 1))), uniform=float(np.log(n_symbols + 1)))


def fit(counts: dict[str, float], order: int = ORDER) -> KneserNey:
    """Interpolated Kneser-Ney from the counts of a language's grams of `order` symbols (shorter ones begin a word).

    The highest order uses counts, lower ones the number of distinct symbols seen before a gram; grams that begin a
    word have nothing before them and keep their counts.
    """
    levels: list[dict[str, float]] = [{} for _ in range(order)]
    for g, c in counts.items():
        levels[len(g) - 1][g] = levels[len(g) - 1].get(g, 0) + c
    for k in range(order - 1, 0, -1):
        for g in levels[k]:
            levels[k - 1][g[1:]] = levels[k - 1].get(g[1:], 0) + 1
    grams, discounts = [], []
    for level in levels:
        total: dict[str, float] = {}
        kinds: dict[str, int] = {}
        for g, c in level.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        grams.append({g: (c, total[g[:-1]], kinds[g[:-1]]) for g, c in level.items()})
        values = list(level.values())
        discounts.append(discount(values.count(1), values.count(2)))
    return assemble(grams, discounts, len(levels[0]))


def _fitted(counted: DataFrame, order: int, model_grams: int) -> tuple[list[str], list[KneserNey]]:
    """fit() of each language, by aggregations over all of its grams; its model_grams most frequent reach the driver."""
    own = lambda k: counted.where(F.length("gram") == k).select("lang", F.lit(k).alias("k"), "gram", "n")
    level, levels = own(order), own(order)
    for k in range(order - 1, 0, -1):
        ends = level.select("lang", F.lit(k).alias("k"), F.expr("substring(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("n"))
        level = settle(ends.unionByName(own(k)).groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))
        levels = levels.unionByName(level)
    levels = settle(levels.withColumn("h", F.expr("left(gram, k - 1)")))
    contexts = levels.groupBy("lang", "k", "h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    stats = levels.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("grams"), *[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2)]).toPandas()
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "k", "gram")
    top = levels.withColumn("place", F.row_number().over(best)).where(F.col("place") <= model_grams).join(contexts, ["lang", "k", "h"])
    rows = top.select("lang", "k", "gram", "n", "total", "kinds").toPandas()
    names, models = sorted(stats.lang.unique()), []
    for name in names:
        mine = rows[rows.lang == name]
        by_order = {int(r.k): r for r in stats[stats.lang == name].itertuples()}
        grams = []
        for k in range(1, order + 1):
            x = mine[mine.k == k]
            grams.append(dict(zip(x.gram, zip(x.n.astype(float), x.total.astype(float), x.kinds.astype(float), strict=True), strict=True)))
        discounts = [discount(by_order[k].n1, by_order[k].n2) if k in by_order else 0.5 for k in range(1, order + 1)]
        models.append(assemble(grams, discounts, int(by_order[1].grams) if 1 in by_order else 0))
    return names, models


def _hash_strings(keys: list[str]) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    with np.errstate(over="ignore"):
        for i, g in enumerate(keys):
            h = len(g)
            for ch in g:
                h = (h * 0x9E3779B97F4A7C15 + (_EDGE if ch == "\n" else ord(ch)) + 1) & (1 << 64) - 1
            out[i] = h
    return mix(out)


@dataclass
class LanguageModel:
    names: list[str]
    models: list[KneserNey]
    order: int

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol of each text by each model, and the texts' numbers of symbols (letters and word ends)."""
        names, owner, codes = _word_counts(texts)
        n = np.zeros(len(texts))
        out = np.zeros((len(texts), len(self.models)))
        if not names:
            return out, n
        sym, word = _symbols(names)
        hashes = [_grams(sym, word, k + 1) for k in range(self.order)]
        size = np.bincount(word, minlength=len(names)) - 1
        n += np.bincount(owner, size[codes], len(texts))
        for j, m in enumerate(self.models):
            by_word = np.bincount(word, m.score(hashes), len(names))
            out[:, j] = -np.bincount(owner, by_word[codes], len(texts)) / np.maximum(n, 1)
        return out, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text: the lowest cross-entropy wins; `und` without letters or models."""
        if not self.models:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        e, n = self.entropies(texts)
        best = e.argmin(1)
        # The share of the winner among e^(-entropy * sqrt(n)): long texts are surer, but not by their full length.
        z = np.exp(-(e - e.min(1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None])
        score = np.where(n > 0, 1 / z.sum(1), 0.0)
        over = np.array([self.models[b].rejects(e[i, b], n[i]) for i, b in enumerate(best)], bool)
        return [self.names[b] if n[i] else "und" for i, b in enumerate(best)], score, (n == 0) | over


def _sampled(rows: DataFrame, label: str, limit: int) -> DataFrame:
    """About `limit` rows of each label at most, chosen by a hash of doc_id; all rows where there are fewer."""
    sizes = rows.groupBy(label).count().select(F.col(label).alias("of"), (F.lit(float(limit)) / F.col("count")).alias("share"))
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(sizes), F.col(label) == F.col("of")).where(u < F.col("share")).drop("of", "share")


def train(labelled: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, model_grams: int = MODEL_GRAMS) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows: about sample_docs a language at most, one tenth of them held back for calibration.

    Grams of whole texts are counted on the executors, and so are discounts, sums and numbers of continuations, over all
    grams of the sample; each language's model_grams most frequent reach the driver, so a model's size is bounded.
    Calibration sets, for each language, centre and spread of its own held-back texts' cross-entropy and the limit above
    which a text is rejected. Null lang or text: the row teaches nothing. Languages come in order of their names, which
    decides ties; without rows the model knows none.
    """
    rows = _sampled(labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null"), "lang", sample_docs)
    rows = settle(rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(10)) == 0).repartition(8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_per_batch(batches, 2 << 20):
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                names, _, codes = _word_counts([t for t, x in zip(texts, langs, strict=True) if x == lang])
                seen: dict[str, int] = {}
                for w, c in zip(names, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                    w = f"\n{w}\n"
                    for i in range(1, len(w)):
                        g = w[max(0, i - order + 1) : i + 1]
                        seen[g] = seen.get(g, 0) + c
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])

    counted = settle(rows.where("not held").select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    names, models = _fitted(counted, order, model_grams)
    model = LanguageModel(names, models, order)
    if not names:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_per_batch(batches, 2 << 20):
            e, n = shared.value.entropies(batch.column(0).to_pylist())
            langs = batch.column(1).to_pylist()
            ok = [i for i, x in enumerate(langs) if n[i] and x in shared.value.names]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in ok], pa.string()), pa.array([e[i, shared.value.names.index(langs[i])] for i in ok], pa.float64()), pa.array([n[i] for i in ok], pa.float64())], ["lang", "e", "n"]
            )

    held = rows.where("held").select("text", "lang").mapInArrow(calibrate, "lang string, e double, n double").toPandas()
    for name, m in zip(names, models, strict=True):
        own = held[held.lang == name]
        if len(own) >= 5:
            m.calibrate(own.e.to_numpy(), own.n.to_numpy())
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected; only text is read.

    Null text and text without a letter: `und`, score 0, rejected. A text whose cross-entropy lies beyond the winner's
    calibrated limits keeps its label but is rejected. Equal texts get equal results, ties go to the first name. Other
    columns stay, the three added ones replace any of their names; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "score", "rejected")
    rows = docs.select(others(docs, *added).alias("row"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_per_batch(batches, 2 << 20):
            lang, score, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["row", "text", *added])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0
