"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import gram_hashes, mix, rows_per_batch, settle, word_hashes, words

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 3
#: Document frequencies live in a sketch of ROWS_DF rows of CELLS counters; idf stops growing below FLOOR of the documents
#: (more where documents have over CELLS * FLOOR / 4 distinct shingles on average: the sketch tells no smaller shares).
ROWS_DF, CELLS, CHUNK, FLOOR = 2, 1 << 18, 1 << 11, 0.02
BLOCK = 256  # texts of a bucket that one product compares
_TABLE = 1 << 14  # random triples of each sample, picked by a hash of the shingle


def shingles(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    return gram_hashes(word_hashes(words(text), memo), SHINGLE)


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [(mix(h + np.uint64(r + 1)) & np.uint64(CELLS - 1)).astype(np.int64) for r in range(ROWS_DF)]


@dataclass
class Frequencies:
    """Smoothed shares (1 + df) / (1 + n) of the documents that hold a shingle, df being its least counter less the mean load."""

    shares: np.ndarray  # [ROWS_DF, CELLS]
    floor: float

    @classmethod
    def of(cls, counts: np.ndarray, n_docs: int) -> Frequencies:
        load = counts.mean(1, keepdims=True)
        shares = (1 + np.maximum(counts - np.floor(load), 0)).astype(np.float32) / (1 + n_docs)
        return cls(shares, min(max(FLOOR, 4 * float(load.max()) / (1 + n_docs)), 1.0))

    @property
    def top(self) -> float:
        return 1 + float(np.log(1 / self.floor))

    def idf(self, h: np.ndarray) -> np.ndarray:
        share = np.minimum.reduce([self.shares[r][c] for r, c in enumerate(_cells(h))])
        return 1 + np.log(1 / np.clip(share, self.floor, 1.0))

    def vector(self, text: str | None, memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in order of hash, and their weights tf * idf."""
        h, tf = np.unique(shingles(text, memo), return_counts=True)
        return h, tf * self.idf(h) if len(h) else np.zeros(0)


class Sampler:
    """Improved consistent weighted samples: for each k the shingle that minimises c / (y e^r), with its level t.

    r and c are Gamma(2, 1), beta is uniform, all functions of k and the shingle (a table of triples by a hash of both;
    ties go to the smaller shingle hash). Two texts share a sample with the probability of their weighted Jaccard.
    """

    def __init__(self, top: float, n: int = BANDS * ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        gamma = lambda: rng.gamma(2.0, 1.0, (n, _TABLE)).astype(np.float32)
        self.r, self.logc, self.beta = gamma(), np.log(gamma()), rng.random((n, _TABLE)).astype(np.float32)
        self.odd = rng.integers(1 << 30, 1 << 32, n, np.uint32) | np.uint32(1)
        self.base = (np.arange(n) * _TABLE).astype(np.uint32)[:, None]
        self.top = top
        # Most shingles are rare and occur once: what they get is looked up.
        a, t = self._levels(np.full((n, _TABLE), np.log(top), np.float32), self.r, self.logc, self.beta)
        self.usual_a, self.usual_t = a.astype(np.float32).ravel(), t.astype(np.int32).ravel()

    @staticmethod
    def _levels(logs, r, logc, beta):
        t = np.floor(logs / r + beta)
        return logc - r * (t - beta) - r, t

    def samples(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each sample (shingle, t)."""
        n = len(self.odd)
        best = np.full(n, np.inf, np.float32)
        pick = np.zeros(n, np.uint64)
        level = np.zeros(n, np.int64)
        at_k = np.arange(n)
        with np.errstate(over="ignore"):
            for lo in range(0, len(h), 1024):
                x, y = h[lo : lo + 1024], w[lo : lo + 1024]
                at = self.odd[:, None] * (x >> np.uint64(32)).astype(np.uint32)[None, :]
                at >>= np.uint32(18)
                at += self.base
                a = self.usual_a.take(at)
                odd = np.flatnonzero(np.abs(y - self.top) > 1e-5)
                if len(odd):
                    own = at[:, odd]
                    a_odd, t_odd = self._levels(np.log(y[odd]).astype(np.float32)[None, :], self.r.ravel()[own], self.logc.ravel()[own], self.beta.ravel()[own])
                    a[:, odd] = a_odd
                i = a.argmin(1)
                least = a[at_k, i]
                t = self.usual_t[at[at_k, i]].astype(np.int64)
                if len(odd):
                    where = np.full(len(x), -1, np.int64)
                    where[odd] = np.arange(len(odd))
                    own = where[i]
                    t = np.where(own >= 0, t_odd[at_k, np.maximum(own, 0)].astype(np.int64), t)
                better = least < best
                best[better], pick[better], level[better] = least[better], x[i][better], t[better]
            return mix(pick + mix(level.view(np.uint64) + np.uint64(0x51ED)))

    def bands(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = self.samples(h, w).reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(ROWS):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
        return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum() if len(both) else 0.0
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 0.0


def _node(found: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(found))


def _scan(docs: DataFrame) -> DataFrame:
    """One pass: a row (doc_id, node, t) for each document, and each task's sketch chunks.

    node is a 128-bit hash of the words (null without words), t Spark's 64-bit hash of the text as it stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        counts = np.zeros((ROWS_DF, CELLS), np.uint32)
        names = ["doc_id", "node", "t", "chunk", "counts"]
        for batch in rows_per_batch(batches):
            nodes, grams = [], [np.zeros(0, np.uint64)]
            for text in batch.column(1).to_pylist():
                found = words(text)
                nodes.append(_node(found) if found else None)
                grams.append(np.unique(gram_hashes(word_hashes(found, memo), SHINGLE)))
            for r, c in enumerate(_cells(np.concatenate(grams))):
                counts[r] += np.bincount(c, minlength=CELLS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), batch.column(2), pa.nulls(len(nodes), pa.int32()), pa.nulls(len(nodes), pa.binary())], names)
        parts = counts.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(1))
        blobs = [zlib.compress(parts[i].tobytes(), 1) for i in used]
        none = [pa.nulls(len(used), kind) for kind in (pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, node binary, t long, chunk int, counts binary")


def _frequencies(scan: DataFrame, n_docs: int) -> Frequencies:
    """Sum the tasks' chunks where they are dealt by chunk, one after the other; the driver gets one sketch, whose size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(blob), np.uint32)
                sums[chunk] = sums[chunk] + own if chunk in sums else own.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    n = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = scan.where("chunk is not null").select("chunk", "counts").repartition(n, "chunk").mapInArrow(run, "chunk int, counts binary").collect()
    counts = np.zeros((ROWS_DF * CELLS // CHUNK, CHUNK), np.uint64)
    for r in parts:
        counts[r["chunk"]] += np.frombuffer(bytes(r["counts"]), np.uint64)
    return Frequencies.of(counts.reshape(ROWS_DF, CELLS), n_docs)


def _banded(docs: DataFrame, shared) -> DataFrame:
    """(node, bands): the band keys of each document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        freq = shared.value
        sampler = Sampler(freq.top)
        for batch in rows_per_batch(batches):
            nodes, bands = [], []
            for text in batch.column(0).to_pylist():
                found = words(text)
                if found:
                    h, tf = np.unique(gram_hashes(word_hashes(found, memo), SHINGLE), return_counts=True)
                    nodes.append(_node(found))
                    bands.append(sampler.bands(h, tf * freq.idf(h)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["node", "bands"])

    return docs.select("text").mapInArrow(run, "node binary, bands array<long>")


def _clusters(vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, similarity: float) -> np.ndarray:
    """For each of some texts (distinct shingles, their counts, their idf) the first text linked with it, directly or by others.

    Every pair of texts of different labels is verified. The weighted Jaccard similarity of counts times idf is that of sets
    of (shingle, number of its occurrence), so all common weights come from one product of 0/1 rows, a few columns at a time.
    """
    m = len(vectors)
    owner = np.repeat(np.arange(m), [len(h) for h, _, _ in vectors])
    h = np.concatenate([h for h, _, _ in vectors])
    tf = np.concatenate([tf for _, tf, _ in vectors])
    idf = np.concatenate([i for _, _, i in vectors])
    total = np.bincount(owner, tf * idf, m)
    more = np.flatnonzero(tf > 1)
    nth = np.arange(tf[more].sum()) - np.repeat(np.cumsum(tf[more]) - tf[more], tf[more])
    again = np.repeat(more, tf[more])[nth > 0]
    with np.errstate(over="ignore"):
        h = np.concatenate([h, mix(h[again] + mix(nth[nth > 0].astype(np.uint64)))])
    owner, idf = np.concatenate([owner, owner[again]]), np.concatenate([idf, idf[again]])
    order = np.argsort(h, kind="stable")
    h, owner, idf = h[order], owner[order], idf[order]
    start = np.append(True, h[1:] != h[:-1])
    col = np.cumsum(start) - 1
    shared = np.bincount(col)[col] > 1  # what one text alone holds is common to no pair
    owner, idf, col = owner[shared], idf[shared], col[shared]
    col = np.unique(col, return_inverse=True)[1]
    common = np.zeros((m, m))
    width = max(64, (1 << 21) // m)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        x, y = np.searchsorted(col, [lo, lo + width])
        k = int(col[y - 1]) - lo + 1
        ones, weight = np.zeros((m, k)), np.zeros(k)
        ones[owner[x:y], col[x:y] - lo] = 1
        weight[col[x:y] - lo] = idf[x:y]
        common += (ones * weight) @ ones.T
    near = common >= (similarity - 1e-12) * (total[:, None] + total[None, :] - common)
    near |= labels[:, None] == labels[None, :]
    first = np.arange(m)
    while True:
        new = np.where(near, first[None, :], m).min(1)
        new = new[new]
        if (new == first).all():
            return first
        first = new


def _linked(groups: DataFrame, texts: DataFrame, shared, similarity: float) -> DataFrame:
    """(node, center) of texts that links within a group connect; groups has rows (g, node, label), some hundreds a group.

    Texts of one label are known to be connected; all others of a group are compared, each with each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}

        def links(nodes: list[bytes], labels: list[bytes], found: list) -> pa.RecordBatch:
            of = {x: i for i, x in enumerate(labels)}
            first = _clusters(found, np.array([of[x] for x in labels]), similarity) if len(nodes) > 1 else np.zeros(1, np.int64)
            own = [i for i in range(len(nodes)) if first[i] != i]
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in own], pa.binary()), pa.array([nodes[int(first[i])] for i in own], pa.binary())], ["node", "center"])

        held, nodes, labels, found = None, [], [], []
        for batch in rows_per_batch(batches):
            for g, node, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != held:
                    if nodes:
                        yield links(nodes, labels, found)
                    held, nodes, labels, found = g, [], [], []
                elif node == nodes[-1]:  # a repeated row of its doc_id
                    continue
                h, tf = np.unique(shingles(text, memo), return_counts=True)
                nodes.append(node)
                labels.append(label)
                found.append((h, tf, shared.value.idf(h)))
        if nodes:
            yield links(nodes, labels, found)

    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.join(texts, "node").select("g", "node", "label", "text").repartition(n, "g").sortWithinPartitions("g", "node")
    return rows.mapInArrow(run, "node binary, center binary").distinct()


def _open_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups (g, node, label) in which all pairs of different labels of buckets above BLOCK texts meet.

    The texts of a bucket's commonest label stand in blocks of their own, which meet the blocks of the others only.
    """
    named = settle(members.join(labels, "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("label")))
    counts = named.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("band", "key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n_top"), (F.sum("n") - F.max("n")).alias("n_rest")).where("n_rest > 0")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    placed = named.join(tops.select("band", "key", "top", blocks("n_top").alias("t"), blocks("n_rest").alias("r")), ["band", "key"])
    is_top = F.col("label") == F.col("top")
    at = F.pmod(F.xxhash64("node"), F.when(is_top, F.col("t")).otherwise(F.col("r"))).cast("int")
    placed = placed.withColumn("is_top", is_top).withColumn("at", F.when(is_top, at).otherwise(F.col("t") + at))
    others = F.explode(F.sequence(F.when(F.col("is_top"), F.col("t")).otherwise(F.lit(0)), F.col("t") + F.col("r") - 1))
    met = placed.select("band", "key", "node", "label", "at", others.alias("other"))
    return met.select(F.xxhash64("band", "key", F.least("at", "other"), F.greatest("at", "other")).alias("g"), "node", "label")


def components(links: DataFrame, a: str = "node", b: str = "center") -> DataFrame:
    """(node, label) of the nodes in links: the least node of its component, by least-neighbour rounds with pointer jumps.

    Every round is written as a table and only a count reaches the driver; rounds grow with the log of the longest path.
    """
    both = settle(links.select(F.col(a).alias("v"), F.col(b).alias("u")).union(links.select(F.col(b).alias("v"), F.col(a).alias("u"))).distinct())
    labels = settle(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")))
    while True:
        other = labels.select(F.col("v").alias("u"), F.col("label").alias("seen"))
        least = both.join(other, "u").groupBy("v").agg(F.min("seen").alias("seen"))
        step = labels.join(least, "v").select("v", F.least("label", "seen").alias("next"), "label")
        # the label of the label, at least as small
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("beyond"))
        new = settle(step.join(jump, "next", "left").select("v", F.least("next", F.coalesce("beyond", "next")).alias("label"), F.col("label").alias("before")))
        changed = new.where("label < before").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels.select(F.col("v").alias("node"), "label")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its group) and class_size.

    Documents of equal words are one text. Texts whose five-word TF-IDF shingles have a weighted Jaccard similarity of
    at least `similarity` are linked, and a group is a connected component of links. A text of fewer than five words
    is one shingle. Null and wordless texts are groups of their own. Within a bucket of equal band keys every pair of
    texts is verified unless other links connect it: first within blocks of BLOCK texts, then between blocks, where only
    pairs of different components meet. Repeated rows of a doc_id are copies;
    a null doc_id is never a group's name unless all are null. Extra columns are ignored; no rows: no rows.
    """
    spark = docs.sparkSession
    scan = settle(_scan(docs))
    keys = scan.where("chunk is null").select("doc_id", "node", "t")
    freq = _frequencies(scan, keys.count())
    shared = spark.sparkContext.broadcast(freq)
    banded = settle(_banded(docs, shared).dropDuplicates(["node"]))
    exploded = banded.select("node", F.posexplode("bands").alias("band", "key"))
    # Buckets of the same texts, known by two hashes of the set, are one.
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    sizes = exploded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), *same).where("n > 1")
    sizes = sizes.groupBy("n", "x0", "x1").agg(F.min(F.struct("band", "key")).alias("b")).select("b.*", "n")
    members = settle(exploded.join(sizes, ["band", "key"]))  # texts of buckets, with the bucket's size
    # Whole texts of the candidates, gathered once: a group's text is that of its documents' first.
    nodes = members.select("node").distinct()
    firsts = nodes.join(keys.groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("rep")), "node").select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.t").alias("t"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"), "text")
    texts = settle(firsts.hint("shuffle_hash").join(rows, (F.col("t") == F.col("own")) & F.col("rep").eqNullSafe(F.col("id"))).select("node", "text"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(BLOCK)))
    links = settle(_linked(members.select(F.xxhash64("band", "key", block).alias("g"), "node", F.col("node").alias("label")), texts, shared, similarity))
    labels = components(links)
    large = members.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        links = links.unionByName(settle(_linked(_open_blocks(large, labels), texts, shared, similarity)))
        labels = components(links)
    named = keys.select("doc_id", "node").join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    # Wordless documents have no node and stay alone; groups are pre-aggregated before they meet.
    classes = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(classes, "class", "left").select(
        "doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )
