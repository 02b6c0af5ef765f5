"""Line de-duplication: documents probe sharded minimal perfect hashes of repeated lines; lines are never joined."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mix, others, rows_per_batch, settle

BLANK = b" \t\n\x0b\x0c\r"
#: Keys of one shard, shards at most (their sizes are broadcast), and probes that one copy of a shard answers.
SHARD_KEYS, MOST_SHARDS, PROBES = 100_000, 1 << 16, 200_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, A-Z-lower-cased line, or None if it has fewer than min_chars code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _digests(text: str | None, min_chars: int) -> list[tuple[int, int] | None]:
    import xxhash

    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line_key(line, min_chars)
        d = xxhash.xxh3_128_intdigest(key) if key is not None else None
        out.append(None if d is None else (d >> 64, d & (1 << 64) - 1))
    return out


_SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def document_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, h1, h2): the 128-bit hashes of each document's distinct line keys of at least min_chars code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_per_batch(batches):
            ids, h1, h2 = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for d in {d for d in _digests(text, min_chars) if d}:
                    ids.append(i)
                    h1.append(_SIGNED(d[0]))
                    h2.append(_SIGNED(d[1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays; a key's index is the rank of its bit."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.offsets, self.bits = sizes, np.concatenate([[0], np.cumsum(sizes)]), bits
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, level = [], [], 0
        while len(keys):
            size = max(2, 2 * len(keys))
            slots = cls._slots(keys, level, size)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys, level = keys[~alone[slots]], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; some index or -1 for a key that was not built in."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._slots(keys[left], level, size) + self.offsets[level]
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> bytes:
    """One shard: the perfect hash over h1 and, by its index, arrays of fingerprints (h2), counts and keeping documents."""
    ph = PerfectHash.build(h1)
    order = np.argsort(ph.index(h1))
    with io.BytesIO() as f:
        np.savez(f, sizes=ph.sizes, bits=np.packbits(ph.bits), prints=h2[order], counts=np.minimum(counts, 2**32 - 1).astype(np.uint32)[order], keepers=keepers[order])
        return f.getvalue()


class Shard:
    def __init__(self, blob: bytes):
        z = np.load(io.BytesIO(blob))
        self.hash = PerfectHash(z["sizes"], np.unpackbits(z["bits"])[: int(z["sizes"].sum())].astype(bool))
        self.prints, self.counts, self.keepers = z["prints"], z["counts"], z["keepers"]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 for a line that is not indexed) and keeping documents."""
        at = self.hash.index(h1)
        found = at >= 0
        found[found] = self.prints[at[found]] == h2[found]
        counts, keepers = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        counts[found], keepers[found] = self.counts[at[found]], self.keepers[at[found]]
        return counts, keepers


def build_index(keys: DataFrame, min_docs: int) -> DataFrame:
    """(shard, n_shards, probes, blob): shards over the distinct hashes of lines that at least min_docs documents hold."""
    stats = settle(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs))
    n_shards = max(1, min(MOST_SHARDS, -(-stats.count() // SHARD_KEYS)))
    # Equal h1 of two lines would break the perfect hash: the shard number follows h1, the few clashes go to a level of their own.
    from pyspark.sql import Window

    lap = F.row_number().over(Window.partitionBy("h1").orderBy("h2")) - 1
    placed = stats.withColumn("lap", lap).withColumn("shard", F.pmod("h1", F.lit(n_shards)))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blob = pack_shard(rows.h1.to_numpy("int64").view("uint64"), rows.h2.to_numpy("int64").view("uint64"), rows.n.to_numpy(), rows.keeper.fillna(-(1 << 63)).to_numpy("int64"))
        return pd.DataFrame({"shard": [key[0]], "lap": [key[1]], "n_shards": [n_shards], "probes": [int(rows.n.sum())], "blob": [blob]})

    return settle(placed.groupBy("shard", "lap").applyInPandas(build, "shard long, lap int, n_shards int, probes long, blob binary"))


def probe_index(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, h1, h2) of the lines that their document loses: indexed, and kept in another document.

    Probes stream past their shard: both are dealt by (shard, salt) and sorted so that the shard's arrays come first.
    A shard that many documents probe is copied to several salts, so no task gets all probes of a frequent line.
    """
    head = index.agg(F.max("n_shards")).head()[0]
    if head is None:
        return keys.limit(0)
    sizes = index.groupBy("shard").agg((F.floor(F.sum("probes") / PROBES) + 1).cast("int").alias("salts"))
    shards = index.join(F.broadcast(sizes), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2")
    )
    probes = (
        keys.withColumn("shard", F.pmod("h1", F.lit(head)).cast("long"))
        .join(F.broadcast(sizes), "shard")
        .select("shard", F.pmod(F.xxhash64("doc_id", "h2"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc_id", "h1", "h2")
    )
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = shards.unionByName(probes).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple[int, int] | None, list[Shard]] = (None, [])
        for batch in batches:
            at = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], 1)
            kind = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.any(at[1:] != at[:-1], 1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if lo == hi:
                    continue
                if held[0] != (own := (int(at[lo, 0]), int(at[lo, 1]))):
                    held = (own, [])
                n_index = int((kind[lo:hi] == 0).sum())
                for i in range(lo, lo + n_index):
                    held[1].append(Shard(batch.column(3)[i].as_py()))
                rows = batch.slice(lo + n_index, hi - lo - n_index)
                if not rows.num_rows or not held[1]:
                    continue
                ids, h1, h2 = rows.column(4), rows.column(5).to_numpy(zero_copy_only=False), rows.column(6).to_numpy(zero_copy_only=False)
                own_id = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                lost = np.zeros(len(h1), bool)
                for shard in held[1]:
                    counts, keepers = shard.probe(h1.view(np.uint64), h2.view(np.uint64))
                    lost |= (counts > 0) & (keepers != own_id)
                mask = pa.array(lost)
                yield pa.RecordBatch.from_arrays([ids.filter(mask), rows.column(5).filter(mask), rows.column(6).filter(mask)], ["doc_id", "h1", "h2"])

    return met.mapInArrow(run, "doc_id long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text reduced to its kept lines, and n_lines, n_dropped (long).

    A line's key is the line stripped of ASCII white space and A-Z-lower-cased. Keys of at least min_chars code points
    that min_docs documents hold lose all their lines but those of the largest doc_id holding them. Null or empty text
    is one empty line and comes back empty. Rows that repeat a doc_id count as documents of their own, and all of them
    keep or lose a line together; a null doc_id is below every other. Other columns stay; n_lines and n_dropped are
    replaced if there. An empty table gives an empty table.
    """
    keys = settle(document_keys(docs, min_chars))
    lost = probe_index(keys, build_index(keys, min_docs)).groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    rows = docs.select(others(docs, "n_lines", "n_dropped").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    joined = rows.join(lost.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc_id")), "left").select("row", "text", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_per_batch(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, gone = (text or "").split("\n"), 0
                if lost:
                    out = {(x["h1"], x["h2"]) for x in lost}
                    keep = [not (d and (_SIGNED(d[0]), _SIGNED(d[1])) in out) for d in _digests(text, min_chars)]
                    gone = len(keep) - sum(keep)
                    text = "\n".join(line for line, k in zip(lines, keep, strict=True) if k)
                texts.append(text or "")
                n_lines.append(len(lines))
                n_dropped.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    kind = rows.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"row {kind}, kept string, n_lines long, n_dropped long")
    own = [F.col(f"row.`{c}`") if c != "text" else F.col("kept").alias("text") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, "n_lines", "n_dropped")
