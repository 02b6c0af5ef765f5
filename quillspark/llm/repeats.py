"""Suffix-array de-duplication: repeated byte strings are found by external suffix sorting of shards and cut out.

Every string of `length` bytes has a least hash among its ANCHOR-byte pieces. Runs of consecutive strings with one such
hash are stretches; equal strings lie in stretches of one hash, so stretches of one hash go to one shard, and stretches
whose hash occurs once need no sorting. Equal stretches are counted and sorted once.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mix, others, rows_per_batch, settle

LENGTH, ANCHOR, SHARD_BYTES, BLOCK = 200, 32, 2 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int, memo: dict) -> np.ndarray:
    if len(memo.get(base, ())) < n:
        with np.errstate(over="ignore"):
            memo[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, BLOCK) + 1, base, np.uint64))])
    return memo[base][:n]


def least_hashes(data: np.ndarray, length: int, anchor: int, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each string of `length` bytes of data, the least hash of its anchor-byte pieces; and the hash of each piece."""
    n, w = len(data), length - anchor + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n, memo))])
        h = mix((sums[anchor:] - sums[:-anchor]) * _powers(_INVERSE, n - anchor + 1, memo))
    pad = -len(h) % w
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    m = n - length + 1
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m]), h


def stretches(data: bytes, length: int, anchor: int, memo: dict) -> Iterator[tuple[int, int, int, bool]]:
    """(least hash, start, bytes, alone) of each stretch; alone: its least piece occurs once in it, so no string in it repeats there.

    Long data are read in overlapping blocks; a stretch that goes on in the next block is cut there in two, which only
    makes two stretches of one hash.
    """
    for lo in range(0, max(len(data) - length + 1, 0), BLOCK):
        part = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - lo), lo)
        least, h = least_hashes(part, length, anchor, memo)
        edges = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
        sizes = np.diff(edges) + length - 1
        # Does the least piece stand at more than one place of the stretch?
        lowest = np.repeat(np.arange(len(sizes)), np.diff(edges))
        same = np.bincount(lowest, h[: len(least)] == least, len(sizes)).astype(np.int64)
        w = length - anchor
        for i, (a, size, m) in enumerate(zip(edges[:-1].tolist(), sizes.tolist(), least[edges[:-1]].tolist(), strict=True)):
            b = int(edges[i + 1])
            places = int(same[i]) + int((h[b : b + w] == np.uint64(m)).sum())
            yield m, lo + a, size, places < 2


def _text_key():
    """A text's 128-bit hash; a stretch is known by its least hash and its own, which are 128 bits together."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _stretch_rows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo: dict = {}
        for batch in rows_per_batch(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for m, start, size, alone in stretches(data, length, anchor, memo):
                    for c, v in zip(cols, (m, xxhash.xxh3_64_intdigest(data[start : start + size]), u, start, size, alone), strict=True):
                        c.append(v)
            m, c = (np.array(x, np.uint64).view(np.int64) for x in cols[:2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(m), pa.array(c), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.bool_())], ["m", "c", "u", "start", "size", "alone"]
            )

    return docs.select(_text_key().alias("u"), "text").mapInArrow(run, "m long, c long, u binary, start long, size int, alone boolean")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(m, c, data): the bytes of one place (u, start, size) of each wanted stretch."""
    per_text = wanted.groupBy("u").agg(F.collect_list(F.struct("m", "c", "start", "size")).alias("places"))
    rows = docs.select(_text_key().alias("u"), "text")
    joined = rows.join(per_text.hint("shuffle_hash"), "u").select("u", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in rows_per_batch(batches):
            out: list[list] = [[], [], []]
            for u, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u in done:  # copies of a text stand in one task
                    continue
                done.add(u)
                data = text.encode("utf-8", "surrogatepass")
                for p in places:
                    for c, v in zip(out, (p["m"], p["c"], data[p["start"] : p["start"] + p["size"]]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["m", "c", "data"])

    return joined.mapInArrow(run, "m long, c long, data binary")


def _repeated(strings: DataFrame, length: int, n_shards: int) -> DataFrame:
    """(m, c, spans): where strings of `length` bytes that start elsewhere too begin in each stretch, as [first, last] pairs.

    A shard's stretches are appended to a file, sorted externally, and neighbours that share `length` bytes marked.
    """

    def shard(text_path: str, keys: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.suffixes import suffix_blocks

        with open(text_path, "ab") as f:
            f.write(b"\0")
        text = np.memmap(text_path, np.uint8, "r")
        marks = np.memmap(text_path + ".marks", bool, "w+", shape=(len(text),))
        last = -1
        for block in suffix_blocks(text, length, os.path.dirname(text_path)):
            hit = block["lcp"] >= length
            marks[block["pos"][hit]] = True
            if hit[0] and last >= 0:
                marks[last] = True
            marks[block["pos"][:-1][hit[1:]]] = True
            last = int(block["pos"][-1])
        ms, cs, spans = [], [], []
        for m, c, at, size in keys:
            own = np.flatnonzero(np.diff(np.concatenate([[0], marks[at : at + size - length + 1], [0]]).astype(np.int8)))
            if len(own):
                ms.append(m)
                cs.append(c)
                spans.append([int(x) - (i % 2) for i, x in enumerate(own)])
        yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int64()), pa.array(cs, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["m", "c", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp()
        try:
            held, keys, at, f, path = None, [], 0, None, ""
            for batch in batches:
                for own, m, c, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if own != held:
                        if f:
                            f.close()
                            yield from shard(path, keys)
                            os.unlink(path)
                            os.unlink(path + ".marks")
                        held, keys, at, path = own, [], 0, os.path.join(folder, f"shard{own}")
                        f = open(path, "wb")  # noqa: SIM115
                    keys.append((m, c, at, len(data)))
                    # Bytes of UTF-8 are never 0xFF: it parts the stretches, and no marked string holds it.
                    f.write(data + b"\xff")
                    at += len(data) + 1
            if f:
                f.close()
                yield from shard(path, keys)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    n = max(1, int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = strings.select(F.pmod("m", F.lit(n_shards)).alias("shard"), "m", "c", "data").repartition(n, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "m long, c long, spans array<long>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs with kept (binary: the bytes left), n_bytes, n_removed, n_spans (long) and spans (array of [start, end) pairs).

    A byte of the UTF-8 text is removed if a string of `length` bytes that covers it also starts anywhere else, in the
    same text or another; strings are judged on the input and never cross texts. n_spans counts maximal removed runs.
    Null text: empty. Shorter texts lose nothing. Rows that repeat a text repeat its strings. Other columns stay; the
    added ones replace any of their names; an empty table gives an empty table. 32 <= anchor < length <= 255.
    """
    rows = settle(_stretch_rows(docs, length, anchor))
    # How often each least hash occurs decides what is looked at further; counts are pre-aggregated, so hot ones are no group.
    again = rows.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("alone").alias("alone")).where("n > 1 or not alone").select("m")
    seen = settle(rows.join(again, "m"))
    kinds = settle(
        seen.groupBy("m", "c").agg(F.count(F.lit(1)).alias("n"), F.min("alone").alias("alone"), F.min(F.struct("u", "start", "size")).alias("place"))
    )
    several = kinds.groupBy("m").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most"), F.min("n").alias("least"), F.min("alone").alias("alone")).where("(kinds > 1 and least = 1) or not alone").select("m")
    wanted = kinds.join(several, "m").select("m", "c", "place.*")
    total = wanted.agg(F.sum("size")).head()[0] or 0
    found = kinds.where("n > 1").select("m", "c", F.array(F.lit(0).cast("long"), (F.col("place.size") - length).cast("long")).alias("spans"))
    if total:
        part = _repeated(_cut_out(docs.where("text is not null"), wanted), length, max(1, -(-total // SHARD_BYTES)))
        single = kinds.where("n = 1").select("m", "c")
        found = found.unionByName(settle(part).join(single, ["m", "c"]))
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct((F.col("start") + F.get("spans", i)).alias("lo"), (F.col("start") + F.get("spans", i + 1) + length).alias("hi")))
    hits = seen.select("m", "c", "u", "start").distinct().join(found, ["m", "c"]).select("u", pairs.alias("spans"))
    by_text = hits.groupBy("u").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    added = ("kept", "n_bytes", "n_removed", "n_spans", "spans")
    whole = docs.select(others(docs, *added).alias("row"), F.col("text").alias("text"), _text_key().alias("u_"))
    joined = whole.join(by_text.hint("shuffle_hash"), F.col("u_") == F.col("u"), "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_per_batch(batches):
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((x["lo"], x["hi"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                at, kept = 0, []
                for lo, hi in merged:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                for c, v in zip(cols, (b"".join(kept), len(data), sum(b - a for a, b in merged), len(merged), merged), strict=True):
                    c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["row", "text", *added])

    out = joined.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, text string, kept binary, n_bytes long, n_removed long, n_spans long, spans array<array<long>>")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)

