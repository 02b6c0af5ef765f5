"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.tables import settle, shared_dir  # noqa: F401

#: ASCII letters are lower-cased, digits and every byte of a non-ASCII character stay, all else parts words.
_WORD_TABLE = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else (b if b >= 128 else 32) for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the A-Z-lower-cased text, as UTF-8. Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split() if text else []


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def rows_per_batch(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes at most (or one row): memory follows no table's longest rows.

    Workers live from stage to stage: what the task before left unused is given back first, then what each large batch
    and this task leave.
    """
    give_back()
    for batch in batches:
        if batch.nbytes <= limit:
            yield batch
            continue
        step = max(1, int(batch.num_rows * limit / batch.nbytes))
        at = 0
        while at < batch.num_rows:
            n = min(step, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > 2 * limit:
                n //= 2
            yield batch.slice(at, n)
            at += n
        del batch
        give_back()
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(found: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; memo holds those of words seen before and is emptied when it gets large."""
    import xxhash

    try:
        return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    except KeyError:
        if len(memo) > 1_000_000:
            memo.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in set(found):
            if w not in memo:
                memo[w] = digest(w)
        return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of a sequence of word hashes; a shorter, non-empty sequence is one shingle."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def others(docs: DataFrame, *replaced: str):
    """All columns but text, and but those that an operator replaces, in one struct: texts travel once."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in replaced]
    return F.struct(*(kept or [F.lit(None).cast("int").alias("none")]))


def same_schema(df: DataFrame, like: DataFrame) -> DataFrame:
    """df's columns in the order of like."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def let(value, body):
    """body(value) with value computed once: a lambda variable holds it, so no projection is folded into inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
