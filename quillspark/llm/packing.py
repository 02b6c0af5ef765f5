"""Best-fit packing with certified bin counts: partitions above their lower bound exchange documents and pack again."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import rows_per_batch, settle

CAPACITY, END_ID, GROUP_ROWS, ROUNDS = 1024, 2, 20_000, 3
_PIECES = re.compile(r"\s*\S+|\s+\Z")


class Encoder:
    """Token ids by the tokenizers library, as encode(text, add_special_tokens=False) gives them; distinct pieces are encoded once.

    The vocabulary's splitter never joins across the start of a run of white space, so a text is the concatenation of
    pieces that begin with one. A text that names an added token, or has separators that only Python calls white
    space, is encoded whole.
    """

    def __init__(self, path: str, limit: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.unsafe = re.compile("|".join([*added, "[\x1c-\x1f]"]))
        self.wide = any(re.search(r"\s", t) for t in added)  # names that lie in several pieces
        # Two generations of pieces: a full one becomes the old one, from which pieces that are met again come back.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit
        # Names of a byte-level vocabulary's ids have one character for each byte.
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        self.width[list(vocab.values())] = [len(t) for t in vocab]
        self.marks = dict(zip(".,", self._whole([".", ","]), strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, from one call for all: cut where the bytes of the ids add up to the pieces' ends."""
        ids = np.array(self.tok.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        if len(ids) and int(ids.max()) < len(self.width):
            at = np.cumsum(self.width[ids])
            cuts = np.searchsorted(at, ends) + 1
            if at[-1] == ends[-1] and np.array_equal(at[cuts - 1], ends):
                own, stops = ids.tobytes(), (4 * cuts).tolist()
                return [own[i:j] for i, j in zip([0, *stops], stops, strict=False)]
        return self._whole(pieces)

    def _learn(self, keys: list[str], texts: list[str]) -> None:
        """Keep the ids of texts under their keys."""
        if len(self.memo) > self.limit:
            self.old, self.memo = self.memo, {}
        memo, old, marks = self.memo, self.old, self.marks
        new: dict[str, str] = {}
        ended: list[str] = []
        for k, t in zip(keys, texts, strict=True):
            if k in memo or k in new:
                continue
            if (ids := old.get(k)) is not None:
                memo[k] = ids
            elif t[-1] in marks and t[-2:-1].isalpha():  # a mark after a letter is a token of its own
                ended.append(k)
                body = k[:-1]
                if body not in memo:
                    if (ids := old.get(body)) is not None:
                        memo[body] = ids
                    else:
                        new[body] = t[:-1]
            else:
                new[k] = t
        # Pieces that begin with white space and end without it follow each other as in a text.
        joined = {k: t for k, t in new.items() if t[0].isspace() and not t[-1].isspace()}
        if len(joined) < len(new):
            alone = {k: t for k, t in new.items() if k not in joined}
            memo.update(zip(alone, self._whole(list(alone.values())), strict=True))
        if joined:
            memo.update(zip(joined, self._cut(list(joined.values())), strict=True))
        for k in ended:
            memo[k] = memo[k[:-1]] + marks[k[-1]]

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Pieces that are not known are encoded by one call for all texts."""
        out: list = []
        open_, keys_of, texts_of = [], [], []
        get = self.memo.get
        for text in texts:
            if not text:
                out.append(b"")
                continue
            # The usual text has single blanks and line ends alone: a key is a piece without its blank, or with its line end.
            keys = text.replace("\n", " \n").split(" ")
            first = keys[0]
            keys[0] = " " + first
            got = list(map(get, keys))
            try:
                out.append(b"".join(got))
                continue
            except TypeError:  # a piece that is not known
                pass
            # Known keys are pieces of this form; blanks that follow each other leave keys that are never known.
            missing = [k for k, ids in zip(keys, got, strict=True) if ids is None]
            if first and all(k and not k[-1].isspace() for k in missing):
                pieces = [k if k[0] == "\n" else " " + k for k in missing]
                if got[0] is None:
                    pieces[0] = first
                unsafe = self.unsafe.search(text if self.wide else "".join(pieces))
            else:
                unsafe = self.unsafe.search(text)
                pieces = _PIECES.findall(text)
                missing = ["  " + p for p in pieces]
                got = [None] * len(missing)
            if unsafe:
                out.append(self._whole([text])[0])
                continue
            open_.append((len(out), got, missing))
            out.append(b"")
            keys_of += missing
            texts_of += pieces
        if open_:
            self._learn(keys_of, texts_of)
            known = self.memo.__getitem__
            for i, got, missing in open_:
                found = map(known, missing)
                out[i] = b"".join([next(found) if ids is None else ids for ids in got])
        return [np.frombuffer(ids, np.uint32) for ids in out]


_ENCODERS: dict[str, Encoder] = {}  # of a Python worker: pieces stay known from task to task


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and end_id: (doc_id, piece, start, length, ids_crc32[, ids]).

    Null or empty text: end_id alone. A document of more than `capacity` ids is cut into pieces of `capacity`, of which
    the first may be shorter. Names of added tokens in a text are those tokens, as the library's encode has it. Rows that
    repeat a doc_id, also a null one, give pieces each. Other columns are not read; an empty table gives no pieces.
    tokenizer: path of a tokenizers file.
    """

    def encoded(enc: Encoder, texts: pa.Array) -> Iterator[np.ndarray]:
        some, size = [], 0
        for text in texts:
            some.append(text.as_py())
            size += len(some[-1] or "")
            if size > 1 << 18:
                yield from enc.batch(some)
                some, size = [], 0
        yield from enc.batch(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for batch in rows_per_batch(batches, 4 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for i, found in zip(batch.column(0).to_pylist(), encoded(enc, batch.column(1)), strict=True):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                at = 0
                while at < len(ids):
                    n = (len(ids) - at) % capacity or min(capacity, len(ids) - at)
                    own = ids[at : at + n]
                    for c, v in zip(out, (i, len(out[1]), at, n, zlib.crc32(own.tobytes()), own), strict=True):
                        c.append(v)
                    out[1][-1] = 0 if at == 0 else out[1][-2] + 1
                    at += n
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
            if with_ids:
                cols.append(pa.array(out[5], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, from counts[length], by two families of dual feasible functions.

    For each threshold k, lengths over capacity - k count as a whole bin and those under k as nothing; and for each m,
    a length x counts as the rounded (m + 1) x / capacity of m (whole values of it: x itself).
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n = counts[sizes].astype(np.int64)
    best = -(-int((n * sizes).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        value = np.where(sizes > capacity - k, capacity, np.where(sizes >= k, sizes, 0))
        best = max(best, -(-int((n * value).sum()) // capacity))
    for m in range(1, 32):
        whole = (m + 1) * sizes % capacity == 0
        value = np.where(whole, sizes * m, (m + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (m * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each length by best-fit decreasing: each goes to the fullest open bin that takes it."""
    out = np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        if room > size:
            stacks[room - size].append(b)
            mask |= 1 << (room - size)
    return out


def _pack_group(rows: pd.DataFrame, capacity: int, slack: int) -> pd.DataFrame:
    """Pack one group anew, keep its earlier packing unless the new one has fewer bins, and mark what to exchange."""
    lengths = rows.length.to_numpy("int64")
    bins = best_fit(lengths, capacity)
    old = rows.bin.to_numpy("int64")
    if old[0] >= 0:
        _, old = np.unique(old, return_inverse=True)
        if old.max() <= bins.max():
            bins = old
    fill = np.bincount(bins, lengths).astype(np.int64)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    gap = len(fill) - bound
    # A partition at its bound gives only its emptiest bin to others; one with a gap, its emptiest bins, many for each it is over.
    give = min(int((fill < capacity).sum()), 1 if gap == 0 else slack * gap + 1)
    order = np.argsort(fill, kind="stable")
    loose = np.zeros(len(fill), bool)
    loose[order[:give]] = True
    return rows.assign(bin=bins, gap=gap, loose=loose[bins])


def _packer(lap: int, capacity: int, slack: int):
    def packed(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        out = _pack_group(own, capacity, slack)
        # lap, partition and bin in one number: unique among all sequences
        out["bin"] = (lap << 58) + (int(key[0]) << 30) + out["bin"]
        return out.drop(columns="part")

    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, group_rows: int = GROUP_ROWS, slack: int = 16) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most `capacity` tokens, filled without gaps from 0.

    Pieces are dealt to partitions of about group_rows by a hash; best-fit decreasing packs each and dual feasible
    functions certify its bin count. Then the emptiest bins of partitions above their bound, and one of each other,
    exchange their pieces over fewer partitions, which pack again (an earlier packing stands unless bins are saved).
    This ends when nothing is exchanged, one partition was left, the total meets the bound of all lengths, or after
    `rounds` exchanges. No task gets more than about group_rows pieces. Rows that repeat a piece are packed each; within
    a sequence longer pieces come first, then by doc_id (null first) and piece. Other columns stay, sequence_id and
    offset are replaced if there. Empty pieces table: no rows.
    """
    # Inside, the columns of pieces go by numbers, so that none of them clashes with a working column.
    place = {c: f"c{i}" for i, c in enumerate(pieces.columns)}
    own = [F.col(f"`{c}`").alias(at) for c, at in place.items()]
    rows = settle(pieces.select(*own, F.col("length").alias("length"), F.lit(-1).cast("long").alias("bin"), F.monotonically_increasing_id().alias("row_id")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    n, least = int(counts.sum()), lower_bound(counts, capacity)
    fields = ", ".join(f"{place[f.name]} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", length long"
    done, groups, settled = None, max(1, -(-n // group_rows)), 0
    for k in range(rounds + 1):
        here = groups
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("row_id", F.lit(k)) if k == 0 else F.xxhash64("bin", F.lit(k)), F.lit(here)))
        out = settle(dealt.drop("gap", "loose").groupBy("part").applyInPandas(_packer(k, capacity, slack), f"{fields}, bin long, row_id long, gap int, loose boolean"))
        loose = out.where("loose").agg(F.count(F.lit(1)), F.countDistinct("bin")).head()
        total = settled + out.select("bin").distinct().count()
        stop = k == rounds or here == 1 or not loose[0] or total <= least
        fixed = out if stop else out.where("not loose")
        done = fixed if done is None else done.unionByName(fixed)
        if stop:
            break
        settled = total - loose[1]
        rows, groups = out.where("loose"), max(1, min(here // 2, -(-loose[0] // group_rows)))
    from pyspark.sql import Window

    before = Window.partitionBy("bin").orderBy(F.desc("length"), place["doc_id"], place["piece"], "row_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = [F.col(at).alias(c) for c, at in place.items() if c not in ("sequence_id", "offset")]
    return done.select(*kept, F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def sequences(pieces_with_ids: DataFrame, packed: DataFrame) -> DataFrame:
    """Whole sequences: (sequence_id, input_ids, doc_ids, lengths), pieces in offset order."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    own = pieces_with_ids.dropDuplicates(keys).join(packed, keys)
    got = own.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return got.select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
