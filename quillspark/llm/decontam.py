"""Benchmark decontamination: a generalised suffix automaton of test items reads each document's words in a stream."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import others, rows_per_batch, settle, words

#: Words of one automaton, and automata that are broadcast at once.
BLOCK_WORDS, BLOCKS = 2_000_000, 4
ADDED = ("n_words", "n_hit", "n_items", "items", "dropped")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items whose windows each state's strings end in."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for name, ws in items if ws]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.full: dict[int, set[str]] = {}  # by state: items that have the state's string of `window` words
        self.short: dict[int, list[tuple[int, str]]] = {}  # by state: (words, item) of shorter items
        self.shortest = window
        for name, ids in coded:
            s = 0
            for i, c in enumerate(ids):
                s = self.next[s][c]
                if i + 1 >= window:
                    s = self.at_length(s, window)
                    self.full.setdefault(s, set()).add(name)
            if len(ids) < window:
                self.short.setdefault(self.at_length(s, len(ids)), []).append((len(ids), name))
                self.shortest = min(self.shortest, len(ids))
        # Entries of shorter suffixes are seen from every state above them.
        self.seen_short = dict(self.short)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__) if self.short else ():
            if above := self.seen_short.get(self.link[s]):
                self.seen_short[s] = self.short.get(s, []) + above

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def at_length(self, s: int, n: int) -> int:
        """The state of the suffix of n words of a string of state s."""
        while self.len[self.link[s]] >= n:
            s = self.link[s]
        return s

    def hits(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items with occurring windows."""
        hit, items = np.zeros(len(found), bool), set()
        get = self.vocab.get
        ids = [get(w, -1) for w in found]
        gaps = np.flatnonzero(np.array(ids, np.int64) < 0)
        edges = np.concatenate([[-1], gaps, [len(ids)]])
        for g in np.flatnonzero(np.diff(edges) > self.shortest):  # only runs of test words can hold a window
            lo, hi = int(edges[g]) + 1, int(edges[g + 1])
            s = n = 0
            for i in range(lo, hi):
                c = ids[i]
                while s and c not in self.next[s]:
                    s = self.link[s]
                    n = self.len[s]
                if c in self.next[s]:
                    s, n = self.next[s][c], n + 1
                else:
                    s = n = 0
                if n >= self.window:
                    hit[i - self.window + 1 : i + 1] = True
                    items |= self.full[self.at_length(s, self.window)]
                for k, name in self.seen_short.get(s, ()):
                    if k <= n:
                        hit[i - k + 1 : i + 1] = True
                        items.add(name)
        return hit, items


def automata(benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata of the whole benchmark, in blocks of about block_words words: the stated query set, read once by the driver.

    Items come one after the other and an automaton is built when its block is full, so the driver holds one block.
    """
    block, size, none = [], 0, True
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        ws = words(r["t"])
        if block and size + len(ws) > block_words:
            yield SuffixAutomaton(block, window)
            block, size, none = [], 0, False
        block.append((r["i"] or "", ws))
        size += len(ws)
    if block or none:
        yield SuffixAutomaton(block, window)


def cleaned(text: str, hit: np.ndarray) -> str:
    """The text without the maximal runs of hit words, from the first byte of a run to its last."""
    data = text.encode("utf-8", "surrogatepass")
    out, at, start = [], 0, None
    spans = [m.span() for m in WORD.finditer(data.lower())]
    for i, (lo, _) in enumerate(spans):
        if hit[i] and start is None:
            start = lo
        if hit[i] and (i + 1 == len(spans) or not hit[i + 1]):
            out.append(data[at:start])
            at, start = spans[i][1], None
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of hit words, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


def _read(rows: DataFrame, tests: list, ends: bool, max_coverage: float) -> DataFrame:
    """rows (row, text, runs, items) with the runs and items of some automata added; at the end with the result's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_per_batch(batches):
            cols: list[list] = [[] for _ in kinds]
            for text, runs, known in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found = words(text)
                hit, items = np.zeros(len(found), bool), set(known or ())
                for lo, hi in zip(runs[::2], runs[1::2], strict=True) if runs else ():
                    hit[lo:hi] = True
                for a in tests:
                    h, i = a.value.hits(found)
                    hit |= h
                    items |= i
                n = int(hit.sum())
                if ends:
                    own = (cleaned(text, hit) if n else text, len(found), n, len(items), sorted(items), n > max_coverage * len(found))
                else:
                    own = (text, _runs(hit), sorted(items))
                for c, v in zip(cols, own, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["row", *names])

    if ends:
        names, kinds = ["kept", *ADDED], (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_())
        more = "kept string, n_words long, n_hit long, n_items long, items array<string>, dropped boolean"
    else:
        names, kinds, more = ["text", "runs", "items"], (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())), "text string, runs array<long>, items array<string>"
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {more}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8, block_words: int = BLOCK_WORDS, blocks: int = BLOCKS) -> DataFrame:
    """docs with test passages cut out of text, and n_words, n_hit, n_items (long), items (sorted array), dropped (boolean).

    A word is hit if it lies in an occurrence of `window` consecutive words of an item (an item of fewer, but not none,
    is one window). Runs of hit words are removed; a document whose hit share exceeds max_coverage is marked dropped.
    Null text has no words and stays null. Repeated items count once, as do rows of one item_id; null item_id: "".
    Documents are read in one pass without a shuffle, past automata of `blocks` blocks of about block_words words each,
    which are broadcast; a larger benchmark takes a pass, written as a table, for each further `blocks` blocks. Other
    columns stay; the five added ones replace any of their names. Empty tables: no rows, or no hit.
    """
    sc = docs.sparkSession.sparkContext
    none = [F.lit(None).cast(k).alias(c) for c, k in (("runs", "array<long>"), ("items", "array<string>"))]
    rows = docs.select(others(docs, *ADDED).alias("row"), F.col("text").alias("text"), *none)
    held: list = []
    for automaton in automata(benchmark, window, block_words):
        if len(held) == blocks:
            rows = settle(_read(rows, held, False, max_coverage))
            for b in held:
                b.unpersist()
            held = []
        held.append(sc.broadcast(automaton))
    out = _read(rows, held, True, max_coverage)
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
