"""External suffix sorting against plain sorting: with the base case, with recursion on disk, and its memory."""

import random
import tracemalloc

import numpy as np
import pytest

from quillspark.llm import suffixes


def check(data, depth=200):
    got = np.concatenate(list(suffixes.suffix_blocks(np.frombuffer(data, np.uint8), depth)))
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert got["pos"].tolist() == want
    common = [next((m for m in range(depth) if max(a, b) + m >= len(data) or data[a + m] != data[b + m]), depth) for a, b in zip(want, want[1:], strict=False)]
    assert got["lcp"].tolist()[1:] == common


@pytest.mark.parametrize("base", [1 << 21, 3])
@pytest.mark.parametrize("seed", range(8))
def test_suffixes_and_prefixes(monkeypatch, seed, base):
    monkeypatch.setattr(suffixes, "BASE", base)
    monkeypatch.setattr(suffixes, "BLOCK", (1 << 18, 7)[seed % 2])
    monkeypatch.setattr(suffixes, "POOL", (1 << 21, 11)[seed // 2 % 2])
    rng = random.Random(seed)
    data = bytes(rng.randrange(1, 2 + seed % 5) for _ in range((9, 60, 300, 700)[seed % 4]))
    check(data + b"\xff" + data[len(data) // 3 :] + b"\xff" + data + b"\0")


def test_runs_and_small_texts(monkeypatch):
    monkeypatch.setattr(suffixes, "BASE", 2)
    for data in (b"\0", b"a\0", b"aaaaaaaaaaaaaaaaaaaaaa\0", b"abababababab\0", b"bbbbaaaa" * 9 + b"\0"):
        check(data, 50)


@pytest.mark.parametrize("seed", range(6))
def test_doubling(seed):
    rng = random.Random(seed)
    names = [rng.randrange(1 + seed) for _ in range(50 * seed + 1)]
    assert suffixes._doubled(np.array(names)).tolist() == sorted(range(len(names)), key=lambda i: names[i:])


def test_memory_does_not_follow_the_text(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 12)
    monkeypatch.setattr(suffixes, "POOL", 1 << 13)
    monkeypatch.setattr(suffixes, "BASE", 1 << 14)
    rng = np.random.default_rng(3)
    peaks = []
    for n in (40_000, 120_000):
        words = [bytes(rng.integers(97, 100, rng.integers(1, 4), np.uint8)) for _ in range(40)]
        text = b" ".join(words[i] for i in rng.integers(0, 40, n // 3))[:n] + b"\0"
        tracemalloc.start()
        count, last = 0, None
        for block in suffixes.suffix_blocks(np.frombuffer(text, np.uint8), 200):
            for p in block["pos"][:: len(block) // 3 + 1].tolist():
                assert last is None or text[last : last + 400] <= text[p : p + 400]
                last = p
            count += len(block)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count == len(text)
    assert peaks[1] < 1.5 * peaks[0], peaks
