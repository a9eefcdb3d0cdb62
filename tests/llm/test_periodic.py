"""Runs of repeated words, against every stretch tried one by one."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tempora.llm import periodic


def brute_runs(w):
    """Maximal stretches of smallest period q and length max(6, 4q) at least."""
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(6, 4 * q) and not any(q % p == 0 and all(w[k] == w[k - p] for k in range(s + p, j)) for p in range(1, q)):
                found.append((s, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_words(rng):
    """Words over few letters with nested, adjacent and overlapping repetitions."""
    unit = [rng.choice("ab") for _ in range(rng.randint(1, 9))]
    for _ in range(rng.randint(1, 3)):
        unit = unit * rng.randint(1, 6) + [rng.choice("abc") for _ in range(rng.randint(0, 3))]
    return (unit * rng.randint(1, 5))[:rng.randint(1, 500)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_odd_words(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodic, "_AT_ONCE", 64)
    for _ in range(60):
        texts = [odd_words(rng) for _ in range(rng.randint(1, 4))]
        text = [" ".join(t).encode() for t in texts]
        offsets = np.r_[0, np.cumsum([len(t) for t in text])]
        data = np.frombuffer(b"".join(text), np.uint8)
        for exact in (False, True):
            runs = periodic._runs_of(offsets, data, *periodic.word_spans(offsets, data), exact)
            want, at = [], 0
            for t in texts:
                want += [(s + at, size, q) for s, size, q in brute_runs(t)]
                at += len(t)
            assert [tuple(r) for r in runs.tolist()] == want


def test_fibonacci_and_thue_morse():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(1500))
    for w in (b[:1500], morse, "a" * 1500, ("a" * 37 + "b") * 30, "ab" * 700 + "ba" * 50):
        ids = np.array([ord(c) for c in w] + [7], np.uint64)
        assert [tuple(r) for r in periodic.find_runs(ids, len(w)).tolist()] == brute_runs(w)


def test_colliding_hashes_are_noticed(monkeypatch):
    """With hashes that call all words of one size equal, bytes show it and exact numbers take over."""
    monkeypatch.setattr(periodic, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    w = "aa bb cc dd ee ff gg x y x y x y x y z".split()
    data = np.frombuffer(" ".join(w).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    assert periodic._runs_of(offsets, data, *periodic.word_spans(offsets, data)).tolist() == [[7, 8, 2]]


def test_frequent_words_of_a_long_text_take_no_squares():
    """Two million words of one kind, and as many that end on a long period."""
    rng = np.random.default_rng(1)
    one = np.r_[np.zeros(2_000_000, np.uint64), np.uint64(9)]
    unit = rng.integers(0, 3, 400_000).astype(np.uint64)
    two = np.r_[rng.integers(0, 3, 300_000).astype(np.uint64), np.uint64(5), np.tile(unit, 4), np.uint64(7), np.uint64(8)]
    began = time.time()
    assert periodic.find_runs(one, len(one) - 1).tolist() == [[0, 2_000_000, 1]]
    found = periodic.find_runs(two, len(two) - 1)
    assert [300_001, 1_600_000, 400_000] in found.tolist() and time.time() - began < 60


def test_every_row_is_worked(spark):
    """Null, empty and long texts, repeated rows, null ids, clashing columns, an empty table."""
    long = "one two three " * 60_000 + "end " + "x " * 100_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a\ta\na a  a a a"), (6, "A b A b A b A b A c"), (6, "A b A b A b A b A c"), (None, "z z z z z z"), (7, long), (8, "no run here at all")]
    df = spark.createDataFrame([(k, t, "r", 5, 1) for k, t in rows], "doc_id long, text string, runs string, n_words int, start int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()), key=str)
    short = [(k, len(words(t)), brute_runs(words(t)), collapsed(words(t), brute_runs(words(t)))) for k, t in rows if k != 7]
    assert got == sorted([*short, (7, 280_001, [(0, 180_000, 3), (180_001, 100_000, 1)], "one two three end x")], key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, t in docs:
        w = words(t)
        h = zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d] = (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(collapsed(w, runs)))
    got = periodic.op12_sparse_diagonal_runs(spark, sf_dir)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
