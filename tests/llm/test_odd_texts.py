"""Texts and rows that are easy to get wrong: hash-breaking words, very long texts, one doc_id with several texts, clashing columns."""

import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from tempora.llm import columnwise, decontamination, embeddings, langid, lines, minhash, recompression, spans
from tempora.plans.scratch import materialize
from tests.llm import brute

WORDS = "n_words long, n_removed long, kept_sha256 string"
BYTES = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
OTHER = MORSE.translate({97: 98, 98: 97})


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words_cut(df):
    return {r.doc_id: tuple(r)[1:] for r in spans.finished(df, recompression.covered_words(df), recompression._cut, WORDS).collect()}


def bytes_cut(df):
    return {r.doc_id: tuple(r)[1:] for r in spans.finished(df, columnwise.covered_bytes(df), columnwise._cut, BYTES).collect()}


def test_words_that_break_polynomial_hashes(spark):
    rng = random.Random(1)
    head, tail = text_of(rng, 30), text_of(rng, 30)
    rows = [(1, f"{head} {MORSE} {tail}"), (2, f"{head} {OTHER} {tail}"), (3, f"{head} {MORSE} {tail}"), (4, MORSE), (5, OTHER)]
    df = frame(spark, rows)
    assert words_cut(df) == brute.substring_words(rows)
    assert bytes_cut(df) == brute.substring_bytes(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == brute.near_dups(rows, 3, 85) and got[4][1] != got[5][1]


def test_texts_longer_than_a_piece(spark):
    """1.6 million characters; the repeated passages lie across the borders of pieces, and one word is longer than a piece."""
    rng = random.Random(2)
    long = text_of(rng, 300_000)
    cut = (1 << 20) - 900
    start = long.index(" ", cut) + 1
    passage = long[start:long.index(" ", cut + 2000)]
    rows = [(1, long), (2, passage), (3, "x" * 1_500_000 + " " + passage), (4, None)]
    df = frame(spark, rows)
    words, raw = words_cut(df), bytes_cut(df)
    n = len(passage.split())
    assert words[1][:2] == (300_000, 0) and words[2][:2] == (n, n) and words[3][:2] == (n + 1, n)
    assert raw[1][1] == 0 and raw[2][1] == len(passage) and len(passage) <= raw[3][1] <= len(passage) + 1
    sets = {r.doc_id: r.n_shingles for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert sets == {d: len(brute.shingle_set(t, 3)) for d, t in rows}


def test_one_doc_id_with_two_texts(spark):
    rng = random.Random(3)
    a, b, c = (text_of(rng, 120) for _ in range(3))
    df = frame(spark, [(1, a), (2, b), (2, a + " " + c), (2, b), (None, a), (None, c), (3, b)])
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in spans.finished(df, recompression.covered_words(df), recompression._cut, WORDS).collect() if r.doc_id)
    assert got == [(1, 120, 0), (2, 120, 0), (2, 120, 0), (2, 240, 120), (3, 120, 120)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in spans.finished(df, columnwise.covered_bytes(df), columnwise._cut, BYTES).collect() if r.doc_id)
    assert [x[2] for x in got if x[1] == len(a) + 1 + len(c)] == [len(a)] and got[-1] == (3, len(b), len(b))
    groups = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(df, 3, 85).collect() if r.doc_id}
    assert groups == {(1, 118): 1, (2, 118): 2, (2, 238): 2, (3, 118): 2}
    wide = df.withColumn("_row", F.lit("mine")).withColumn("grp", F.lit(1))
    kept = minhash.one_of_each(wide)
    assert kept.columns == wide.columns
    assert sorted((r.doc_id or 0, len(r.text)) for r in kept.collect()) == sorted([(0, len(a)), (0, len(c)), (1, len(a)), (2, len(b)), (2, len(a) + 1 + len(c))])
    item = spark.createDataFrame([(7, c)], "item_id long, text string")
    clean = sorted((r.doc_id or 0, len(r.text)) for r in decontamination.without_leaks(df, item).collect())
    assert clean == sorted([(0, len(a)), (1, len(a)), (2, len(b)), (2, len(b)), (3, len(b))])
    long = frame(spark, [(1, "one line of text here\nb\nc"), (1, "one line of text here\nd"), (2, "b\nd\ne")])
    assert sorted(r.n_removed for r in lines.dedup_lines(long).collect()) == [0, 1, 2]


def test_language_across_blocks_and_clashing_columns(spark):
    rng = random.Random(4)
    train = {"x": text_of(rng, 4000), "y": text_of(random.Random(5), 4000).upper()}
    parser = langid.CrossParser(train)
    text = " ".join(rng.choice(train["x"].split()) + rng.choice(["", "é", "q "]) for _ in range(3000))
    cost, _ = parser.costs([text])
    for k, lang in enumerate(parser.langs):
        low, there = "".join(c if c.isalpha() else " " for c in text.lower()), "".join(c if c.isalpha() else " " for c in train[lang].lower())
        known = set(there)
        i = n = 0
        while i < len(low):  # the plain parse: the longest phrase that the training text holds
            size = 1
            while i + size <= len(low) and set(low[i:i + size]) <= known and low[i:i + size] in there:
                size += 1
            i, n = i + max(1, size - 1), n + 1
        assert abs(round(cost[0, k] / parser.weights[k]) - n) <= 0.01 * n
    df = frame(spark, [(1, "some words"), (2, None)]).withColumn("lang", F.lit("x")).withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit(9.0)).withColumn("_text", F.lit("t")).withColumn("_lang", F.lit("l"))
    got = langid.recognised(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "some words", "x", "mine", 9.0, "t", "l")]


def test_vectors_in_many_cells_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(embeddings, "CELL", 8)  # 400 vectors a label: six bits
    base = rng.standard_normal((400, 32))
    z = rng.standard_normal((400, 32))
    base, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (base, z))
    z -= (z * base).sum(1, keepdims=True) * base
    near = 0.935 * base + (1 - 0.935**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in v], f"l{k % 2}") for k, v in enumerate(np.r_[base, near])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    want = brute.near_vectors(rows, 0.93)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert there >= 790 and 0.97 * there <= found <= there
    twice = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 0.0], "b")], "vec_id long, embedding array<double>, label string")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(twice).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_empty_tables_pass_the_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_many_lines_in_one_document(spark):
    """A document of 200,000 lines: work goes with the lines, not with their square."""
    unlike = "\n".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(200_000))
    pair = "\n".join(["a line that stands twice", "a line that stands twicE", "x", "x", ""])
    docs = spark.createDataFrame([(1, unlike), (2, unlike + "\n" + pair)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs).collect()}
    assert got[1] == (200_000, 0, unlike)
    assert got[2][:2] == (200_005, 200_002)
