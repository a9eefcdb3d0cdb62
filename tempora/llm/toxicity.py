"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Both dictionaries are raw content and end with what the classes have in common (the ``COMMON_WORDS`` words that most ordinary texts
hold). The toxic one begins with segments of toxic texts: maximal stretches covered by pieces of ``PIECE`` bytes whose document
frequency speaks for the class (z score of ``SURE`` and more), the commonest first. The ordinary one begins with as many bytes of
running ordinary text, ``EXCERPT`` bytes from each text at a place that the text's checksum decides (shorter texts whole).
(zstandard's own trainer picks segments by frequency in one class alone and separates the classes poorly.)

A text, lower-cased, is cut into windows of ``WINDOW`` bytes of running text, one every ``STEP`` bytes, and each window is compressed
under both dictionaries. A window counts against the text if the toxic dictionary shortens it by at least a margin more than the
ordinary one. Margin and curve are calibrated on sample rows that the dictionaries were not made of: a logistic curve on the number
and share of such windows gives the score.

Every window of every whole text is scored. The sample: ``docs_per_class`` rows of each label at most (lowest hashes), ``CHARS``
characters of each.

Defined results: null and empty texts have no windows and get the curve's score for none; without rows of both labels every score
is 0; a null doc_id isn't held out; repeated rows get equal scores; rows of one doc_id with different texts are scored by their
texts, and the alphabetically first is the one that a label may teach; a doc_id with several labels is toxic if any is; lang, source
and doc_id never enter a score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.langid import held_out, lowest
from tempora.llm.words import small_batches

CHARS, LEVEL = 20_000, 9
PIECE, SURE = 7, 5.0
WINDOW, STEP = 32, 16
COMMON_WORDS, SEGMENT_BYTES, EXCERPT = 600, 4096, 24
CALIBRATION = 300  # rows of each label that calibrate
MARGINS = (2, 3, 4)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def windows(raw: bytes) -> list[bytes]:
    """Windows that cover the whole text; the last one may be shorter."""
    return [raw[i:i + WINDOW] for i in range(0, max(1, len(raw) - WINDOW + STEP), STEP)] if raw else []


class Classifier:
    """Both compressors and the calibrated curve."""

    def __init__(self, toxic: bytes, ordinary: bytes, margin: int = 3, curve=(0.0, 0.0, 0.0)):
        self.toxic, self.ordinary, self.margin, self.curve = toxic, ordinary, margin, curve
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                                  write_content_size=False, write_checksum=False, write_dict_id=False)
        self._one, self._zero = make(toxic).compress, make(ordinary).compress

    def gains(self, text: str) -> np.ndarray:
        """Of each window, the bytes by which the toxic dictionary shortens it more than the ordinary one."""
        one, zero = self._one, self._zero
        return np.array([len(zero(w)) - len(one(w)) for w in windows(_bytes(text))], np.int64)

    def score(self, text: str) -> float:
        v = sum(a * b for a, b in zip(self.curve, features(self.gains(text), self.margin), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))


def features(gains: np.ndarray, margin: int) -> tuple[float, float, float]:
    hits = int((gains >= margin).sum())
    return 1.0, math.log1p(hits), math.log((hits + 0.2) / (len(gains) + 40))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge by Newton steps; coefficients and loss."""
    b, ridge = np.zeros(x.shape[1]), 0.05 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-6, 1 - 1e-6)
    return b, float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def _pieces(raw: bytes) -> set[bytes]:
    return {raw[i:i + PIECE] for i in range(len(raw) - PIECE + 1)}


def _excerpt(raw: bytes) -> bytes:
    at = zlib.crc32(raw) % max(1, len(raw) - EXCERPT + 1)
    return raw[at:at + EXCERPT]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The two dictionaries' contents from texts of both classes."""
    n1, n0 = len(toxic), len(ordinary)
    df1 = Counter(g for t in toxic for g in _pieces(t))
    least = max(2, n1 // 200)
    df1 = {g: n for g, n in df1.items() if n > least}
    df0 = Counter(g for t in ordinary for g in _pieces(t) if g in df1)

    def z(g):
        p = (df1[g] + df0[g] + 0.5) / (n1 + n0 + 1)
        return (df1[g] / n1 - df0[g] / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))

    sure = {g for g in df1 if z(g) >= SURE}
    segments = Counter()
    for t in toxic:
        end = start = -1
        for i in range(len(t) - PIECE + 1):
            if t[i:i + PIECE] in sure:
                if i > end:
                    if start >= 0:
                        segments[t[start:end]] += 1
                    start = i
                end = i + PIECE
        if start >= 0:
            segments[t[start:end]] += 1
    common = Counter(w for t in ordinary for w in set(t.split()))
    shared = b" ".join(w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[COMMON_WORDS::-1])
    own = b"".join(s for s, _ in sorted(segments.items(), key=lambda x: (-x[1], x[0])))[:SEGMENT_BYTES]
    running = b" ".join(_excerpt(t) for t in ordinary)[:len(own)]
    return own + shared, running + shared


def fit(texts: list[str], labels: list[int]) -> Classifier | None:
    """A classifier from a bounded sample; None without both labels."""
    toxic, ordinary = ([_bytes(t) for t, y in zip(texts, labels, strict=True) if y == k] for k in (1, 0))
    if not toxic or not ordinary:
        return None
    held = max(1, min(CALIBRATION, min(len(toxic), len(ordinary)) // 3))
    trial = Classifier(*dictionaries(toxic[held:] or toxic, ordinary[held:] or ordinary))
    gains = [trial.gains(t.decode("utf-8")) for t in (*toxic[:held], *ordinary[:held])]
    y = np.array([1.0] * held + [0.0] * held)
    best = None
    for margin in MARGINS:
        b, loss = _curve(np.array([features(g, margin) for g in gains]), y)
        if best is None or loss < best[0]:
            best = loss, margin, tuple(b.tolist())
    return Classifier(*dictionaries(toxic, ordinary), *best[1:])


def sample(docs: DataFrame, labels: DataFrame, learn, docs_per_class: int = 1000) -> tuple[list[str], list[int]]:
    """The bounded sample of labelled rows, in an order that depends on hashes alone."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    known = known.filter(learn).withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id"))
    chosen = lowest(known, "toxic", docs_per_class)
    texts = docs.filter("text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", 1, CHARS).alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    rows = got.orderBy("h", "doc_id").collect()  # 2 x docs_per_class rows of CHARS at most
    return [r.text for r in rows], [r.toxic for r in rows]


def score(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    small_batches(docs.sparkSession)
    parts = docs.sparkSession.sparkContext.broadcast(model and (model.toxic, model.ordinary, model.margin, model.curve))

    def run(batches):
        m = parts.value and Classifier(*parts.value)
        for b in batches:
            out = [m.score(t or "") if m else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_compression_distance_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: the toxicity of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(3, 1)))
    return score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
