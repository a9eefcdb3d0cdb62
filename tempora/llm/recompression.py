"""Substring dedup by words: recompression names token runs and pairs, and shared high-level symbols reveal long repeats.

Names are 64-bit hashes of what they stand for, so every Spark task gives equal runs and pairs equal names in each round and no
dictionary has to be gathered. A run round replaces maximal runs of one symbol; a pair round splits the symbols into left and
right ones by a bit of their hash and replaces each left-right pair. Beside each symbol goes the span of words that decides it
(its own words and those of the neighbours that could have changed it). A symbol decided inside a window occurs in every copy of
the window, whatever surrounds it: equal substrings have equal interior symbols.

A window's anchor is the symbol of the highest round that is decided inside it (the least name of those, the leftmost of equal
ones). Words themselves are round 0, so each window has one. Rows and windows that share an anchor are verified by xxh3 of all their
words' bytes, so that equality never rests on hashes of hashes alone. Long texts are worked in overlapping pieces of bounded size.

Defined results: null text has no words; documents of fewer than ``size`` words lose nothing; windows that repeat only inside one
document (or under one doc_id) stay; rows with a null doc_id lose nothing and remove nothing; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import spans
from tempora.llm.words import PIECE, joined_words, mix, slices, small_batches, utf8, word_hashes, word_pieces, word_spans
from tempora.plans.scratch import materialize

SIZE = 50
ROUNDS = ("run", "pair", "pair", "pair", "pair", "run", "pair", "pair")
_U = np.uint64
_FAR = np.int64(1) << 40


def _levels(doc: np.ndarray, names: np.ndarray):
    """Yields (name, first deciding word, end of deciding words, first own word) of the symbols of each round, round 0 first.

    Symbols never cross documents; those that a document's edge decides have deciding words outside it.
    """
    n = len(names)
    own = np.arange(n)
    lo, hi = own, own + 1
    yield names, lo, hi, own
    for level, kind in enumerate(ROUNDS, 1):
        n = len(names)
        edge_l = np.r_[True, doc[1:] != doc[:-1]]  # the first symbol of a document
        edge_r = np.r_[edge_l[1:], True]
        left_lo = np.where(edge_l, -_FAR, np.r_[0, lo[:-1]])  # what the neighbour to the left depends on
        right_hi = np.where(edge_r, _FAR, np.r_[hi[1:], 0])
        if kind == "run":
            first = np.flatnonzero(edge_l | np.r_[True, names[1:] != names[:-1]])
            count = np.diff(np.r_[first, n])
            last = first + count - 1
            new = np.where(count > 1, mix(names[first] * _U(3) + mix(count.astype(_U) + _U(level << 32))), names[first])
            names, doc, own, lo, hi = new, doc[first], own[first], left_lo[first], right_hi[last]
        else:
            left = (mix(names + _U(level)) >> _U(63)).astype(bool)
            pair = np.zeros(n, bool)  # a left symbol followed by a right one
            pair[:-1] = left[:-1] & ~left[1:] & ~edge_r[:-1]
            second = np.r_[False, pair[:-1]]
            keep = np.flatnonzero(~second)
            nxt = np.minimum(keep + 1, n - 1)
            paired = pair[keep]
            new = np.where(paired, mix(names[keep] * _U(5) + mix(names[nxt] + _U(level << 32))), names[keep])
            # a lone left symbol depends on what follows, a lone right one on what precedes
            new_lo = np.where(paired | left[keep], lo[keep], left_lo[keep])
            new_hi = np.where(paired, hi[nxt], np.where(left[keep], right_hi[keep], hi[keep]))
            names, doc, own, lo, hi = new, doc[keep], own[keep], np.minimum(new_lo, lo[keep]), np.maximum(new_hi, hi[keep])
        yield names, lo, hi, own


def anchors(doc: np.ndarray, names: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, anchor name, anchor's word) of every window of ``size`` words inside one document."""
    n = len(names)
    if n < size:
        z = np.zeros(0, np.int64)
        return z, z.astype(_U), z
    at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1:])
    best, place = np.zeros(len(at), _U), np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    for sym, lo, hi, own in reversed(list(_levels(doc, names))):
        # deciding spans move right with the symbols, so those inside a window are a range
        a = np.searchsorted(np.maximum.accumulate(lo), at[todo], "left")
        b = np.searchsorted(np.minimum.accumulate(hi[::-1])[::-1], at[todo] + size, "right")
        have = b > a
        t, a, b = todo[have], a[have], b[have]
        least, where = sym[a], own[a]
        for step in range(1, int((b - a).max()) if len(a) else 0):
            k = np.minimum(a + step, b - 1)
            better = sym[k] < least
            least, where = np.where(better, sym[k], least), np.where(better, own[k], where)
        best[t], place[t] = least, where
        todo = todo[~have]
        if not len(todo):
            break
    return at, best, place


def _pieces(offsets: np.ndarray, data: np.ndarray, size: int, piece: int):
    """(first document, end document, word number of the piece's first word, document of each word, starts, ends, bytes)."""
    for i, j in slices(offsets, piece):
        part, raw = offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]]
        if j == i + 1 and len(raw) > piece:
            for lo, hi, word0, starts, ends in word_pieces(raw, size - 1, piece):
                yield i, j, word0, np.zeros(len(starts), np.int64), starts, ends, raw[lo:hi]
        else:
            yield i, j, 0, *word_spans(part, raw), raw


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """xxh3 of the words lo..hi - 1 with one space between them."""
    text, first, end = joined_words(raw, starts, ends)
    return np.array([xxhash.xxh3_64_intdigest(text[x:y]) for x, y in zip(first[lo].tolist(), end[hi - 1].tolist(), strict=True)], _U)


def _anchor_rows(docs: DataFrame, size: int, piece: int = PIECE) -> DataFrame:
    def run(batches):
        for b in batches:
            offsets, data = utf8(b.column("text"))
            ids, lanes = (b.column(c).to_numpy() for c in ("doc_id", "lane"))
            for i, _, word0, doc, starts, ends, raw in _pieces(offsets, data, size, piece):
                at, name, place = anchors(doc, word_hashes(raw, starts, ends), size)
                if not len(at):
                    continue
                first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)])
                windows = np.diff(np.r_[first, len(at)])
                lo = at[first]
                hi = lo + windows - 1 + size
                # where the anchor lies in the row is part of the content
                content = mix(_digests(raw, starts, ends, lo, hi) + ((hi - lo) * 4096 + (place[first] - lo)).astype(_U))
                start = lo - np.searchsorted(doc, doc[lo], "left") + word0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[first].view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[i + doc[lo]]),
                     pa.array(start + lanes[i + doc[lo]]), pa.array(windows.astype(np.int32))],
                    ["anchor", "content", "doc_id", "start", "windows"])

    return spans.known_texts(docs).mapInArrow(run, spans.ROWS)


def _window_rows(docs: DataFrame, rows: DataFrame, size: int, piece: int = PIECE) -> DataFrame:
    """anchor, window (a hash of its words), doc_id, start of each window of the given rows."""

    def run(batches):
        for b in batches:
            offsets, data = utf8(b.column("text"))
            cut, f = spans.struct_lists(b.column("rows"))
            ids, lanes = (b.column(c).to_numpy() for c in ("doc_id", "lane"))
            for i, j, word0, doc, starts, ends, raw in _pieces(offsets, data, size, piece):
                k = slice(cut[i], cut[j])
                owner = np.repeat(np.arange(j - i), np.diff(cut[i:j + 1]))
                n = f["windows"][k].astype(np.int64)
                at = np.repeat(f["start"][k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner, anchor = np.repeat(owner, n), np.repeat(f["anchor"][k], n)
                lo = at - word0 + np.searchsorted(doc, np.arange(j - i), "left")[owner]
                here = (lo >= 0) & (lo + size <= len(doc))  # a long text's other windows lie in other pieces
                at, owner, anchor, lo = at[here], owner[here], anchor[here], lo[here]
                for m in range(0, len(at), 100_000):
                    m = slice(m, m + 100_000)
                    window = _digests(raw, starts, ends, lo[m], lo[m] + size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[m]), pa.array(window.view(np.int64)), pa.array(ids[i + owner[m]]), pa.array(at[m] + lanes[i + owner[m]])],
                        ["anchor", "window", "doc_id", "start"])

    return spans.with_rows(docs, rows).mapInArrow(run, "anchor long, window long, doc_id long, start long")


def covered_words(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, start, stop: ranges of words covered by windows that also start in a document of smaller doc_id."""
    small_batches(docs.sparkSession)
    covered, rest = spans.shared_rows(_anchor_rows(docs, size), size)
    windows = materialize(_window_rows(docs, rest, size), "windows")
    first = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    late = windows.join(first, ["anchor", "window"]).filter("doc_id > first").select("doc_id", "start", (F.col("start") + size).alias("stop"))
    late = materialize(late, "late")
    spans.drop_scratch(windows)
    return covered.unionByName(late)


def _cut(text: str, starts: np.ndarray, stops: np.ndarray):
    words = text.encode("utf-8", "surrogatepass").split()
    keep = np.ones(len(words), bool)
    for a, b in zip(starts, stops, strict=True):
        keep[a:b] = False
    kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
    return len(words), int(len(words) - keep.sum()), spans.digest(kept)


def op5_recompression_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: words of all ``documents`` covered by 50-word windows of earlier documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans.finished(docs, covered_words(docs), _cut, "n_words long, n_removed long, kept_sha256 string")
