"""Runs of repeated words in whole texts, by an online sparse dynamic program over diagonals.

A diagonal is a lag q: word i lies on it where it equals word i - q. A run of period q and length L is a stretch of L - q >= 3q such
words. The plain program adds one to the match length of every lag at which a word occurred before, which takes the square of a
frequent word's count. Lags of [g, 2g), g a power of two, need no such steps: their stretches are at least 3g long, so they
contain two blocks of g words that start at multiples of g. So the program for these lags goes from block to block: a block's earlier
occurrences at those lags (told by the block's name) lengthen the active diagonals by g; a diagonal that ends is closed word by word,
less than two blocks to either side, and emitted if it is long enough. n / g blocks meet g lags each, so every power costs n
comparisons, however often a word occurs.

Powers rise. A diagonal whose stretch lies inside a run already emitted repeats that run's period (both periods fit into the stretch,
so their greatest common divisor is one as well) and is left out; any other has its lag as smallest period. Names are 64-bit hashes
of blocks; every run emitted is verified by its words' bytes, and the slice is done again with exact numbers if one fails.

Nothing is shuffled: a text is one row of one task, short texts are worked many at a time by numpy, next to texts of like length.
Memory is about 60 bytes a word of the longest text.

Defined results: null and wordless texts have no words and no runs and collapse to the empty text; null doc_ids and repeated rows are
rows like others; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.words import BASE, mix, slices, small_batches, utf8, word_hashes, word_spans

LEAST, TIMES = 6, 4  # words of a run at least, and periods of it
_U = np.uint64
_AT_ONCE = 1 << 20


def _paired(one: np.ndarray, two: np.ndarray, exact: bool) -> np.ndarray:
    """A name of each pair of names."""
    if exact:
        return np.unique(np.stack([one, two], 1), axis=0, return_inverse=True)[1].astype(_U).reshape(-1)
    return mix(one * BASE + two + _U(0x2545F491))


def _ended(ids: np.ndarray, first: np.ndarray, end: np.ndarray, lag: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [first, end) of diagonals, lengthened word by word by less than two blocks to the left and one to the right."""
    step, n = np.arange(2 * g), len(ids)
    left, right = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    width = max(1, _AT_ONCE // (2 * g))
    for k in range(0, len(first), width):
        a, b, q = (v[k:k + width, None] for v in (first, end, lag))
        i = a - 1 - step
        same = (i >= q) & (ids[np.maximum(i, 0)] == ids[np.maximum(i - q, 0)])
        left[k:k + width] = np.where(same.all(1), 2 * g, same.argmin(1))
        i = b + step[:g]
        same = (i < n) & (ids[np.minimum(i, n - 1)] == ids[np.minimum(i, n - 1) - q])
        right[k:k + width] = np.where(same.all(1), g, same.argmin(1))
    return first - left, end + right


def find_runs(ids: np.ndarray, longest: int, exact: bool = False) -> np.ndarray:
    """(start, length, period) of every run, sorted by start and period.

    ``ids`` are the words of texts one after another, each text followed by a number that occurs nowhere else; ``longest`` is the
    number of words of the longest.
    """
    found, names, g = [np.zeros((0, 3), np.int64)], ids, 1
    while TIMES * g <= longest:
        blocks = len(ids) // g - 2  # those that start at 2g, 3g, ...
        match = names[1:1 + blocks * g].reshape(blocks, g) == names[2 * g::g][:blocks, None]
        twice = match[:-1] & match[1:]
        if twice.any():
            column, block = np.nonzero(twice.T)
            new = np.flatnonzero(np.r_[True, (column[1:] != column[:-1]) | (block[1:] != block[:-1] + 1)])
            last = np.r_[new[1:], len(block)] - 1
            lag, first, end = 2 * g - 1 - column[new], (block[new] + 2) * g, (block[last] + 4) * g
            before = np.concatenate(found)
            before = before[np.argsort(before[:, 0], kind="stable")]
            reach = np.r_[-1, np.maximum.accumulate(before[:, 0] + before[:, 1])] if len(before) else np.array([-1])
            fresh = reach[np.searchsorted(before[:, 0], first - lag, "right")] < end
            lag, first, end = lag[fresh], first[fresh], end[fresh]
            first, end = _ended(ids, first, end, lag, g)
            length = end - first + lag
            long = length >= np.maximum(LEAST, TIMES * lag)
            found.append(np.stack([(first - lag)[long], length[long], lag[long]], 1))
        names = _paired(names[:-g], names[g:], exact)
        g *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then those of the next."""
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> bool:
    """Whether the words of every run are equal a period apart, by their bytes."""
    late = _spread(runs[:, 0] + runs[:, 2], runs[:, 1] - runs[:, 2])
    early = late - np.repeat(runs[:, 2], runs[:, 1] - runs[:, 2])
    size = ends - starts
    if (size[late] != size[early]).any():
        return False
    ahead = np.r_[0, np.cumsum(size[late])]
    k = 0
    while k < len(late):
        m = max(k + 1, int(np.searchsorted(ahead, ahead[k] + _AT_ONCE, "right")) - 1)
        if (data[_spread(starts[late[k:m]], size[late[k:m]])] != data[_spread(starts[early[k:m]], size[late[k:m]])]).any():
            return False
        k = m
    return True


def _exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(data[a:b].tobytes(), len(numbers)) for a, b in zip(starts, ends)], _U)


def _runs_of(offsets: np.ndarray, data: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = False) -> np.ndarray:
    """(first word of the slice, length, period) of the runs of all texts; texts of like length share a pass."""
    ids = _exact_ids(data, starts, ends) if exact else word_hashes(data, starts, ends)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    begin = np.r_[0, np.cumsum(words)[:-1]]
    kind = np.frexp(words.astype(float))[1]
    found = [np.zeros((0, 3), np.int64)]
    for k in np.unique(kind[words >= LEAST]):
        mine = np.flatnonzero((kind == k) & (words >= LEAST))
        size = words[mine] + 1
        at = np.cumsum(size) - size
        flat = np.empty(size.sum(), _U)
        ends_at = at + words[mine]
        inside = np.ones(len(flat), bool)
        inside[ends_at] = False
        flat[inside] = ids[_spread(begin[mine], words[mine])]
        flat[ends_at] = np.arange(len(mine)).astype(_U) + _U(len(starts)) if exact else mix(np.arange(len(mine)).astype(_U) + _U(0xA5A5F00D))
        runs = find_runs(flat, int(words[mine].max()), exact)
        if len(runs):
            text = np.searchsorted(at, runs[:, 0], "right") - 1
            runs[:, 0] += begin[mine[text]] - at[text]
            found.append(runs)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    inside = not len(runs) or bool((doc[runs[:, 0]] == doc[runs[:, 0] + runs[:, 1] - 1]).all())
    if not exact and not (inside and _same_bytes(data, starts, ends, runs)):
        return _runs_of(offsets, data, doc, starts, ends, True)
    return runs


def _collapsed(offsets: np.ndarray, data: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Offsets and bytes of the texts without the words that follow a run's first period, one space between words."""
    drop = np.zeros(len(starts) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[stay]] += 1
    edge[ends[stay]] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    between = ends[stay[:-1][doc[stay[:-1]] == doc[stay[1:]]]]
    keep[between] = True
    text = data.copy()
    text[between] = 0x20
    size = [np.count_nonzero(keep[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    return np.r_[0, np.cumsum(size)].astype(np.int32), text[keep].tobytes()


def _worked(batches):
    for b in batches:
        offsets, data = utf8(b.column("text"))
        for i, j in slices(offsets):
            own = offsets[i:j + 1] - offsets[i]
            part = data[offsets[i]:offsets[j]]
            doc, starts, ends = word_spans(own, part)
            runs = _runs_of(own, part, doc, starts, ends)
            where = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
            words = np.bincount(doc, minlength=j - i)
            begin = np.r_[0, np.cumsum(words)[:-1]]
            ends_of, text = _collapsed(own, part, doc, starts, ends, runs)
            fields = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begin[where]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(where, minlength=j - i))].astype(np.int32)), fields)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, j - i), pa.array(words), listed, pa.StringArray.from_buffers(j - i, pa.py_buffer(ends_of), pa.py_buffer(text))],
                ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the text without repeated periods) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_worked, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, every tenth document (by its id's checksum) turned into one that repeats a stretch of its words from word a on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(F.col("h") / 10)
    with_words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", h)
    with_words = with_words.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n = F.size("w")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    other = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    chosen = with_words.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return chosen.select("doc_id", F.when(n > 0, other).otherwise(F.col("text")).alias("text"))


def op12_sparse_diagonal_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: the runs of all ``documents``."""
    rows = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    ahead = lambda one, two: two.isNull() | (one["length"] * two["period"] > two["length"] * one["period"])
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda top, r: F.when(ahead(r, top), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
