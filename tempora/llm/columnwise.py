"""Substring dedup by bytes: Burrows-Wheeler transforms of string collections, built column by column.

Spark narrows the corpus to short strings: rows of 50-byte windows around anchors (the least hash of the window's ``GRAM``-byte
grams) that several documents share and whole-row comparison leaves open. Rows with a shared anchor are named anew by a longer
context, the gram with ``REACH`` bytes before it for windows that hold those, with ``REACH`` bytes after it for all others, so that
grams that only happen to recur fall away. Strings that share an anchor meet in one bucket, at most ``HOT`` an anchor
and about ``BUCKET`` in all. The rows of hot anchors are cut into single windows, which an aggregation by their bytes settles (it
combines map-side); none of them enters a bucket, so a bucket never grows with a hot group.

In a bucket the collection's transform is built for all strings side by side: each round inserts one symbol of every string, from
its end towards its start. The inserted suffixes' rows follow from ranks in the transform of the round before, old rows move down
in one sequential pass, and common prefixes of new neighbours are one more than the least one between their former rows. After the
last round equal windows are runs of rows whose common prefix reaches the window, and each run knows its smallest document.

Defined results: null text is empty; texts shorter than the window lose nothing; windows that repeat only inside one document (or
under one doc_id) stay; rows with a null doc_id lose nothing and remove nothing; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import spans
from tempora.llm.words import BASE, BASE_INVERSE, BYTE_CODES, PIECE, mix, powers, runs, slices, small_batches, utf8
from tempora.plans.scratch import materialize

SIZE, GRAM = 50, 16
REACH = (SIZE - GRAM) // 2
BUCKET = 20_000  # strings
HOT = 2_000  # strings with one anchor
BLOCK = 4_000  # strings that go through the transform together, more only where one anchor has more
_END = 0xFF  # a byte that UTF-8 never has
_U = np.uint64


def _sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=total[1:])
    return total


def _hashes(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((total[hi] - total[lo]) * powers(BASE_INVERSE, len(total))[lo])


def anchors(offsets: np.ndarray, data: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """(document, window start in it, number of windows, anchor, its place in the first window) of the runs of windows that share an anchor."""
    n = len(data)
    doc_len = np.diff(offsets)
    if not (doc_len >= size).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(_U), z
    total = _sums(data)
    grams = mix((total[gram:] - total[:-gram]) * powers(BASE_INVERSE, n - gram + 1))
    low = (_U(1) << _U(24)) - _U(1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=_U)  # leftmost of equal ones; a slice is below 2 ** 24 bytes or one text
    best, width = keyed, 1
    need = size - gram + 1
    while width * 2 <= need:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < need:
        best = np.minimum(best[: len(best) - (need - width)], best[need - width:])
    # runs of equal keys, cut where a document begins and where its last window has begun
    cut = np.r_[True, best[1:] != best[:-1]]
    for edge in (offsets[:-1], np.maximum(offsets[1:] - size + 1, offsets[:-1])):
        cut[edge[edge < len(best)]] = True
    first = np.flatnonzero(cut)
    windows = np.diff(np.r_[first, len(best)])
    doc = np.searchsorted(offsets, first, "right") - 1
    whole = first + size <= offsets[doc + 1]
    first, windows, doc = first[whole], windows[whole], doc[whole]
    place = (best[first] & low).astype(np.int64)
    return doc, first - offsets[doc], windows, grams[place], place - first


def _anchor_rows(docs: DataFrame, size: int, piece: int = PIECE) -> DataFrame:
    """anchor, doc_id, start, shape (windows x 64 + the anchor's place in the first one); long texts go in overlapping pieces."""

    def run(batches):
        for b in batches:
            offsets, data = utf8(b.column("text"))
            ids, lanes = (b.column(c).to_numpy() for c in ("doc_id", "lane"))
            for i, j in slices(offsets, piece):
                ends = range(int(offsets[i]) + piece, int(offsets[j]), piece) if j == i + 1 else ()
                for lo, hi in zip([int(offsets[i]), *ends], [*(e + size - 1 for e in ends), int(offsets[j])], strict=True):
                    hi = min(hi, int(offsets[j]))
                    part = np.array([0, hi - lo]) if j == i + 1 else offsets[i:j + 1] - lo
                    doc, start, windows, name, place = anchors(part, data[lo:hi], size)
                    if len(doc):
                        at = lanes[i + doc] + start + (lo - offsets[i])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(name.view(np.int64)), pa.array(ids[i + doc]), pa.array(at), pa.array((windows * 64 + place).astype(np.int32))],
                            ["anchor", "doc_id", "start", "shape"])

    return spans.known_texts(docs).mapInArrow(run, "anchor long, doc_id long, start long, shape int")


def _each_row(b):
    """Of a batch with doc_id, lane, text, rows: bytes, and of each row in order of places: its document's first byte, doc_id, lane and the rows' fields."""
    offsets, data = utf8(b.column("text"))
    cut, f = spans.struct_lists(b.column("rows"))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(cut))
    order = np.argsort(offsets[owner] + f["start"], kind="stable")
    owner = owner[order]
    return data, offsets[owner], *(b.column(c).to_numpy()[owner] for c in ("doc_id", "lane")), {k: v[order] for k, v in f.items()}


def _with_content(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Rows of spans.ROWS, named by the longer context: the windows that hold it before the gram, and the others."""

    def run(batches):
        for b in batches:
            data, base, ids, lanes, f = _each_row(b)
            raw, at = data.tobytes(), base + f["start"]
            i = 0
            while i < len(at):
                j = int(np.searchsorted(at, at[i] + PIECE, "right"))
                j = min(j, i + 200_000)
                k, i = slice(i, j), j
                start, windows, place = at[k], f["shape"][k] // 64, f["shape"][k] % 64
                before = np.clip(place - REACH + 1, 0, windows)  # windows that begin REACH bytes or more before the gram
                p, q = int(start.min()), int((start + windows).max()) - 1 + size
                total = _sums(data[p:q])
                for side, lo, n, gram in ((1, start, before, place - REACH), (2, start + before, windows - before, place)):
                    some = n > 0
                    lo, n, gram = lo[some], n[some], (start + gram)[some] - p
                    name = mix(_hashes(total, gram, gram + GRAM + REACH) + _U(side))
                    content = np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(lo.tolist(), (lo + n - 1 + size).tolist(), strict=True)], _U)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[k][some]),
                         pa.array(lo - base[k][some] + lanes[k][some]), pa.array(n.astype(np.int32))],
                        ["anchor", "content", "doc_id", "start", "windows"])

    return spans.with_rows(docs, rows).mapInArrow(run, spans.ROWS)


def _strings(docs: DataFrame, rows: DataFrame, size: int, windows: bool) -> DataFrame:
    """anchor, doc_id, start, part: the bytes of each row, or of each window of it."""

    def run(batches):
        for b in batches:
            data, base, ids, lanes, f = _each_row(b)
            raw = data.tobytes()
            for k in range(0, len(base), 20_000):
                k = slice(k, k + 20_000)
                n = f["windows"][k].astype(np.int64) if windows else np.ones(len(base[k]), np.int64)
                row = np.repeat(np.arange(len(n)), n)
                start = f["start"][k][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                width = np.full(len(row), size) if windows else f["windows"][k] - 1 + size
                lo = base[k][row] + start
                part = [raw[x:y] for x, y in zip(lo.tolist(), (lo + width).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f["anchor"][k][row]), pa.array(ids[k][row]), pa.array(start + lanes[k][row]), pa.array(part, pa.binary())],
                    ["anchor", "doc_id", "start", "part"])

    return spans.with_rows(docs, rows).mapInArrow(run, "anchor long, doc_id long, start long, part binary")


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for non-empty ranges."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    order = np.argsort(lo)
    out = np.empty(len(lo), values.dtype)
    out[order] = np.minimum.reduceat(np.r_[values, values[-1:]], np.stack([lo[order], hi[order]], 1).ravel())[::2]
    return out


def collection_transform(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefix with the row before, string, suffix length) of all suffixes in order, end rows first.

    Common prefixes are exact below ``depth`` and count as ``depth`` from there on; at the end of strings they stop.
    """
    m = len(strings)
    length = np.array([len(s) for s in strings], np.int64)
    flat, stop = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(length)
    bwt, lcp = np.full(m, _END, np.uint8), np.zeros(m, np.uint8)
    row = np.arange(m)  # where each string's longest suffix so far stands
    for r in range(1, int(length.max(initial=0)) + 1):
        now = np.flatnonzero(length >= r)
        c = flat[stop[now] - r]
        at = row[now]
        bwt[row[length == r - 1]] = _END
        bwt[at] = c
        # symbols in order, each with its row: numbers sort faster than places by symbols
        kind, bits = (np.uint32, 24) if len(bwt) < 1 << 24 else (np.uint64, 56)
        order = bwt.astype(kind) << kind(bits)
        order |= np.arange(len(bwt), dtype=kind)
        asked = order[at]
        order.sort()
        by_symbol = np.argsort(asked)
        mine = np.empty(len(at), np.int64)
        mine[by_symbol] = np.searchsorted(order, asked[by_symbol])
        before, after = ((order[k] & kind((1 << bits) - 1)).astype(np.int64) for k in (np.maximum(mine - 1, 0), np.minimum(mine + 1, len(bwt) - 1)))
        has_before, has_after = (mine > 0) & (bwt[before] == c), (mine + 1 < len(bwt)) & (bwt[after] == c)
        new_lcp = np.zeros(len(now), np.uint8)
        new_lcp[has_before] = np.minimum(depth - 1, _least_between(lcp, before[has_before] + 1, at[has_before] + 1)) + 1
        next_lcp = np.minimum(depth - 1, _least_between(lcp, at[has_after] + 1, after[has_after] + 1)) + 1
        place = m + mine
        size = len(bwt) + len(now)
        old = np.ones(size, bool)
        old[place] = False
        grown = []
        for have, new in ((bwt, np.uint8(_END)), (lcp, new_lcp)):
            x = np.empty(size, have.dtype)
            x[old], x[place] = have, new
            grown.append(x)
        bwt, lcp = grown
        lcp[place[has_after] + 1] = next_lcp
        row[now] = place
    # whose suffixes the rows are follows from the last transform: a symbol's rank tells the row of the suffix that it begins
    longer = np.empty(len(bwt), np.int64)
    longer[np.argsort(bwt, kind="stable")] = np.arange(m, m + len(bwt))
    who, rem = np.arange(len(bwt)), np.zeros(len(bwt), np.int64)
    row = np.arange(m)
    for r in range(1, int(length.max(initial=0)) + 1):
        now = np.flatnonzero(length >= r)
        row[now] = longer[row[now]]
        who[row[now]], rem[row[now]] = now, r
    return bwt, lcp, who, rem


def _late_windows(size: int):
    def late(pdf: pd.DataFrame) -> pd.DataFrame:
        """Ranges of a bucket's strings covered by windows that also start in a smaller document.

        Equal windows name one anchor, so a bucket goes block by block of whole anchors, whose columns stay in the processor's cache.
        """
        pdf = pdf.sort_values("anchor", kind="stable")
        first = runs(pdf["anchor"].to_numpy())
        cuts = first[runs(first // BLOCK)]
        return pd.concat([late_of(pdf.iloc[a:b]) for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True)])

    def late_of(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, start = pdf["doc_id"].to_numpy(), pdf["start"].to_numpy().astype(np.int64)
        _, lcp, who, rem = collection_transform(pdf["part"].to_list(), size)
        kind = np.cumsum(lcp < size)
        full = rem >= size
        kind, who, rem = kind[full], who[full], rem[full]
        first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
        least = np.repeat(np.minimum.reduceat(doc[who], first), np.diff(np.r_[first, len(kind)])) if len(kind) else doc[:0]
        out = doc[who] > least
        length = pdf["part"].map(len).to_numpy()
        who, rem = who[out], rem[out]
        order = np.lexsort((-rem, who))  # a string's late windows from left to right; neighbours make one range
        who, rem = who[order], rem[order]
        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (rem[1:] != rem[:-1] - 1)]) if len(who) else who
        last = np.r_[first[1:], len(who)][: len(first)] - 1
        at = start[who] + length[who] - rem
        return pd.DataFrame({"doc_id": doc[who[first]], "start": at[first], "stop": at[last] + size})

    return late


def covered_bytes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, start, stop: ranges of bytes covered by strings of ``size`` bytes that also start in a document of smaller doc_id."""
    small_batches(docs.sparkSession)
    covered, rest = spans.shared_rows(_anchor_rows(docs, size), size, lambda named: _with_content(docs, named, size))
    counts = rest.groupBy("anchor").agg(F.count("*").alias("c"))
    rest = materialize(rest.join(counts.select("anchor", (F.col("c") > HOT).alias("hot")).hint("shuffle_hash"), "anchor"), "open")
    cold, hot = rest.filter("NOT hot").drop("hot"), rest.filter("hot").drop("hot")
    buckets = int(max(1, -(-cold.count() // BUCKET)))
    strings = _strings(docs, cold, size, False).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    late = materialize(strings.groupBy("bucket").applyInPandas(_late_windows(size), "doc_id long, start long, stop long"), "late")
    covered = covered.unionByName(late)
    if not hot.isEmpty():
        covered = covered.unionByName(_late_hot_windows(docs, hot, size))
    spans.drop_scratch(rest)
    return covered


def _late_hot_windows(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Ranges of the rows covered by windows that also start in a smaller document; a window costs one aggregated row."""
    windows = materialize(_strings(docs, rows, size, True).drop("anchor"), "windows")
    first = windows.groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    late = windows.join(first.hint("shuffle_hash"), "part").filter("doc_id > first").select("doc_id", "start", (F.col("start") + size).alias("stop"))
    late = materialize(late, "late")
    spans.drop_scratch(windows)
    return late


def _cut(text: str, starts: np.ndarray, stops: np.ndarray):
    raw = text.encode("utf-8", "surrogatepass")
    stops = np.minimum(stops, len(raw))
    at = [0, *stops.tolist()]
    kept = b"".join(raw[a:b] for a, b in zip(at, [*starts.tolist(), len(raw)], strict=True))
    return len(raw), len(raw) - len(kept), len(starts), spans.digest(kept)


def op4_columnwise_bwt_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: bytes of all ``documents`` covered by 50-byte strings of earlier documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans.finished(docs, covered_bytes(docs), _cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
