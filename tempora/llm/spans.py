"""What substring dedup by words and by bytes have in common.

Both remove what is covered by a window (``size`` consecutive units) that also starts in a document of smaller doc_id. Every window
names an anchor, a place inside it that depends on the window's content alone, so equal windows name equal anchors at equal
offsets. Neighbouring windows with the same anchor form one row, and all work goes by anchors:

* anchors seen in one document only are dropped (lossless);
* equal rows (anchor and content) are settled at once: all but those of the smallest document are covered;
* only rows of that smallest document whose anchor has several contents are left to compare window by window.

Nothing is listed in pairs, and a hot anchor costs one aggregated row for each distinct content. Contents are compared by two
independent 64-bit hashes: the anchor's, made from hashes of its parts, and xxh3 of all bytes of the row.

Rows of one doc_id with different texts are told apart: places count from a number that depends on the text (``lane``), in the high
half of a long. Windows that repeat under one doc_id stay, as no smaller doc_id has them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.words import small_batches
from tempora.plans.scratch import drop_scratch, materialize

ROWS = "anchor long, content long, doc_id long, start long, windows int"
LANE = 32  # bits of a place inside its text


def lane(text):
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), LANE + 1), LANE)


def known_texts(docs: DataFrame) -> DataFrame:
    """doc_id, lane, text of the rows that have a doc_id and a text."""
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", lane("text").alias("lane"), "text")


def _in_text(column: str):
    return F.col(column).bitwiseAND((1 << LANE) - 1)


def _lane_of(column: str):
    return F.shiftleft(F.shiftright(column, LANE), LANE)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose anchor stands in more than one document; the extremes of doc_id tell, and combine map-side.

    The names are the smaller side and unique, so they are hashed and the rows, many times as many, are not sorted.
    """
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    shared = materialize(shared, "names")
    kept = materialize(rows.join(shared.hint("shuffle_hash"), "anchor"), "shared")
    drop_scratch(shared)
    return kept


def shared_rows(rows: DataFrame, size: int, attach=None) -> tuple[DataFrame, DataFrame]:
    """From rows of ROWS: (covered: doc_id, start, stop) and (open: anchor, doc_id, start, windows), see above.

    With ``attach`` the rows come without ``content``; they are computed twice rather than stored, and ``attach`` turns those whose
    anchor is shared into rows of ROWS, which are narrowed again by the names it gives.
    """
    if attach is None:
        rows = materialize(rows, "anchors")
    else:
        named = _shared(rows)
        rows = materialize(attach(named), "anchors")
        drop_scratch(named)
    kept = _shared(rows)
    drop_scratch(rows)
    kinds = materialize(kept.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "kinds")
    many = kinds.groupBy("anchor").agg((F.count("*") > 1).alias("many"))
    open_kinds = kinds.join(many.hint("shuffle_hash"), "anchor").filter("many OR first < last")
    told = materialize(kept.join(open_kinds.select("anchor", "content", "first", "many").hint("shuffle_hash"), ["anchor", "content"]), "told")
    drop_scratch(kept)
    drop_scratch(kinds)
    covered = told.filter("doc_id > first").select("doc_id", "start", (F.col("start") + F.col("windows") - 1 + size).alias("stop"))
    return covered, told.filter("doc_id = first AND many").select("anchor", "doc_id", "start", "windows")


def with_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, lane, text, rows: the documents that have any of the rows, each with its list of them (bounded by its length)."""
    rows = rows.withColumn("lane", _lane_of("start")).withColumn("start", _in_text("start"))
    lists = rows.groupBy("doc_id", "lane").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("doc_id", "lane")])).alias("rows"))
    return known_texts(docs).dropDuplicates(["doc_id", "lane"]).join(lists, ["doc_id", "lane"])


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal runs in order."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]


def struct_lists(column) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and fields of a list<struct> Arrow column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    n = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
    return np.r_[0, np.cumsum(n)], {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}


def finished(docs: DataFrame, covered: DataFrame, cut, schema: str) -> DataFrame:
    """``cut(text, starts, stops)`` -> values of ``schema`` after doc_id, for every document with its merged covered intervals."""
    small_batches(docs.sparkSession)
    lists = covered.groupBy("doc_id", _lane_of("start").alias("lane")).agg(F.collect_set(F.struct(_in_text("start").alias("start"), _in_text("stop").alias("stop"))).alias("spans"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("lane", lane("text"))
    whole = whole.join(lists, ["doc_id", "lane"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            offsets, fields = struct_lists(b.column("spans"))
            out = []
            for k, text in enumerate(b.column("text").to_pylist()):
                lo, hi = offsets[k], offsets[k + 1]
                starts, stops = (fields[n][lo:hi].astype(np.int64) for n in ("start", "stop"))
                out.append(cut(text or "", *merged(starts, stops)))
            cols = [pa.array(x) for x in zip(*out, strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names)

    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]
    return whole.mapInArrow(run, f"doc_id long, {schema}")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
