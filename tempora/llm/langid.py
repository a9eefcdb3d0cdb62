"""Language identification by cross-parsing entropy.

A suffix automaton is built from labelled text of each language. A text is cut greedily into the longest phrases that occur in
that language's training text (the Ziv-Merhav cross parsing: walk the automaton, start a new phrase where it has no way on). The
language that needs the fewest phrases, each weighing log2 of its training length, wins.

The classifier is fitted on a bounded sample: at most ``docs_per_lang`` learnable rows of each language, ``chars_per_doc`` of each
and ``total_chars`` over all languages; a language of many letters gets less text, so that the tables of all languages stay below
``CELLS`` entries. Every language has an alphabet of its own (its ``LETTERS`` commonest, any script).

Every text is scored whole. Long texts are parsed in lanes of ``BLOCK`` characters side by side. A lane starts ``WARM`` characters
early and counts only the phrases that end inside its block: two greedy parses that once share a phrase start are the same from
there on, so phrases run across blocks, and a block whose parse has not met the whole text's after ``WARM`` characters is off by
one phrase at most.

Defined results: null texts and texts without a letter get ``und`` and score 0; without any learnable row all texts do; ties go to
the alphabetically first language; repeated rows get the same answer; rows of one doc_id with different texts are judged by their
texts; lang, source and doc_id never enter a score; ``recognised`` keeps every column as it is, whatever its name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tempora.llm.words import small_batches

BLOCK, WARM = 512, 64  # characters of a lane, and those before it that it starts with
SLICE = 1 << 19  # characters a worker holds as lanes at a time
LETTERS = 250  # letters of a language with a class of their own; its other letters share one
CELLS = 20_000_000  # entries of all transition tables
_KINDS = np.zeros(0, np.uint8)


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _KINDS
    if not len(_KINDS):
        _KINDS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    return _KINDS


class CrossParser:
    """Dense transition tables of one suffix automaton a language."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.classes, self.tables, self.widths, self.weights = [], [], [], []
        for k in self.langs:
            low = texts[k].lower()
            common = [c for c, _ in sorted(Counter(c for c in low if c.isalpha()).items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
            width = len(common) + 3  # 0: no letter, 1: other letter, then the common ones, last: padding
            low = low[:max(1000, CELLS // (2 * len(texts) * width))]
            classes = _letters().copy()
            for n, c in enumerate(common):
                for form in (c, c.upper()):
                    if len(form) == 1:
                        classes[ord(form)] = n + 2
            self.classes.append(classes)
            self.widths.append(width)
            self.weights.append(math.log2(max(2, len(low))))
            self.tables.append(self._table(classes[np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)].tolist(), width))

    @staticmethod
    def _table(codes: list[int], w: int) -> np.ndarray:
        """next[state * width + class]: the next state times width, or ~(the state after a fresh start) where the phrase ends."""
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in codes:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = twin
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
            last = cur
        stray = len(nxt)  # stray: an open phrase of one character that the training text lacks
        fresh = np.full(w, stray * w, np.int32)
        for c, s in nxt[0].items():
            fresh[c] = s * w
        table = np.tile(~fresh, (stray + 1, 1))
        table[0] = fresh
        rows = np.repeat(np.arange(stray), [len(x) for x in nxt])
        table[rows, np.fromiter((c for x in nxt for c in x), np.int64, len(rows))] = np.fromiter((s * w for x in nxt for s in x.values()), np.int64, len(rows))
        table[:, w - 1] = np.arange(stray + 1) * w
        return table.ravel()

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) weighted phrase counts, and which texts have a letter."""
        n = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), n)
        letters = np.bincount(doc[_letters()[points] > 0], minlength=len(texts)) > 0
        lanes = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(texts)), lanes)
        begin = np.cumsum(n) - n
        lane = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first, last = begin[owner] + lane * BLOCK - WARM, (begin + n)[owner]
        out = np.zeros((len(texts), len(self.langs)))
        for k, table in enumerate(self.tables):
            codes = self.classes[k][points]
            pad = self.widths[k] - 1
            state, count = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for step in range(BLOCK + WARM):
                at = first + step
                # before the text: nothing; after it: padding, which leaves every state as it is
                code = np.where((at >= begin[owner]) & (at < last), codes.take(at, mode="clip"), pad)
                to = table.take(code + state)
                over = to >> 31
                if step >= WARM:
                    count -= over
                state = to ^ over
            ends = first + WARM + BLOCK >= last  # the open phrase of a text's last lane
            out[:, k] = np.bincount(owner, count + ((state != 0) & ends), minlength=len(texts)) * self.weights[k]
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [t or "" for t in texts]
        langs, scores = [], []
        for part in _slices(known):
            cost, letters = self.costs(part)
            best = cost.argmin(1) if len(self.langs) else np.zeros(len(part), int)
            two = np.sort(cost, 1)[:, :2]
            for i in range(len(part)):
                if not letters[i] or not self.langs:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    langs.append(self.langs[best[i]])
                    scores.append(float(two[i, 1] / two[i].sum()) if len(self.langs) > 1 else 1.0)
        return langs, scores


def _slices(texts: list[str]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def training_texts(docs: DataFrame, learn, docs_per_lang: int = 400, chars_per_doc: int = 1000, total_chars: int = 200_000) -> dict[str, str]:
    """The bounded sample: for each language the learnable rows of the lowest hashes."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit("langid"), "doc_id", "text").alias("h"), F.substring("text", 1, chars_per_doc).alias("piece"))
    top = lowest(rows, "lang", docs_per_lang)
    found: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "h", "piece").collect():  # docs_per_lang x languages x chars_per_doc at most
        found.setdefault(r.lang, []).append(r.piece)
    each = total_chars // max(1, len(found))
    return {k: "\n".join(v)[:each] for k, v in found.items()}


def lowest(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of lowest hash ``h`` of each key. Few others are shuffled: a cut-off from the counts goes first."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))  # one row a language or label
    near = (rows.join(F.broadcast(counts), key)
            .filter(F.pmod("h", F.lit(1 << 40)) < F.lit(4.0 * most) / F.col("_n") * F.lit(float(1 << 40))).drop("_n"))
    order = Window.partitionBy(key).orderBy(F.pmod("h", F.lit(1 << 40)), *[c for c in rows.columns if c != key])
    return near.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).drop("_rn")


def identify(docs: DataFrame, texts: dict[str, str], keep: tuple[str, ...] = ("doc_id",), answer: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with the language and its score, from the training texts of each language."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches):
        parser = CrossParser(shared.value)  # for this task only
        for b in batches:
            cols = b.columns
            langs, scores = parser.predict(cols[-1].to_pylist())
            yield pa.RecordBatch.from_arrays([*cols[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    rows = docs.select(*keep, F.col("text").cast("string").alias("_" * (1 + max([0, *map(len, keep)]))))  # longer than any name there
    out = StructType([*rows.schema.fields[:-1], StructField(answer[0], StringType()), StructField(answer[1], DoubleType())])
    names = out.names
    return rows.mapInArrow(run, out)


def recognised(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told (null texts and texts without a letter); learned from its own lang."""
    answer = ("_lang", "_score")
    while set(answer) & set(docs.columns):
        answer = tuple(x + "_" for x in answer)
    return identify(docs, training_texts(docs, F.lit(True)), tuple(docs.columns), answer).filter(F.col(answer[0]) != "und").select(*docs.columns)


def held_out(modulus: int, remainder: int):
    """Whether crc32 of doc_id as text leaves this remainder (null doc_id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op10_cross_parsing_language(spark, sf_dir: str) -> DataFrame:
    """Contract query: the language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, training_texts(docs, ~held_out(4, 2)))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
