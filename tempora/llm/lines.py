"""Line dedup by a deletion-neighbourhood join (DataFrame functions only).

A line goes if an earlier line (in order of doc_id, then line number) is equal or lies within one character edit of it. Equal
lines are one row with their first place; only distinct lines of ``near_chars`` and more are compared, as one edit turns most
shorter ones (numbers, names, list marks) into lines of another meaning.

1. Two lines one edit apart share their first or their second half, so lines that share neither with another line are done.
2. The others are cut into blocks of about the square root of their length. The edit lies in one block and all around it is
   equal; only blocks whose surroundings several lines share go on. This keeps a line of n characters at n^1.5 work.
3. Those blocks emit every variant within the bound as a hashed key: the block without character i, and the block itself. Lines
   meet on equal keys: without character i in both (a substitution), or without it in one only (an insertion). Each key
   aggregates the earliest line, so no pairs within a key are listed.
4. The edit distance to that earliest line is verified on the texts.

Defined results: null text has no lines; empty lines and those shorter than ``min_chars`` always stay; rows with a null doc_id neither
remove nor lose lines; rows of one doc_id with different texts follow one another in the order of their texts' hashes; rows that
repeat both doc_id and text are one document, so they get equal results; other columns are ignored; texts of any length are read
whole, a line at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.scratch import materialize

MIN_CHARS = 16  # of lines that go for one edit; equal ones go at any length
ID = ["h1", "h2"]


def _lines(docs: DataFrame) -> DataFrame:
    """Texts are hashed and split before lines become rows; beside the explosion the whole text would be hashed for each line."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("dk"), F.split("text", "\n", -1).alias("lines"))
    return texts.select("doc_id", "dk", F.posexplode("lines").alias("line_no", "line"))


def _flagged(numbers: DataFrame, name: str) -> DataFrame:
    """doc_id, dk and one boolean a line up to the last of ``numbers`` (doc_id, dk, line_no), so that a line is looked up in one step."""
    nos = numbers.groupBy("doc_id", "dk").agg(F.array_sort(F.collect_set("line_no")).alias("nos"))
    before = F.concat(F.array(F.lit(-1)), F.col("nos"))
    upto = F.zip_with("nos", before, lambda x, p: F.when(x.isNull(), F.array().cast("array<boolean>")).otherwise(F.concat(F.array_repeat(F.lit(False), x - p - 1), F.array(F.lit(True)))))
    return nos.select("doc_id", "dk", F.flatten(upto).alias(name))


def _halves(n, line):
    """Keys of both halves, once as the shorter or equal line of a pair and once as the longer one."""
    keys = []
    for back in (0, 1):
        m = n - back
        half = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit("a"), m, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit("b"), m, F.right(line, m - half))]
    return keys


def distinct_lines(docs: DataFrame, min_chars: int, near_chars: int) -> DataFrame:
    """h1, h2, place (of the first occurrence), halves (null below ``near_chars``) of every distinct line."""
    rows = _lines(docs).filter(F.col("doc_id").isNotNull() & (F.length("line") >= min_chars))
    rows = rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.struct("doc_id", "dk", "line_no").alias("place"),
                       F.when(F.length("line") >= near_chars, F.array(*_halves(F.length("line"), F.col("line")))).alias("halves"))
    return rows.groupBy(*ID).agg(F.min("place").alias("place"), F.first("halves").alias("halves"))


def _contexts(lines: DataFrame) -> DataFrame:
    """ctx, role, block text of every block of a line: e for equal lengths (a substitution), s and l for the shorter and longer line of an insertion."""
    out = []
    for role, kind, back, grow in (("e", "e", 0, 0), ("s", "i", 0, 1), ("l", "i", 1, 1)):
        m = F.col("n") - back
        step = F.ceil(F.sqrt(m)).cast("int")
        rows = lines.withColumn("m", m).withColumn("step", step)
        rows = rows.withColumn("b", F.explode(F.expr(f"sequence(0, cast(floor((m - 1 + {grow}) / step) as int))")))
        stop = F.least((F.col("b") + 1) * F.col("step"), F.col("m") + grow)  # block end in the longer line
        after = F.col("m") + grow - stop
        end = stop - 1 if role == "s" else stop
        at = F.col("b") * F.col("step")
        rows = rows.select(*ID, "place", F.lit(role).alias("role"),
                           F.xxhash64(F.lit(kind), "m", "b", F.substring("line", F.lit(1), at.cast("int")), F.right("line", after.cast("int"))).alias("ctx"),
                           F.substring(F.col("line"), (at + 1).cast("int"), (end - at).cast("int")).alias("part"))
        out.append(rows)
    return out[0].unionByName(out[1]).unionByName(out[2])


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line within one edit."""
    keys = lines.select(*ID, F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    wanted = keys.join(shared, "key").select(*ID).distinct()
    wanted = materialize(lines.select(*ID, "place").join(wanted, ID), "wanted")
    per_doc = _flagged(wanted.select("place.*"), "asked")
    texts = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("dk"), "text")
    texts = texts.join(per_doc.hint("merge"), ["doc_id", "dk"])  # one plan at every size
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    picked = texts.select("doc_id", F.explode(F.filter(numbered, lambda x: F.coalesce(F.get("asked", x["line_no"]), F.lit(False)))).alias("x"))
    picked = picked.select(F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(7), "x.line").alias("h2"), F.col("x.line").alias("line"), F.length("x.line").alias("n"))
    picked = materialize(wanted.join(picked, ID).dropDuplicates(ID), "picked")

    blocks = _contexts(picked)
    meet = (blocks.groupBy("ctx").agg(F.count_if(F.col("role") == "e").alias("e"), F.count_if(F.col("role") == "s").alias("s"), F.count_if(F.col("role") == "l").alias("l"))
            .filter("e > 1 OR (s > 0 AND l > 0)").select("ctx"))
    blocks = materialize(blocks.join(meet, "ctx"), "blocks")
    cut = F.col("role") != "s"
    variants = blocks.withColumn("i", F.explode(F.when(cut, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("part")))).otherwise(F.array(F.lit(0)))))
    less = F.concat(F.expr("substring(part, 1, i - 1)"), F.expr("substring(part, i + 1)"))
    variants = variants.select(*ID, "place", "role", F.when(F.col("role") == "e", F.xxhash64("ctx", "i", less))
                               .when(F.col("role") == "l", F.xxhash64("ctx", less)).otherwise(F.xxhash64("ctx", "part")).alias("v"))
    variants = materialize(variants, "variants")
    who = F.struct("place", *ID)
    least = variants.groupBy("v").agg(F.min(F.when(F.col("role") == "e", who)).alias("e"), F.min(F.when(F.col("role") == "s", who)).alias("s"),
                                      F.min(F.when(F.col("role") == "l", who)).alias("l"), F.count("*").alias("c")).filter("c > 1").drop("c")
    earlier = variants.join(least, "v").withColumn("first", F.when(F.col("role") == "e", F.col("e")).when(F.col("role") == "s", F.col("l")).otherwise(F.col("s")))
    # the key's earliest line of the other role; a line may be near under several keys, each is verified
    pairs = earlier.filter(F.col("first.place") < F.col("place")).select(*ID, F.col("first.h1").alias("e1"), F.col("first.h2").alias("e2")).distinct()
    mine = picked.select(*ID, "line")
    theirs = picked.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other"))
    return pairs.join(mine, ID).join(theirs, ["e1", "e2"]).filter(F.levenshtein("line", "other", 1) >= 0).select(*ID).distinct()


def staying_lines(docs: DataFrame, min_chars: int = 1, near_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, dk (hash of the text), stay (by line number, up to the last true one): first places of the texts that have no earlier neighbour."""
    lines = materialize(distinct_lines(docs, min_chars, near_chars), "lines")
    near = materialize(near_lines(docs, lines), "near")
    return _flagged(lines.join(near, ID, "left_anti").select("place.*"), "stay")


def dedup_lines(docs: DataFrame, min_chars: int = 1, near_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every row: the text without the lines that go."""
    min_chars = max(1, min_chars)
    stay = staying_lines(docs, min_chars, near_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    joined = rows.withColumn("dk", F.xxhash64("text")).join(stay.hint("merge"), ["doc_id", "dk"], "left").withColumn("lines", numbered)
    keep = F.filter("lines", lambda x: F.col("doc_id").isNull() | (F.length(x["line"]) < min_chars) | F.coalesce(F.get("stay", x["no"]), F.lit(False)))
    joined = joined.withColumn("kept", keep)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return joined.select("doc_id", F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("text"),
                         F.when(F.col("text").isNull(), 0).otherwise(n("lines")).cast("long").alias("n_lines"),
                         F.when(F.col("text").isNull(), 0).otherwise(n("lines") - n("kept")).cast("long").alias("n_removed"))


def op2_deletion_neighbourhood_lines(spark, sf_dir: str) -> DataFrame:
    """All lines of ``documents``: doc_id, n_lines, n_removed and the digest of what is kept."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
