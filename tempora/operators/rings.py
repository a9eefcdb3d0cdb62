"""Rings and polylines as vertex rows in sequence: cleaning, canonical form, shared arcs, clipping, splitting, simplifying."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import geo as g
from tempora.functions.sets import set_text
from tempora.plans.scratch import drop_scratch, materialize


def vertex_text(y="qlat", x="qlon"):
    return F.concat_ws(":", F.col(y), F.col(x))


def cleaned(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Without repeats of the vertex before and without a last vertex equal to the first; ``n`` vertices are left."""
    w = Window.partitionBy(key).orderBy("seq")
    here = F.struct(*cols)
    rows = rows.withColumn("_same", F.lag(here).over(w).eqNullSafe(here)).filter(~F.col("_same")).drop("_same")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_first", F.first(here).over(every)).withColumn("_last", F.max("seq").over(every)).withColumn("_n", F.count("*").over(every))
    rows = rows.filter(~((F.col("seq") == F.col("_last")) & (F.col("_n") > 1) & (here == F.col("_first"))))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(key))).drop("_first", "_last", "_n")


def canonical_text(vertices) -> F.Column:
    """A ring's vertex list, from its least vertex, in the direction whose text is less."""
    def turned(a):
        at = F.array_position(a, F.array_min(a)).cast("int")
        return F.array_join(F.concat(F.slice(a, at, F.size(a)), F.slice(a, 1, at - 1)), " ")

    return F.least(turned(vertices), turned(F.reverse(vertices)))


def ring_lists(rows: DataFrame, key: str = "rid", text=None) -> DataFrame:
    """key, vs: the ordered vertex texts of each ring."""
    item = F.struct("seq", (text if text is not None else vertex_text()).alias("t"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]).alias("vs"))


def by_shape(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shapes: the rings (rid, seq, qlat, qlon), of those whose vertices are equal in order only the one of least rid; members: shape, rid
    of every ring). What depends on a ring's place alone is found for shapes and told for members last, so no pairs of copies are shuffled."""
    item = F.struct("seq", "qlat", "qlon")
    vs = rows.groupBy("rid").agg(F.sort_array(F.collect_list(item)).alias("vs")).select("rid", F.sha2(F.concat_ws(" ", *[F.col(f"vs.{c}").cast("string") for c in ("qlat", "qlon")]), 256).alias("vs"))
    vs = materialize(vs, "vs")
    members = materialize(vs.join(vs.groupBy("vs").agg(F.min("rid").alias("shape")), "vs").select("shape", "rid"), "members")
    return materialize(rows.join(members.filter("shape = rid").select("rid"), "rid"), "shapes"), members


def told(found: DataFrame, members: DataFrame, *names: str) -> DataFrame:
    """``found`` with every member in place of the shape in each of the named columns."""
    for name in names:
        found = found.join(members.select(F.col("shape").alias(name), F.col("rid").alias("_rid")), name).drop(name).withColumnRenamed("_rid", name)
    return found


def edge_users(edges: DataFrame) -> DataFrame:
    """a, b (least first), users: the rings that use each undirected edge."""
    a, b = F.concat_ws(":", "ay", "ax"), F.concat_ws(":", "by_", "bx")
    return edges.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(set_text("rid").alias("users"))


def shared_arcs(edges: DataFrame) -> DataFrame:
    """rid, seq, ay, ax, arc, users: each edge with the number of its arc, the cyclic run of edges with equal users, whose digest stands
    for them: an edge has as many users as rings lie alike, so their lists would grow with the square of the copies."""
    a, b = F.concat_ws(":", "ay", "ax"), F.concat_ws(":", "by_", "bx")
    users = edge_users(edges).withColumn("users", F.sha2("users", 256))
    e = edges.withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b)).join(users, ["a", "b"])
    w = Window.partitionBy("rid").orderBy("seq")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = e.withColumn("cut", (~F.lag("users").over(w).eqNullSafe(F.col("users"))).cast("int"))
    e = e.withColumn("run", F.sum("cut").over(w)).withColumn("runs", F.sum("cut").over(Window.partitionBy("rid")))
    closes = (F.first("users").over(every) == F.last("users").over(every)) & (F.col("runs") > 1)
    return e.withColumn("arc", F.when(closes & (F.col("run") == F.col("runs")), 1).otherwise(F.col("run"))).select("rid", "seq", "ay", "ax", "arc", "users")


def stored_arcs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs: arc_id, vs; uses: rid, arc_id, forward). Each arc is stored once, in the direction whose text is less, whoever uses it."""
    users = shared_arcs(edges).select("rid", "seq", "arc").join(edges, ["rid", "seq"])
    item = F.struct("seq", vertex_text("ay", "ax").alias("a"), vertex_text("by_", "bx").alias("b"))
    runs = users.groupBy("rid", "arc").agg(F.array_sort(F.collect_list(item)).alias("s"))
    # an arc across the ring's first vertex begins after the gap in its sequence
    gap = F.expr("filter(sequence(1, size(s)), i -> i > 1 AND s[i - 1].seq - s[i - 2].seq > 1)")
    first = F.coalesce(F.get(gap, F.lit(0)), F.lit(1))
    runs = runs.withColumn("s", F.concat(F.slice("s", first, F.size("s")), F.slice("s", 1, first - 1)))
    vs = F.concat(F.transform("s", lambda x: x["a"]), F.array(F.element_at("s", -1)["b"]))
    runs = runs.select("rid", vs.alias("vs"), F.array_join(vs, " ").alias("there"), F.array_join(F.reverse(vs), " ").alias("back"))
    runs = runs.withColumn("arc_id", F.sha2(F.least("there", "back"), 256)).withColumn("forward", F.col("there") <= F.col("back"))
    arcs = runs.groupBy("arc_id").agg(F.first(F.when(F.col("forward"), F.col("vs")).otherwise(F.reverse("vs"))).alias("vs"))
    return arcs, runs.select("rid", "arc_id", "forward")


def rebuilt(arcs: DataFrame, uses: DataFrame) -> DataFrame:
    """rid, vs: rings put together from oriented arcs, each beginning where the one before ends; shared joints stand once.

    A ring whose arcs don't close keeps what hangs together from its least arc on.
    """
    turned = uses.join(arcs, "arc_id").withColumn("vs", F.when(F.col("forward"), F.col("vs")).otherwise(F.reverse("vs")))
    parts = turned.groupBy("rid").agg(F.array_sort(F.collect_list("vs")).alias("p"))
    chain = F.expr("""aggregate(slice(p, 2, size(p)), p[0], (acc, x) -> coalesce(
        concat(acc, slice(get(filter(p, a -> a[0] = element_at(acc, -1) AND acc[0] <> element_at(acc, -1)), 0), 2, 1000000000)), acc))""")
    whole = parts.withColumn("vs", chain)
    closed = F.col("vs")[0] == F.element_at("vs", -1)
    return whole.select("rid", F.when(closed, F.slice("vs", 1, F.size("vs") - 1)).otherwise(F.col("vs")).alias("vs"))


def clipped(rows: DataFrame, key: str, y0: float, y1: float, x0: float, x1: float) -> DataFrame:
    """Rings cut to a rectangle: four half-plane passes over edges."""
    for axis, bound, side in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        w = Window.partitionBy(key).orderBy("seq")
        first = F.first(F.struct("y", "x")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        e = rows.withColumn("n", F.coalesce(F.lead(F.struct("y", "x")).over(w), first))
        a, b = F.col(axis), F.col(f"n.{axis}")
        ina, inb = (a - bound) * side >= 0, (b - bound) * side >= 0
        t = (F.lit(bound) - a) / F.when(a == b, F.lit(1.0)).otherwise(b - a)
        cut = F.struct((F.col("y") + t * (F.col("n.y") - F.col("y"))).alias("y"), (F.col("x") + t * (F.col("n.x") - F.col("x"))).alias("x"))
        out = F.array(F.when(ina != inb, cut), F.when(inb, F.col("n")))
        rows = (e.select(key, "seq", F.posexplode(out).alias("p", "v")).filter("v IS NOT NULL")
                .select(key, F.row_number().over(Window.partitionBy(key).orderBy("seq", "p")).cast("long").alias("seq"), "v.y", "v.x"))
    return rows


SHORT = 20_000  # vertices of a line that one task simplifies by itself


POINTS = 200_000  # vertices of lines that are simplified side by side, more only where one line has more


def _kept(offsets: np.ndarray, v: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of lines stay. All open segments of all lines split in the same round, at the lowest of their farthest vertices."""
    keep = np.zeros(len(v), bool)
    a, b = offsets[:-1], offsets[1:] - 1
    some = a <= b
    a, b = a[some], b[some]
    keep[a] = keep[b] = True
    while True:
        wide = b - a > 1
        a, b = a[wide], b[wide]
        if not len(a):
            return keep
        inner = b - a - 1
        first = np.cumsum(inner) - inner
        segment = np.repeat(np.arange(len(a)), inner)
        at = np.arange(len(segment)) + (a + 1 - first)[segment]
        d = distances_to_arcs(v[at], v[a], v[b], segment)
        top = np.maximum.reduceat(d, first)
        far = top > tolerance
        best = np.flatnonzero((d == top[segment]) & far[segment])
        m = at[best[np.r_[True, segment[best][1:] != segment[best][:-1]]]] if len(best) else at[:0]
        keep[m] = True
        a, b = np.r_[a[far], m], np.r_[m, b[far]]


def _simplify_lines(key: str, tolerance: float):
    """For batches of lines (key, line: a list of seq, x, y, z in order)."""

    def run(batches):
        for batch in batches:
            lines = batch.column("line")
            offsets = lines.offsets.to_numpy().astype(np.int64)
            offsets, flat = offsets - offsets[0], lines.flatten()
            v = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
            cuts = np.flatnonzero(np.r_[True, np.diff(offsets[:-1] // POINTS) > 0])
            keep = np.concatenate([_kept(offsets[i:j + 1] - offsets[i], v[offsets[i]:offsets[j]], tolerance) for i, j in zip(cuts, [*cuts[1:], len(lines)], strict=True)]) if len(lines) else np.zeros(0, bool)
            who = np.repeat(np.arange(len(lines)), np.diff(offsets))[keep]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(who)), flat.field("seq").filter(pa.array(keep))], [key, "seq"])

    return run


def _simplify_inner(key: str, tolerance: float):
    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        """What stays of a segment's inner vertices; its ends come with each of them."""
        one = pdf.iloc[0]
        ends = pd.DataFrame([{key: one[key], "seq": one[s], **{c: one["v" + s][c] for c in "xyz"}} for s in ("a", "b")])
        line = pd.concat([pdf[[key, "seq", "x", "y", "z"]], ends]).sort_values("seq")
        out = line.loc[_kept(np.array([0, len(line)]), line[["x", "y", "z"]].to_numpy(), tolerance), [key, "seq"]]
        return out[(out["seq"] > one["a"]) & (out["seq"] < one["b"])]

    return kept


def resampled(lines: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """(key, i, v): each line (key, seq, v) at as many points (key, n) in equal steps along its length, ends included.

    A line without length has its first point n times, a single point stays one.
    """
    w = Window.partitionBy(key).orderBy("seq")
    legs = lines.select(key, "seq", "v", F.lead("v").over(w).alias("nv"), F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy(key)).alias("m"))
    legs = legs.filter("nv IS NOT NULL OR m = 1").withColumn("len", F.when(F.col("nv").isNull(), 0.0).otherwise(g.angle(F.col("v"), F.col("nv"))))
    legs = legs.withColumn("c1", F.sum("len").over(w)).withColumn("c0", F.coalesce(F.lag("c1").over(w), F.lit(0.0))).withColumn("total", F.max("c1").over(Window.partitionBy(key)))
    legs = legs.join(counts.select(key, "n"), key)
    place = lambda c: F.floor(F.col(c) / F.col("total") * (F.col("n") - 1))
    last = F.when(F.col("m") == 1, F.lit(0)).when(F.col("total") > 0, place("c1")).otherwise(F.col("n") - 1).cast("long")
    first = F.when(F.col("rn") == 1, F.lit(0)).when(F.col("total") > 0, place("c0") + 1).otherwise(F.col("n")).cast("long")
    legs = legs.withColumn("lo", first).withColumn("hi", last).filter("hi >= lo").withColumn("i", F.explode(F.sequence("lo", "hi")))
    t = F.when(F.col("len") > 0, g.clamp((F.col("total") * F.col("i") / (F.col("n") - 1) - F.col("c0")) / F.col("len"), 0.0, 1.0)).otherwise(0.0)
    return legs.withColumn("t", t).select(key, "i", F.coalesce(F.when(F.col("t") > 0, g.slerp(F.col("v"), F.col("nv"), F.col("t"))), F.col("v")).alias("v"))


def distances_to_arcs(p: np.ndarray, a: np.ndarray, b: np.ndarray, arc: np.ndarray) -> np.ndarray:
    """Angular distances of points from the arcs (a, b), of which each is told its own."""
    dot = lambda u, w: u[:, 0] * w[:, 0] + u[:, 1] * w[:, 1] + u[:, 2] * w[:, 2]
    angles = lambda w: np.arccos(np.clip(dot(p, w[arc]), -1, 1))
    n = np.cross(a, b)
    size = np.linalg.norm(n, axis=1)
    plain = size > 1e-15
    n = n / np.where(plain, size, 1.0)[:, None]
    inside = plain[arc] & (dot(p, np.cross(n, a)[arc]) >= 0) & (dot(p, np.cross(b, n)[arc]) >= 0)
    return np.where(inside, np.abs(np.arcsin(np.clip(dot(p, n[arc]), -1, 1))), np.minimum(angles(a), angles(b)))


def simplified(rows: DataFrame, key: str, tolerance: float, short: int = SHORT) -> DataFrame:
    """(key, seq) that spherical Douglas-Peucker keeps of rows (key, seq, v).

    Short lines are done whole in a task. Longer ones go by rounds, in each of which every open segment splits at its farthest
    vertex (the lowest of equal ones); a split depends on its segment's ends alone, so rounds keep what the recursion keeps. They go
    on until no segment is open; segments that have become short leave them for a task.
    """
    size = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct("seq", "v")).alias("_a"), F.max(F.struct("seq", "v")).alias("_b"))
    rows = rows.join(size, key)
    flat = rows.filter(F.col("_n") <= short).select(key, F.col("seq").cast("long").alias("seq"), "v.x", "v.y", "v.z")
    kind = dict(flat.dtypes)[key]
    lines = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("line"))
    done = lines.mapInArrow(_simplify_lines(key, tolerance), f"{key} {kind}, seq long")
    long_ = materialize(rows.filter(F.col("_n") > short).select(key, F.col("seq").cast("long").alias("seq"), "v", F.col("_a.seq").alias("a"), F.col("_b.seq").alias("b"), F.col("_a.v").alias("va"), F.col("_b.v").alias("vb")), "line")
    if long_.isEmpty():
        return done
    kept = long_.filter("seq = a OR seq = b").select(key, "seq")
    state = long_.filter("seq > a AND seq < b")
    old = []
    while True:
        far = state.groupBy(key, "a", "b").agg(F.max(F.struct(g.to_arc(F.col("v"), F.col("va"), F.col("vb")).alias("d"), (-F.col("seq")).alias("s"), F.col("v").alias("v"))).alias("m"))
        far = far.filter(F.col("m.d") > tolerance).select(key, "a", "b", (-F.col("m.s")).alias("c"), F.col("m.v").alias("vc"))
        new = materialize(state.join(far, [key, "a", "b"]), "split")
        if new.isEmpty():
            break
        old.append(new)
        kept = kept.union(new.filter("seq = c").select(key, "seq"))
        first = F.col("seq") < F.col("c")
        state = new.filter("seq <> c").select(key, "seq", "v", F.when(first, F.col("a")).otherwise(F.col("c")).alias("a"), F.when(first, F.col("c")).otherwise(F.col("b")).alias("b"),
                                              F.when(first, F.col("va")).otherwise(F.col("vc")).alias("va"), F.when(first, F.col("vc")).otherwise(F.col("vb")).alias("vb"))
        n = state.groupBy(key, "a", "b").agg((F.count("*") + 2 <= short).alias("_short"))
        if not n.filter("_short").isEmpty():
            state = materialize(state.join(n, [key, "a", "b"]), "state")
            old.append(state)
            part = state.filter("_short").select(key, "a", "b", "seq", "v.x", "v.y", "v.z", "va", "vb")
            kept = kept.union(part.groupBy(key, "a", "b").applyInPandas(_simplify_inner(key, tolerance), f"{key} {kind}, seq long"))
            state = state.filter("NOT _short").drop("_short")
        if len(old) >= 20:  # keeps the plan and the files few
            kept, state = materialize(kept, "kept"), materialize(state, "state")
            for x in old:
                drop_scratch(x)
            old = [kept, state]
    return done.unionByName(kept)
