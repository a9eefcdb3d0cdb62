"""Near points where they crowd."""

import math

from pyspark.sql import functions as F

from tempora.functions import geo as g
from tempora.operators import spatial as sp


def test_pairs_of_dense_cells_are_told_once(spark):
    """Points crowd at the pole; cells of more than three are cut into parts."""
    points = spark.range(120).select(F.col("id").alias("k"), g.vec(90 - (F.col("id") * 7 % 120) * F.lit(0.5), F.col("id") * 37.0 % 360).alias("v"))
    want = {(r.a, r.b) for r in sp.within(points, math.radians(5)).collect()}
    got = [(r.a, r.b) for r in sp.pairs_within(points, math.radians(5), dense=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
