"""Connected components by alternating star contraction, without collecting nodes or edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import Scratch


SALTS = 8  # parts of a key's edges


def _salted(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """``edges`` with their key's minimum; a key's edges are spread over ``SALTS`` parts by their other end."""
    other = next(c for c in edges.columns if c != key)
    spread = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return spread.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``edges``.

    Each round sends a node's larger neighbours to its least neighbour, then its smaller ones; the
    number of rounds is logarithmic. A node's neighbours are reduced to their minimum by aggregates that
    combine before the shuffle; the edges of a node with many are then joined with that minimum in ``SALTS`` parts.
    Loops and null ends are ignored; repeated edges count once; no edges give no rows."""
    scratch = Scratch(edges.sparkSession)
    u, v = F.col(a), F.col(b)
    now = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct()
    now = scratch.write(now, "edges")
    before = None
    while True:
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("o")).union(now.select(F.col("lo").alias("n"), F.col("hi").alias("o")))
        least = both.groupBy("n").agg(F.least(F.min("o"), F.first("n")).alias("m"))
        large = _salted(both.where("o > n"), least, "n").select(F.col("o").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = _salted(large, low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(low.select("hi", F.col("m").alias("lo"))).distinct()
        new = scratch.write(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if state == before:
            break
        before = state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo"), F.col("lo"))).distinct()
