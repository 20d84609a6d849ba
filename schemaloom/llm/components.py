"""Connected components: in numpy within a task, and distributed over a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.work import Tables, partitions


class Groups:
    """Union-find over 0 .. n - 1 by arrays; the least number of a group stands for it."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, i: np.ndarray) -> np.ndarray:
        out = self.up[i]
        while True:
            higher = self.up[out]
            if np.array_equal(higher, out):
                return out
            out = higher

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.top(i), self.top(j)
            differ = a != b
            if not differ.any():
                return
            a, b, i, j = a[differ], b[differ], i[differ], j[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def tops(self) -> np.ndarray:
        self.up = self.top(np.arange(len(self.up)))
        return self.up


#: Rows that one key may bring into a task of a join, at least; beyond it and its share of the rows a key counts as heavy.
LIGHT = 256


def heavy_keys(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """(h): the keys, of rows (key, n), that have more than their share of the total; so fewer than there are partitions. None if there are none."""
    spark = counts.sparkSession
    most = max(LIGHT, total // partitions(spark))
    found = counts.where(F.col("n") > most).select(F.col(key).cast("long")).collect() if total > most else []
    return spark.createDataFrame([(r[0],) for r in found], "h long") if found else None


def looked_up(rows: DataFrame, key: str, other: str, found: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """rows with `m` of found (k, m), null where there is none; keys of found are unique.

    Rows of heavy keys take theirs from a broadcast, which has a row for each heavy key at most, and are spread by
    the hash of the other column; so no key's rows meet in one task.
    """
    if heavy is None:
        return rows.join(found, rows[key] == found["k"], "left").drop("k")
    few = heavy.join(found, heavy["h"] == found["k"], "left").select("h", F.col("m").alias("__m"))
    marked = rows.join(F.broadcast(few), rows[key] == few["h"], "left")
    marked = marked.withColumn("__at", F.when(F.col("h").isNull(), F.col(key)).otherwise(F.col(other))).withColumn("__light", F.col("h").isNull())
    right = found.withColumn("__one", F.lit(True))
    out = marked.join(right, (marked["__at"] == right["k"]) & (marked["__light"] == right["__one"]), "left")
    return out.select(*rows.columns, F.when(F.col("__light"), F.col("m")).otherwise(F.col("__m")).alias("m"))


def downward(links: DataFrame) -> DataFrame:
    """Each link (u, v) once, from the larger node to the smaller; none from a node to itself."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def connected(tables: Tables, links: DataFrame, ready: bool = False) -> DataFrame:
    """(node, component): the least node that each node of links (u, v) reaches, for nodes that have a link.

    Alternates the large-star and small-star steps (Kiveris and others, "Connected Components in MapReduce and Beyond",
    2014) till nothing changes. Links point from the larger node u to the smaller v. Large-star sends u to the least
    neighbour of v, small-star sends u and its neighbours to the least of these. A step takes a minimum for each node,
    which is combined before the shuffle, and looks it up for the links; links of heavy nodes are spread. Nodes with
    more than 1 / partitions of the links are heavy, so there are at most twice as many as partitions. Each round is
    written to the shared folder. ready: links are a table of tables.cut() made by downward(), which stays.
    """
    tell = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = first = links if ready else tables.cut(downward(links))
    seen = tell(now)
    while seen[0]:
        heavy = {end: heavy_keys(now.groupBy(end).agg(F.count(F.lit(1)).alias("n")), end, seen[0]) for end in "uv"}
        least = now.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = looked_up(now, "v", "u", least, heavy["v"]).select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = looked_up(large, "u", "v", least, heavy["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct()
        past, now = now, tables.cut(small, seen[0])
        found = tell(now)
        if past is not first or not ready:
            tables.drop(past)
        if found == seen:
            break
        seen = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
