"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating (a parameter), and share the words of all
documents by weight; a target stops at `most` times its source's size and the excess is shared again by weight among
the sources below their stop, until none is above.

Blocks: each source is cut into blocks by a keyed hash of its documents, which is its random permutation. A source
takes all of its blocks floor(target / size) times, and once more the first blocks of the permutation, and within the
block in which the target falls those documents, in order, that still fit, so that the target is met nearly. The
number of blocks follows the source's documents, so that no block is large, and only a table of block sizes is summed.

Shards: what a source gives is a list of drawn blocks: its taken blocks in the permutation's order, once for each whole
copy, then those of the last copy, the split one included. The lists' lengths are the quotas. The tree halves the list
of output shards again and again. At each node the exact quotas by source are split between the halves by one
multivariate-hypergeometric draw. A leaf's quotas are disjoint ranges of each source's list; the shard draws those and
shuffles its rows locally by a keyed hash. Blocks of which nothing is taken are in no list.

Driver state is one row for each source and shard-by-source quotas, never documents or blocks. All draws are keyed by
the seed and the documents' ids and texts' sizes, so reruns agree whatever the partitions.

Defined cases: a very long text is a row like others, and where it is larger than what its source is to give it isn't
taken, unless it comes nearer than nothing. A null or empty text has size 0 and is never taken. A null source is a source of its own, the last. Null
ids and repeated ids are rows like others; rows that are alike in id, source and size share their fate in the part of a
block, and are taken together. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaloom.llm.work import Tables, partitions

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3, 17
#: Documents that a block has on the average.
BLOCK_DOCS = 64
#: Output shards of a mix that isn't written out; mixed() has one for each shuffle partition.
SHARDS = 16


def size_of(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`, without an array of them."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "\x00")
    return F.char_length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """The words that each source shall give."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weigh = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, open_, out = dict(order), float(sum(n for _, n in order)), [s for s, _ in order], {}
    while open_:
        total = sum(weigh[s] for s in open_)
        share = {s: left * weigh[s] / total for s in open_}
        full = [s for s in open_ if share[s] > most * size[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """A row for each shard: how many blocks of each source it gets. Rows add up to the quotas, and shards' totals differ by one at most."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), np.int64)

    def split(have: np.ndarray, first: int, many: int) -> None:
        if many == 1:
            out[first] = have
            return
        half, total = many // 2, int(have.sum())
        take = total * half // many
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else np.zeros_like(have)
        split(left, first, half)
        split(have - left, first + half, many - half)

    split(quotas.astype(np.int64), 0, shards)
    return out


def fill(table: pa.Table) -> pa.Table:
    """Of the documents of one block, in order of lot, those that fit in the part that is to be taken, and then the one that comes nearest to what is still missing."""
    table = table.sort_by([("lot", "ascending"), ("size", "ascending"), ("id", "ascending")])
    part, left, taken = table.column("part")[0].as_py(), table.column("part")[0].as_py(), []
    words = [s * n for s, n in zip(table.column("size").to_pylist(), table.column("n").to_pylist(), strict=True)]
    for i, w in enumerate(words):
        if 0 < w <= left:
            taken.append(i)
            left -= w
    done = set(taken)
    over = [(w, i) for i, w in enumerate(words) if left < w < 2 * left and i not in done]
    if part > 0 and over:
        taken.append(min(over)[1])
    out = table.take(pa.array(sorted(taken), pa.int64()))
    return pa.table({"__s": out.column("source"), "__i": out.column("id"), "__z": out.column("size")})


class Mix:
    """What a mix takes of each document; rows() and shards() are its outputs."""

    def __init__(self, spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.tables = Tables(spark, "mix")
        ids = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))
        self.sized = self.tables.cut(ids)
        found = self.sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()  # a row for each source
        self.sizes = {r["source"]: int(r["size"]) for r in found}
        self.targets = targets(list(self.sizes.items()), weights, most)
        self.blocks = {r["source"]: max(1, math.ceil(r["docs"] / BLOCK_DOCS)) for r in found}
        self.order = sorted(self.sizes, key=lambda s: (s is None, s or ""))
        self.spark, self.seed = spark, seed
        plan = [(s, self.sizes[s], float(self.targets[s]), self.blocks[s], int(self.targets[s] // self.sizes[s]) if self.sizes[s] else 0) for s in self.order]
        self.plan = spark.createDataFrame(plan, "source string, source_size long, target double, blocks long, times long")
        self._choose()

    def _with_plan(self, rows: DataFrame) -> DataFrame:
        """rows with their source's part of the plan. The plan has a row for each source; Spark broadcasts it only below its own size threshold."""
        p = self.plan.withColumnRenamed("source", "__s")
        return rows.join(p, rows["source"].eqNullSafe(p["__s"]), "left").drop("__s")

    def _choose(self) -> None:
        lot = F.xxhash64(F.lit(self.seed), F.col("id").cast("string"), "source", "size")
        # The high bits of the lot say in which block a document is, in proportion, so blocks are runs of the permutation.
        block = F.shiftrightunsigned(F.shiftrightunsigned(lot, 33) * F.col("blocks"), 31)
        rows = self._with_plan(self.sized).withColumn("lot", lot).withColumn("block", block)
        sums = rows.groupBy("source", "block", "source_size", "target", "times").agg(F.sum("size").alias("words"))
        # Sums of blocks are added up in two steps, by runs of blocks and within them, so no window holds all blocks of a source.
        run = F.floor(F.col("block") / 1024)
        runs = sums.groupBy("source", run.alias("run")).agg(F.sum("words").alias("w"))
        before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select(F.col("source").alias("__s"), F.col("run").alias("__r"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("source", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("run", run).withColumn("inner", F.coalesce(F.sum("words").over(within), F.lit(0)))
        sums = sums.join(runs, sums["source"].eqNullSafe(runs["__s"]) & (sums["run"] == runs["__r"]))
        first = F.col("base") + F.col("inner")
        need = F.col("target") - F.col("times") * F.col("source_size")
        split = (first < need) & (first + F.col("words") > need)
        self.marked = self.tables.cut(sums.select("source", "block", "source_size", "target", "times", "words", first.alias("before"), F.when(split, need - first).alias("part"), (first + F.col("words") <= need).alias("whole")))
        # Only the one block of each source in which the target falls, some BLOCK_DOCS documents, is looked at by document.
        cut = self.marked.where("part IS NOT NULL").select(F.col("source").alias("__s"), F.col("block").alias("__b"), "part")
        inside = rows.join(cut, rows["source"].eqNullSafe(cut["__s"]) & (rows["block"] == cut["__b"]))
        alike = inside.groupBy("source", "lot", "id", "size", "part").agg(F.count(F.lit(1)).alias("n"))
        kind = inside.schema["id"].dataType.simpleString()
        chosen = alike.groupBy("source").applyInArrow(fill, f"__s string, __i {kind}, __z long")
        whole = self.marked.select(F.col("source").alias("__bs"), F.col("block").alias("__bb"), "whole", "part")
        out = rows.join(whole, rows["source"].eqNullSafe(whole["__bs"]) & (rows["block"] == whole["__bb"])).drop("__bs", "__bb")
        # A left join by columns that may be null; each chosen row matches once, as its key is unique.
        hit = out["source"].eqNullSafe(chosen["__s"]) & out["id"].eqNullSafe(chosen["__i"]) & (out["size"] == chosen["__z"])
        out = out.join(chosen, hit, "left").withColumn("more", F.when(F.col("size") == 0, 0).when(F.col("whole"), 1).when(F.col("part").isNotNull() & F.col("__z").isNotNull(), 1).otherwise(0))
        times = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("times") + F.col("more"))
        self.chosen = self.tables.cut(out.select("id", "source", "size", "source_size", "target", "block", "lot", F.col("times"), times.cast("int").alias("copies")))

    def rows(self) -> DataFrame:
        """A row for each document: id, source, size, source_size, target and taken, the words that the mix takes of it."""
        return self.chosen.select("id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))

    def quotas(self) -> tuple[DataFrame, list[tuple]]:
        """(source, block, base, extra): a taken block's number among those of each whole copy and of the last; and by source the lengths of both lists and the whole copies."""
        most = self.chosen.where("copies > 0").groupBy("source", "block", "times").agg(F.max("copies").alias("m"))
        units = self.tables.cut(most.select("source", "block", "times", F.when(F.col("times") > 0, 1).otherwise(0).alias("b"), F.when(F.col("m") > F.col("times"), 1).otherwise(0).alias("e"), F.floor(F.col("block") / 1024).alias("run")))
        # Numbers are counted in two steps, as in _choose().
        before = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
        runs = units.groupBy(F.col("source").alias("__s"), F.col("run").alias("__r")).agg(F.sum("b").alias("b"), F.sum("e").alias("e"))
        runs = runs.select("__s", "__r", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in "be"))
        within = Window.partitionBy("source", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        inner = units.select("source", "block", "run", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in "be"))
        inner = inner.join(runs, inner["source"].eqNullSafe(runs["__s"]) & (inner["run"] == runs["__r"]))
        totals = units.groupBy("source").agg(F.sum("b").alias("b"), F.sum("e").alias("e"), F.max("times").alias("times")).collect()  # a row for each source
        return inner.select("source", "block", (F.col("b") + F.col("__b")).alias("base"), (F.col("e") + F.col("__e")).alias("extra")), [(r["source"], r["b"], r["e"], r["times"]) for r in totals]

    def dealt(self, shards: int = SHARDS) -> DataFrame:
        """The chosen rows with shards array<int> and places array<long>: the shard of each copy that is taken, and its place in the order of that shard."""
        numbers, totals = self.quotas()
        totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
        ends = np.cumsum(split_tree(np.array([b * t + e for _, b, e, t in totals], np.int64), shards, self.seed), axis=0)
        bounds = self.spark.createDataFrame([(s, [int(e) for e in ends[:, i]], b) for i, (s, b, _, _) in enumerate(totals)], "__s string, __ends array<long>, __many long")
        numbers = numbers.join(bounds, numbers["source"].eqNullSafe(bounds["__s"])).select(F.col("source").alias("__s"), F.col("block").alias("__b"), "base", "extra", "__ends", "__many")
        rows = self.chosen.join(numbers, self.chosen["source"].eqNullSafe(numbers["__s"]) & (self.chosen["block"] == numbers["__b"]), "left")
        copy = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))
        # Shard k has the numbers of a source's list between the k-th ends.
        number = lambda c: F.when(c <= F.col("times"), (c - 1) * F.col("__many") + F.col("base")).otherwise(F.col("times") * F.col("__many") + F.col("extra"))
        shard = F.transform(copy, lambda c: F.size(F.filter("__ends", lambda e: e <= number(c))).cast("int"))
        place = F.transform(copy, lambda c: F.xxhash64(F.lit(self.seed + 1), "lot", c))
        return rows.select(*self.chosen.columns, shard.alias("shards"), place.alias("places"))

    def taken(self, docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """docs as the mix takes them, a row for each copy, dealt to shards and in the order of each; with __shard, __place and __copy."""
        picks = self.dealt(shards).where("copies > 0").select(F.col("id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.arrays_zip("shards", "places").alias("__dealt")).distinct()
        sized = docs.withColumn("__size", size_of(F.col(text_col)))
        on = sized[id_col].eqNullSafe(picks["__i"]) & sized[source_col].cast("string").eqNullSafe(picks["__s"]) & (sized["__size"] == picks["__z"])
        out = sized.join(picks, on).select(*[sized[c] for c in docs.columns], F.posexplode("__dealt").alias("__copy", "__at"))
        out = out.select(*docs.columns, (F.col("__copy") + 1).alias("__copy"), F.col("__at.shards").alias("__shard"), F.col("__at.places").alias("__place"))
        return out.repartition(shards, "__shard").sortWithinPartitions("__shard", "__place", "__copy")

    def shards(self, docs: DataFrame, shards: int, **columns: str) -> DataFrame:
        """docs as the mix takes them, a row for each copy, with shard int and place long, the row's order within the shard."""
        out = self.taken(docs, shards, **columns)
        return out.select(*[c for c in docs.columns if c not in ("copy", "shard", "place")], F.col("__copy").alias("copy"), F.col("__shard").alias("shard"), F.col("__place").alias("place"))


def mixed(spark: SparkSession, docs: DataFrame, **named) -> DataFrame:
    """docs as the mix takes them: a row for each copy, in docs' own columns, dealt to as many shards as there are shuffle partitions and in the order of each."""
    columns = {c: named[c] for c in ("id_col", "text_col", "source_col") if c in named}
    return Mix(spark, docs, **named).taken(docs, partitions(spark), **columns).select(*docs.columns)
