"""Near-copies among embeddings by sorted projection passes.

Vectors with equal components become one class first. In each pass a vector's key is the concatenation of the signs of
its projections on random directions of that pass; the classes are sorted by key, and each is compared by cosine in
double precision with the `window` next ones. Close vectors share long beginnings of keys, so over the passes they meet
in some window; the verified pairs of all passes are united into components.

A pass sorts by range partitions. Each task compares within its partition and reports a spanning forest of what it
linked, and its first and last `window` rows; a second, small step compares these rows across the borders.

The number of passes follows the number of classes, so that a pair at the limit meets in some pass with probability
`recall` if directions are spread evenly: n classes share k = log2(n / window) bits by chance as often as a window
holds, and a pair at angle a shares k bits with probability (1 - a / pi) ** k. Where vectors crowd, passes find less;
so links are captured twice, by the even passes and by the odd ones, and as long as the overlap of the two says that
more than 1 - `recall` of the linked classes are missing, as many passes are added, up to `rounds` times.

Links are then counted exactly: within each component all pairs of classes are compared in tiles of bounded size, of
which tasks return only counts for each vector. A pair below the limit is never linked, as every link is verified; a
close pair can be missed only if no pass brings it, or a chain of links between the two, into a window. One function
decides all cosines, so a pair at the very limit is a link everywhere or nowhere.

Defined cases: ids are whole numbers. Vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths don't link. A null id keeps its row and links with nothing. Rows that repeat an id
are vectors of their own, which link with each other if they are close, and each has its row. Very long vectors are
compared whole. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.llm.components import Groups, connected
from schemaloom.llm.work import Tables, partitions

COSINE, RECALL, ROUNDS, BITS, WINDOW, TILE, SEED = 0.95, 0.999, 4, 60, 256, 1024, 11
#: Cosines as near as this to the limit are worked out again in a way that doesn't depend on the rows around.
CLOSE = 1e-9


def vectors(column, d: int | None = None) -> np.ndarray:
    """Rows of a list column of equal lengths as unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    out = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, d or 1))
    # Scaled first, so that squares neither overflow nor vanish.
    out = out / np.abs(out).max(axis=1, keepdims=True) if n else out
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def directions(d: int, one: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, d, one]).standard_normal((d, bits))


def keys(x: np.ndarray, one: int, bits: int) -> np.ndarray:
    """The sort key of each row in a pass, not negative."""
    signs = x @ directions(x.shape[1], one, bits) > 0
    return signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def by_length(column) -> Iterator[np.ndarray]:
    """Places of the rows, for each length of vector."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(flat.offsets.to_numpy())
    for d in np.unique(n):
        yield np.flatnonzero(n == d)


def passes_for(n: int, least: float, recall: float, window: int) -> int:
    """How many passes bring a pair at the limit into a window with probability `recall`, for n vectors in even directions."""
    shared = (1 - math.acos(least) / math.pi) ** max(1.0, math.log2(max(2, n) / window))
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - shared)))


def close(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x have a cosine of at least `least` with which rows of y; all are unit vectors."""
    cosines = x @ y.T
    out = cosines >= least
    i, j = np.nonzero(np.abs(cosines - least) < CLOSE)
    if len(i):
        out[i, j] = (x[i] * y[j]).sum(axis=1) >= least
    return out


def neighbours(x: np.ndarray, window: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at most `window` apart with a cosine of at least `least`."""
    for at in range(0, len(x), window):
        i, j = np.nonzero(close(x[at : at + window], x[at : at + 2 * window], least))
        near = (j > i) & (j - i <= window)
        if near.any():
            yield i[near] + at, j[near] + at


def forest(groups: Groups, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tops = groups.tops()
    led = np.flatnonzero(tops != np.arange(len(tops)))
    return node[led], node[tops[led]]


def worked(table: pa.Table, column: str, least: float, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spanning forests of the links among sorted rows: nodes, nodes and which half of the passes found them."""
    ones, node, out = table.column("pass").to_numpy(), table.column(column).to_numpy(), []
    known, rank = np.unique(node, return_inverse=True)
    lengths = [(at, vectors(table.column("v").take(pa.array(at)))) for at in by_length(table.column("v"))]
    for half in (0, 1):
        groups = Groups(len(known))
        for at, x in lengths:
            for one in np.unique(ones[at]):
                if one % 2 == half:
                    own = np.flatnonzero(ones[at] == one)
                    for i, j in neighbours(x[own], window, least):
                        groups.link(rank[at[own[i]]], rank[at[own[j]]])
        u, w = forest(groups, known)
        if len(u):
            out.append((u, w, np.full(len(u), half, np.int64)))
    return out


def links(tables: Tables, classes: DataFrame, least: float, passes: range, bits: int, window: int, many: int) -> DataFrame:
    """(u, v, half): spanning forests of the links that the passes find, the even ones (half 0) and the odd ones."""
    kind = classes.schema["v"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in by_length(batch.column("v")):
                rows = batch.take(pa.array(at))
                x = vectors(rows.column("v"))
                for one in passes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), one, np.int32)), pa.array(keys(x, one, bits)), rows.column("node"), rows.column("v")], names=["pass", "key", "node", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        def emit(table: pa.Table, found: list, edge: int) -> pa.RecordBatch:
            u, w, half = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
            n, m = len(u), table.num_rows
            values = pa.concat_arrays([pa.nulls(n, table.schema.field("v").type), table.column("v").combine_chunks() if m else pa.nulls(0, table.schema.field("v").type)])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([u, table.column("node").to_numpy()])), pa.array(np.concatenate([w, np.zeros(m, np.int64)])), pa.array(np.repeat([-1, edge], [n, m]).astype(np.int32)), pa.array(np.concatenate([half, table.column("pass").to_numpy()]).astype(np.int32)), pa.array(np.concatenate([np.zeros(n, np.int64), table.column("key").to_numpy()])), values],
                names=["u", "w", "edge", "pass", "key", "v"],
            )

        last = None
        for batch in batches:  # sorted by pass and key; a batch is compared together with the window before it
            table = pa.Table.from_batches([batch])
            if last is None:
                yield emit(table.slice(0, window), [], part * 2)
            both = table if last is None else pa.concat_tables([last, table])
            yield emit(both.slice(0, 0), worked(both, "node", least, window), -1)
            last = both.slice(max(0, both.num_rows - window))
        if last is not None:
            yield emit(last, [], part * 2 + 1)

    kept = tables.cut(classes.mapInArrow(project, f"pass int, key long, node long, v {kind}").repartitionByRange(many, "pass", "key", "node").sortWithinPartitions("pass", "key", "node").mapInArrow(compare, f"u long, w long, edge int, pass int, key long, v {kind}"))

    def border(table: pa.Table) -> pa.Table:
        found = worked(table.sort_by([("pass", "ascending"), ("key", "ascending"), ("u", "ascending")]), "u", least, window)
        u, w, half = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pa.table({"u": u, "w": w, "half": half.astype(np.int32)})

    # The last rows of partition p (edge 2p + 1) meet the first of p + 1 (edge 2p + 2).
    edges = kept.where("edge >= 0").withColumn("border", F.floor((F.col("edge") + 1) / 2))
    across = edges.groupBy("border").applyInArrow(border, "u long, w long, half int")
    return kept.where("edge < 0").select("u", F.col("w").alias("v"), F.col("pass").alias("half")).unionByName(across.select("u", F.col("w").alias("v"), "half"))


def counted(rows: DataFrame, least: float, many: int) -> DataFrame:
    """(node, n): how many other vectors each class of a component links with, for rows (node, component, size, v)."""
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    dealt = rows.join(sizes, "component").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("pack", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(many * 4))).otherwise(F.col("component")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("node", "component", "size", "v", "tile", (F.col("tiles") > 1).alias("large"), "pack", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"))

    def count(table: pa.Table) -> pa.Table:
        node, comp, size, tile = (table.column(c).to_numpy() for c in ("node", "component", "size", "tile"))
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        n = np.zeros(len(node), np.int64)
        order = np.argsort(comp, kind="stable")
        cuts = np.flatnonzero(np.diff(comp[order], prepend=comp[order][0] - 1))
        flat = table.column("v").combine_chunks()
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:b]  # a component's vectors have one length, as links have
            x = vectors(flat.take(pa.array(own)))
            left = np.flatnonzero(tile[own] == p)
            right = left if p == q else np.flatnonzero(tile[own] == q)
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                near = close(x[part], x[right], least)
                n[own[part]] += near @ size[own[right]]
                if p != q:
                    n[own[right]] += size[own[part]] @ near
        return pa.table({"node": node, "n": n})

    return pairs.groupBy("large", "pack", "p", "q").applyInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def found_links(tables: Tables, classes: DataFrame, least: float, recall: float, rounds: int, bits: int, window: int, many: int) -> DataFrame:
    """(u, v): links of as many passes as the overlap of their halves asks for."""
    each = passes_for(classes.count(), least, recall, window)
    out = None
    for k in range(rounds):
        new = tables.cut(links(tables, classes, least, range(k * each, (k + 1) * each), bits, window, many))
        out = new if out is None else out.unionByName(new)
        ends = out.select(F.explode(F.array("u", "v")).alias("node"), "half").groupBy("node").agg((F.max(1 - F.col("half"))).alias("a"), F.max("half").alias("b"))
        a, b, both, all_ = ends.agg(F.sum("a"), F.sum("b"), F.sum(F.col("a") * F.col("b")), F.count(F.lit(1))).first()
        if not all_ or both and all_ >= recall * a * b / both:  # by capture and recapture there are a * b / both
            break
    return out.select("u", "v")


def components(spark: SparkSession, table: DataFrame, least: float = COSINE, recall: float = RECALL, rounds: int = ROUNDS, bits: int = BITS, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): a row for each vector. The result reads work tables; those that it doesn't need any more are removed."""
    tables, many = Tables(spark, "vectors"), partitions(spark)
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    # Floats travel as floats; cosines are in double precision all the same. Adding 0 makes -0.0 and 0.0 one value.
    kind = "array<float>" if isinstance(table.schema[vector_col].dataType.elementType, T.FloatType) else "array<double>"
    zero = F.lit(0.0).cast(kind[6:-1])
    read = table.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(v.cast(kind), lambda x: x + zero)).alias("v"))
    rows = read.select("id", F.xxhash64("v").alias("h"), "v")
    classes = rows.where("v IS NOT NULL").groupBy("h", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    classes = tables.cut(classes.withColumn("node", F.monotonically_increasing_id()))
    with Tables.passing():
        passes = Tables(spark, "passes")
        found = tables.cut(connected(passes, found_links(passes, classes, least, recall, rounds, bits, window, many)))
    linked = classes.join(found, "node").select("node", "component", "size", "first", "v")
    counts = counted(linked.select("node", "component", "size", "v"), least, many)
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    about = tables.cut(classes.join(found, "node", "left").join(counts, "node", "left").join(heads, "component", "left").select("h", "node", (F.coalesce("n", "size") - 1).alias("n_links"), F.coalesce("head", "first").alias("component_id")))
    # Rows find their class by the hash of their vector; where classes share a hash, by the vector too.
    shared = about.groupBy("h").count().where("count > 1").select("h")
    out = ["id", "n_links", "component_id"]
    known = rows.where("v IS NOT NULL").select("id", "h").join(about, "h")
    if not shared.isEmpty():
        shared = tables.cut(shared)
        both = about.join(shared, "h").join(classes.select("node", F.col("v").alias("w")), "node")
        alike = rows.where("v IS NOT NULL").join(both, "h").where(F.col("v") == F.col("w"))
        known = known.join(shared, "h", "left_anti").select(*out).unionByName(alike.select(*out))
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.select(*out).unionByName(alone).withColumn("kept", F.col("id").isNull() | (F.col("id") == F.col("component_id")))


def keep_one(spark: SparkSession, table: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", **named) -> DataFrame:
    """table without the rows that aren't the first, by id, of their component."""
    lose = components(spark, table, least, id_col=id_col, vector_col=vector_col, **named).where("NOT kept").select(F.col("id").alias("__lose"))
    return table.join(lose, table[id_col].cast("long") == lose["__lose"], "left_anti")
