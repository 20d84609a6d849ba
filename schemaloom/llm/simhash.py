"""Near-copies by 64-bit SimHash fingerprints of word shingles, compared exactly in tiles.

Fingerprints: texts are lower-cased (A-Z only) and cut into words `[^\\x20\\x09-\\x0D]+`; each run of `width` words,
repeats included, gives one XXH64 (seed 42). A bit is set if over half the hashes have it. A text with fewer words is
one shingle; a text without words, or null, has fingerprint zero and is linked like any other.

Comparison: equal fingerprints become one class. Classes are dealt into tiles by population count; two tiles are
compared unless their population counts differ by more than the radius, which bounds the distance from below. Within a
pair of tiles numpy compares blocks by exclusive-or and bit counts, and again leaves out blocks whose population counts
(of the whole and of the four 16-bit quarters) are too far apart. A task reports a spanning forest of the links that it
finds, never all pairs, and the distributed components unite these.

Documents alike (keep_one): fingerprints of 256 bits over five-word shingles and a wide radius give candidates only. These
are verified by the exact Jaccard similarity of their shingles, as line_dedup does it for lines, and the verified links
are united.

Defined cases: ids are whole numbers. A very long text is taken whole. A null id keeps its row, has its fingerprint and a null component. Rows that repeat an id share it.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.components import Groups, connected, downward
from schemaloom.llm.line_dedup import verified, with_sizes
from schemaloom.llm.words import mixed, span_hashes, window_hashes
from schemaloom.llm.work import Tables, as_bytes, partitions, tidy

LEAST_TILE, MOST_TILE, TILES = 4096, 65536, 24


def fingerprint(text: bytes | None, width: int = 4, parts: int = 1) -> list[int]:
    """The fingerprint of UTF-8 text, as so many unsigned 64-bit parts; further parts take the bits of the remixed hashes."""
    words = text.lower().split() if text else []
    if not words:
        return [0] * parts
    whole = b" ".join(words)
    if len(words) <= width:
        return [int(remixed(np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64), k)[0]) for k in range(parts)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], 42) for a, b in zip(first, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
    return [majority(remixed(hashes, k)) for k in range(parts)]


def remixed(hashes: np.ndarray, part: int) -> np.ndarray:
    return mixed(hashes + np.uint64(part * 0x9E3779B97F4A7C15 % (1 << 64))) if part else hashes


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    n, held = len(hashes), np.zeros(64, np.int64)
    hashes = hashes.astype(">u8")
    for at in range(0, n, 4096):
        held += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(held * 2 > n).tobytes(), "big")


def columns(parts: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, parts))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, parts: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep ..., fp long, fp1 ...): one row for each row of docs."""
    names = columns(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, width, parts) for x in as_bytes(batch.column("__text"))], np.uint64).reshape(-1, parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(parts))], names=["id", *keep, *names])

    schema = ", ".join(["id long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in names)])
    return docs.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(tidy(run), schema)


def near(a: np.ndarray, b: np.ndarray | None, radius: int, more=None, most: int = 0, rows: int = 128, cols: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in a, j in b) of fingerprints that differ in at most radius bits; with b None, pairs within a. Blocks are kept small enough for the CPU's cache.

    more: pairs of arrays that belong to a and b, which must differ in at most `most` bits together.
    """
    quarters = lambda x: np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)]).astype(np.int16)
    order = lambda q: np.lexsort((q[3], q[2], q[1], q[0]))

    def blocks(x: np.ndarray, step: int):
        q = quarters(x)
        o = order(q)
        q, cuts = q[:, o], range(0, len(x), step)
        return o, x[o], np.array([q[:, c : c + step].min(axis=1) for c in cuts]), np.array([q[:, c : c + step].max(axis=1) for c in cuts])

    if not len(a) or b is not None and not len(b):
        return
    ao, ax, al, ah = blocks(a, rows)
    bo, bx, bl, bh = blocks(a if b is None else b, cols)
    for k in range(len(al)):
        gap = np.maximum(0, np.maximum(bl - ah[k], al[k] - bh)).sum(axis=1)
        left = ax[k * rows : (k + 1) * rows, None]
        for c in np.flatnonzero(gap <= radius):
            if b is None and (c + 1) * cols <= k * rows:
                continue
            i, j = np.nonzero(np.bitwise_count(left ^ bx[None, c * cols : (c + 1) * cols]) <= radius)
            if len(i):
                i, j = ao[i + k * rows], bo[j + c * cols]
                if b is None:
                    i, j = i[i != j], j[i != j]
                if len(i) and more is not None:
                    far = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in more)
                    i, j = i[far <= most], j[far <= most]
                if len(i):
                    yield i, j


def candidate_links(classes: DataFrame, names: list[str], radius: int, most: int) -> DataFrame:
    """(u, v): spanning forests, by pair of tiles, of the nodes of classes (names, node, ones) whose fingerprints are near."""
    counts = dict(classes.groupBy("ones").count().collect())  # 65 rows at most
    total = sum(counts.values())
    aim = min(MOST_TILE, max(LEAST_TILE, total // TILES))
    tiles, first = 0, {}
    for ones in sorted(counts):
        first[ones] = tiles
        tiles += math.ceil(counts[ones] / aim)
    table = lambda x: F.create_map(*[F.lit(v) for pair in x.items() for v in pair]) if x else F.create_map(F.lit(0), F.lit(0))
    many = {o: math.ceil(n / aim) for o, n in counts.items()}
    dealt = classes.withColumn("tile", (table(first)[F.col("ones")] + F.pmod(F.xxhash64(*names), table(many)[F.col("ones")].cast("long"))).cast("int"))
    # Tiles are numbered by population count, so what a tile is compared with is one run of tiles.
    lows = {o: min(first[p] for p in first if p >= o - radius) for o in first}
    highs = {o: max(first[p] + many[p] - 1 for p in first if p <= o + radius) for o in first}
    other = F.explode(F.sequence(table(lows)[F.col("ones")], table(highs)[F.col("ones")])).alias("other")
    pairs = dealt.select(*names, "node", "tile", other).select(*names, "node", "tile", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"))

    def compare(table: pa.Table) -> pa.Table:
        node, tile = (table.column(c).to_numpy() for c in ("node", "tile"))
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        fps = [table.column(c).to_numpy().view(np.uint64) for c in names]
        fp, groups = fps[0], Groups(len(node))
        a, b = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
        order = np.argsort(node)
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        more = [(x[a], x[a if p == q else b]) for x in fps] if len(fps) > 1 else None
        for i, j in near(fp[a], None if p == q else fp[b], radius, more, most):
            groups.link(rank[a[i]], rank[(a if p == q else b)[j]])
        tops = groups.tops()
        led = np.flatnonzero(tops != np.arange(len(tops)))
        return pa.table({"u": node[order[led]], "v": node[order[tops[led]]]})

    return pairs.groupBy("p", "q").applyInArrow(compare, "u long, v long")


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp long, component_id): the smallest id that each row reaches by links of at most radius differing bits."""
    tables = Tables(spark, "simhash")
    rows = tables.cut(fingerprints(docs, id_col, text_col, width))
    classes = tables.cut(rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")).withColumn("ones", F.bit_count("fp").cast("int")))
    found = connected(tables, candidate_links(classes, ["fp"], radius, 0))
    classes = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(classes, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Candidates among documents alike in four fifths of their five-word shingles: by the angles of SimHash bits such pairs
#: differ in about 39 of 256 bits, give or take 6, and in 10 of 64, give or take 3; unrelated ones differ in about half.
WIDTH, PARTS, RADIUS, MOST, SIMILARITY = 5, 4, 21, 64, 0.8


def word_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of words, lower-cased (A-Z); a text with fewer words is one shingle, one without words that of nothing."""
    out = []
    for text in texts:
        words = text.encode().lower().split()
        data = np.frombuffer(b" ".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1) if len(words) else ends
        if len(words) > width:
            out.append(np.unique(window_hashes(span_hashes(data, starts, ends), width)))
        else:
            out.append(span_hashes(data, np.zeros(1, np.int64), np.array([len(data)])) if words else np.zeros(1, np.uint64))
    return out


def alike(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, head): the smallest id of each document's group of documents alike; tag tells texts apart. Null ids are left out. The result is a work table, those it is made of are removed."""
    out = Tables(spark, "alike")
    with Tables.passing():
        return out.cut(headed(Tables(spark, "alike"), docs, similarity, id_col, text_col))


def headed(tables: Tables, docs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    names = columns(PARTS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text")).where("id IS NOT NULL")
    prints = tables.cut(fingerprints(rows, "id", "text", WIDTH, PARTS, ("tag",)))
    # Equal texts are one class; its text is that of its least id.
    classes = tables.cut(prints.groupBy(*names, "tag").agg(F.min("id").alias("first")).withColumn("ones", F.bit_count("fp").cast("int")).withColumn("node", F.monotonically_increasing_id()))
    links = tables.cut(downward(candidate_links(classes, names, RADIUS, MOST)))
    found = with_sizes(tables, connected(tables, links, True))
    about = classes.join(found, "node").select(F.col("first").alias("__i"), F.col("tag").alias("__t"), F.col("node").alias("line"), "component", "m")
    texts = rows.join(about, (rows["id"] == about["__i"]) & (rows["tag"] == about["__t"])).dropDuplicates(["line"]).select("line", "component", "m", "text")
    sure = connected(tables, verified(texts, links, tables, partitions(tables.spark), similarity, word_sets))
    groups = classes.join(sure, "node", "left").select("tag", *names, "first", F.coalesce("component", "node").alias("group"))
    heads = groups.groupBy("group").agg(F.min("first").alias("head"))
    groups = groups.join(heads, "group").select("tag", *names, "head")
    return prints.join(groups, ["tag", *names]).select("id", "tag", "head")


def keep_one(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is not the smallest of its group of documents alike. Rows with a null id stay."""
    lose = alike(spark, docs, similarity, id_col, text_col).where("head <> id").select(F.col("id").alias("__lose"), F.col("tag").alias("__tag")).distinct()
    tag = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(lose, (docs[id_col].cast("long") == lose["__lose"]) & (tag == lose["__tag"]), "left_anti")
