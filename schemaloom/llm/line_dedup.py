"""Fuzzy line dedup by MinHash: one line stays of each component of lines that are alike; the first by id and place.

A line is what stands between line feeds, without white space at its ends; lines without a word are left alone. Its
shingles are all runs of SHINGLE characters (a shorter line is one shingle). Two lines are alike if the Jaccard
similarity of their shingle sets is at least `similarity`.

1. Each task hashes its distinct lines, signs their shingles by BANDS x ROWS minima and sends, by hash range, band keys
   with line hashes. A range's task links each line to the least line that shares a key: stars, never all pairs. With
   14 bands of 4 rows a pair at similarity 0.8 shares a key with probability 0.9994.
2. The components of these links are candidates only. The documents are read again: each task gives the texts of lines
   that a Bloom filter of fixed size may hold, which a join checks, and by hash range the places of all lines, of which
   those are kept whose line is there twice or may be a candidate.
3. Candidates are verified by exact Jaccard similarity. Components of up to TILE lines are packed together and all their
   unlinked pairs compared. Of a larger component, which may be a chain of buckets, only lines that share a bucket's
   least line are compared: all with that line first, and then those that are unlike it with all the others, in tiles
   of bounded size. A task reports a spanning forest of verified links, and the distributed components unite these.
4. The first occurrence in each verified component is kept, found by a minimum that is combined before the shuffle.
   The other occurrences, equal lines included, go from their documents.

Defined cases: ids are whole numbers. Null or empty texts have no lines and stay as they are. A very long text is read
whole, and a very long line is a line like others. Rows with a null id are left as they are and
don't count. Rows that repeat an id and text are one row more than once: lines are kept or lost alike in all of them.
Extra columns are ignored, clashing names included. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.components import Groups, connected, downward, heavy_keys, looked_up
from schemaloom.llm.words import IS_SPACE, inverse, mixed, powers, span_hashes, sums
from schemaloom.llm.work import Marks, Tables, buffers, by_range, filter_of, pack, partitions, ranges, rises, slices, tidy, unpack

SHINGLE, BANDS, ROWS, SIMILARITY = 8, 14, 4, 0.8
TILE, SMALL = 256, 64
#: Lines of a component that are compared pair by pair.
FEW = 6
#: Shingles that are signed together.
BLOCK = 1 << 16
#: Lines whose signatures, and lines whose places a task gathers before it sends them; bytes of the filter.
GATHER, PLACES, FILTER_BYTES = 1 << 16, 1 << 18, 8 << 20
CHAR_BASE = np.uint64(0xA24BAED4963EE407)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text): tag tells rows apart that share an id but not a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def line_places(data: np.ndarray, offsets: np.ndarray):
    """Of the lines with a word: first and last byte without white space at the ends, document and number within the document, counting all lines."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offsets[1:], breaks, side="right")
    # A document has a line more than it has breaks: its first begins with it, the others after a break.
    many = np.bincount(doc_of, minlength=n_docs) + 1
    doc = np.repeat(np.arange(n_docs), many)
    firsts = np.cumsum(many) - many
    number = np.arange(len(doc)) - firsts[doc]
    starts, ends = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    opening = number == 0
    starts[opening], starts[~opening] = offsets[:-1], breaks + 1
    ends[:-1] = starts[1:] - 1
    last = firsts + many - 1
    ends[last] = offsets[1:]
    # Ends are moved inwards over white space, a byte a round for the lines that still have some.
    left = np.flatnonzero(starts < ends)
    while len(left):
        left = left[IS_SPACE[data[starts[left]]]]
        starts[left] += 1
        left = left[starts[left] < ends[left]]
    left = np.flatnonzero(starts < ends)
    while len(left):
        left = left[IS_SPACE[data[ends[left] - 1]]]
        ends[left] -= 1
    worded = starts < ends
    return starts[worded], ends[worded], doc[worded], number[worded]


def signatures(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Band keys (lines x BANDS) of lines given as places in an array of code points."""
    c = sums((chars.astype(np.uint64) + np.uint64(1)) * powers(CHAR_BASE, len(chars)))
    back = powers(inverse(CHAR_BASE), len(chars))
    many = np.maximum(ends - starts - SHINGLE + 1, 1)
    at = np.cumsum(many) - many
    place = np.arange(int(many.sum())) + np.repeat(starts - at, many)
    until = np.minimum(place + SHINGLE, np.repeat(ends, many))
    x = (mixed((c[until] - c[place]) * back[place]) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 1 << 31, (2, BANDS * ROWS), dtype=np.uint32)
    least = np.empty((BANDS * ROWS, len(starts)), np.uint32)
    ends_at = at + many
    first = 0
    while first < len(starts):  # runs of lines whose shingles stay in the CPU's cache
        last = max(first + 1, int(np.searchsorted(ends_at, at[first] + BLOCK, side="right")))
        own, cuts = x[at[first] : ends_at[last - 1]], at[first:last] - at[first]
        y = np.empty_like(own)
        for k in range(BANDS * ROWS):
            np.multiply(own, a[k] * np.uint32(2) + np.uint32(1), out=y)
            y += b[k]
            least[k, first:last] = np.minimum.reduceat(y, cuts)
        first = last
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[k])
        keys[:, band] = key
    return keys


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The text as code points, and the places there of spans of bytes."""
    count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4"), count[starts], count[ends]


def candidates(rows: DataFrame, many: int) -> DataFrame:
    """(u, v): links between line hashes that share a band key, as stars."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kept, count = set(), [], 0

        def flush():
            keys = np.concatenate([k for k, _ in kept])
            lines = np.concatenate([x for _, x in kept])
            order = np.argsort(keys)
            keys, lines = keys[order], lines[order]
            parts = list(by_range(keys, many))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([p.stop - p.start for _, p in parts], pa.int32()), pa.array([pack(keys[p] >> np.uint64(16), lines[p]) for _, p in parts], pa.binary())], names=["r", "n", "blob"])

        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = buffers(batch.column("text"))
                starts, ends, _, _ = line_places(data, offsets)
                if not len(starts):
                    continue
                hashes, first = np.unique(span_hashes(data, starts, ends), return_index=True)
                new = np.array([h not in seen for h in hashes.tolist()])
                if not new.any():
                    continue
                order = np.argsort(first[new])
                hashes, first = hashes[new][order], first[new][order]
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.update(hashes.tolist())
                chars, cs, ce = code_points(data, starts[first], ends[first])
                kept.append((signatures(chars, cs, ce).ravel(), np.repeat(hashes, BANDS)))
                count += len(first)
                if count >= GATHER:
                    yield flush()
                    kept, count = [], 0
        if count:
            yield flush()

    def star(table: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py(), n.as_py(), "u8", "u8") for b, n in zip(table.column("blob"), table.column("n"), strict=True)]
        keys, lines = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.int64)
        order = np.lexsort((lines, keys))
        keys, lines = keys[order], lines[order]
        at = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
        least = np.repeat(lines[at], np.diff(at, append=len(keys)))
        other = lines != least
        pairs = np.unique(np.stack([lines[other], least[other]], axis=1), axis=0)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return rows.select("text").mapInArrow(tidy(send), "r int, n int, blob binary").groupBy("r").applyInArrow(star, "u long, v long")


def second_reading(rows: DataFrame, marks, many: int) -> DataFrame:
    """(text, line) of lines that the filter may hold, once a task and run of rows; and (r, n, blob): by hash range lines with id, tag and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Marks(many, marks.value[0], np.frombuffer(marks.value[1], np.uint8))
        kept, count = [], 0

        def flush():
            lines, ids, tags, numbers = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(lines, kind="stable")
            lines, parts = lines[order], list(by_range(lines[order], many))
            blobs = [pack(rises(lines[p]), ids[order[p]], tags[order[p]], numbers[order[p]]) for _, p in parts]
            return made([r for r, _ in parts], [p.stop - p.start for _, p in parts], blobs, [None] * len(parts), [None] * len(parts))

        def made(r, n, blob, line, text):
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(n, pa.int32()), pa.array(blob, pa.binary()), pa.array(line, pa.int64()), pa.array(text, pa.string())], names=["r", "n", "blob", "line", "text"])

        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = buffers(batch.column("text"))
                starts, ends, doc, number = line_places(data, offsets)
                if not len(starts):
                    continue
                lines = span_hashes(data, starts, ends)
                hashes, first = np.unique(lines, return_index=True)
                has = wanted.has(hashes)
                if has.any():
                    found = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[first[has]], ends[first[has]], strict=True)]
                    none = [None] * len(found)
                    yield made(none, none, none, hashes[has].view(np.int64), found)
                kept.append((lines, batch.column("id").to_numpy()[doc], batch.column("tag").to_numpy()[doc], number.astype(np.int32)))
                count += len(lines)
                if count >= PLACES:
                    yield flush()
                    kept, count = [], 0
        if count:
            yield flush()

    return rows.mapInArrow(tidy(run), "r int, n int, blob binary, line long, text string")


def occurrences(blobs: DataFrame, marks, many: int) -> DataFrame:
    """(line, id, tag, number): places of lines that are there twice or that the filter may hold; of (r, n, blob)."""

    def recurring(table: pa.Table) -> pa.Table:
        wanted = Marks(many, marks.value[0], np.frombuffer(marks.value[1], np.uint8))
        parts = [unpack(b.as_py(), n.as_py(), "u8", "i8", "i8", "i4") for b, n in zip(table.column("blob"), table.column("n"), strict=True)]
        lines = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        order = np.argsort(lines)
        at = np.flatnonzero(np.diff(lines[order], prepend=lines[order[0]] + np.uint64(1)))
        many_ = np.diff(at, append=len(order))
        take = order[np.repeat((many_ > 1) | wanted.has(lines[order[at]]), many_)]
        ids, tags, numbers = (np.concatenate([p[k] for p in parts])[take] for k in (1, 2, 3))
        return pa.table({"line": lines[take].view(np.int64), "id": ids, "tag": tags, "number": numbers})

    return blobs.groupBy("r").applyInArrow(recurring, "line long, id long, tag long, number int")


def shingles(text: str) -> frozenset[str]:
    return frozenset(text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1)))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct numbers of its shingles. Equal numbers are equal shingles, as no bits are lost: code points are numbered, and numbers joined two by two and numbered anew where they don't fit."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # A text is followed by as many zeros as a shingle that begins in it may reach.
    points = np.frombuffer(("\0" * SHINGLE).join([*texts, ""]).encode("utf-32-le"), "<u4")
    at = np.cumsum(size + SHINGLE) - size - SHINGLE
    used = np.zeros(int(points.max(initial=0)) + 1, bool)
    used[points] = True
    x = np.cumsum(used).astype(np.uint64)[points]
    x[((at + size)[:, None] + np.arange(SHINGLE)).ravel()] = 0
    bits, width = int(x.max(initial=0)).bit_length(), 1
    while width < SHINGLE:
        if 2 * bits > 64:
            x = np.unique(x, return_inverse=True)[1].astype(np.uint64)
            bits = int(x.max()).bit_length()
        x = x << np.uint64(bits) | np.append(x[width:], np.zeros(min(width, len(x)), np.uint64))
        bits, width = bits * 2, width * 2
    out = []
    for a, n in zip(at.tolist(), np.maximum(size - SHINGLE + 1, 1).tolist(), strict=True):
        own = np.sort(x[a : a + n])
        out.append(own[np.append(True, own[1:] != own[:-1])])
    return out


def jaccard_holds(common, a, b, similarity: float):
    return common >= similarity * (a + b - common) - 1e-9


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, groups: Groups, similarity: float) -> None:
    """Links the places of lines that are alike, among left or between left and right; pairs already linked are passed over.

    Shingles get numbers, so that one line's overlap with all the others is one sum over marks in an array.
    """
    both = left if right is None else np.concatenate([left, right])
    if len(both) < 2 or right is not None and not len(left):
        return
    if right is None and len(both) <= FEW:
        return plain_alike(sets, left.tolist(), groups, similarity)
    sizes = np.array([len(sets[i]) for i in both.tolist()])
    known, ids = np.unique(np.concatenate([sets[i] for i in both.tolist()]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marks = np.zeros(len(known), np.int32)
    for k, i in enumerate(left.tolist()):
        at = np.arange(k + 1 if right is None else len(left), len(both))
        at = at[(sizes[at] >= similarity * sizes[k]) & (sizes[at] * similarity <= sizes[k])]
        at = at[groups.top(both[at]) != groups.top(np.array([i]))[0]]
        if not len(at):
            continue
        own = ids[starts[k] : ends[k]]
        marks[own] = 1
        if 4 * len(at) < len(both):
            common = np.array([int(marks[ids[starts[j] : ends[j]]].sum()) for j in at.tolist()])
        else:
            common = np.add.reduceat(marks[ids], starts)[at]
        marks[own] = 0
        hits = at[jaccard_holds(common, sizes[k], sizes[at], similarity)]
        if len(hits):
            groups.link(np.full(len(hits), i), both[hits])


def plain_alike(sets: list[np.ndarray], places: list[int], groups: Groups, similarity: float) -> None:
    """The same among a few lines, pair by pair."""
    top = {i: i for i in places}
    for k, i in enumerate(places):
        for j in places[:k]:
            a, b = sets[i], sets[j]
            if top[i] == top[j] or len(a) < similarity * len(b) or len(b) < similarity * len(a):
                continue
            merged = np.sort(np.concatenate([a, b]))
            if jaccard_holds(np.count_nonzero(merged[1:] == merged[:-1]), len(a), len(b), similarity):
                low, high = sorted((top[i], top[j]))
                top = {p: low if t == high else t for p, t in top.items()}
    led = [p for p, t in top.items() if p != t]
    groups.link(np.array(led, np.int64), np.array([top[p] for p in led], np.int64))


def forest_of(line: np.ndarray, groups: Groups) -> pa.Table:
    tops = groups.tops()
    led = np.flatnonzero(tops != np.arange(len(tops)))
    return pa.table({"u": line[led], "v": line[tops[led]]})


def with_sizes(tables: Tables, found: DataFrame) -> DataFrame:
    """(node, component, m): components with the number of their nodes; large ones are looked up apart."""
    counts = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    rows = found.count()
    return tables.cut(looked_up(found, "component", "node", counts.select(F.col("component").alias("k"), F.col("n").alias("m")), heavy_keys(counts, "component", rows)), rows)


def verified(lines: DataFrame, links: DataFrame, tables: Tables, many: int, similarity: float, sets_of: Callable[[list[str]], list[np.ndarray]] = shingle_sets) -> DataFrame:
    """(u, v): a spanning forest of links by exact similarity, for lines (line, component, m, text) of candidate components with m lines and links (u, v) to buckets' least lines. sets_of gives texts' shingles as sorted distinct numbers."""
    sized = tables.cut(lines)
    packed = sized.where(F.col("m") <= TILE).withColumn("pack", F.pmod(F.xxhash64("component"), F.lit(many * SMALL)))

    def compare(table: pa.Table) -> pa.Table:
        comp, line = (table.column(c).to_numpy() for c in ("component", "line"))
        order = np.lexsort((line, comp))
        sets = sets_of(table.column("text").take(pa.array(order)).to_pylist())
        comp, line, groups = comp[order], line[order], Groups(len(order))
        cuts = np.flatnonzero(np.diff(comp, prepend=comp[0] - 1))
        for a, b in zip(cuts, [*cuts[1:], len(comp)], strict=True):
            alike(sets, np.arange(a, b), None, groups, similarity)
        return forest_of(line, groups)

    found = packed.groupBy("pack").applyInArrow(compare, "u long, v long")
    large = sized.where(F.col("m") > TILE).select("line", "text")
    if large.isEmpty():
        return found
    # Lines that share a bucket's least line, with the number of tiles that they fill. Leads of many lines are looked up apart.
    shared = links.select(F.col("u").alias("line"), F.col("v").alias("lead")).unionByName(links.select(F.col("v").alias("line"), F.col("v").alias("lead")).distinct())
    shared = tables.cut(large.select("line").join(shared, "line").distinct())
    counts, rows = shared.groupBy("lead").agg(F.count(F.lit(1)).alias("n")), shared.count()
    heavy = heavy_keys(counts, "lead", rows)
    shared = looked_up(shared, "lead", "line", counts.select(F.col("lead").alias("k"), F.ceil(F.col("n") / TILE).cast("int").alias("m")), heavy).withColumnRenamed("m", "tiles")
    shared = tables.cut(shared.withColumn("tile", F.pmod(F.xxhash64("line"), F.col("tiles")).cast("int")), rows)
    texts = large.withColumnRenamed("line", "__line")
    first = shared.where("line = lead").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    first = first.unionByName(shared.where("line <> lead")).join(texts, F.col("line") == F.col("__line")).select("lead", "tile", "line", "text")

    def with_lead(table: pa.Table) -> pa.Table:
        line, lead = table.column("line").to_numpy(), table.column("lead")[0].as_py()
        sets = sets_of(table.column("text").to_pylist())
        groups, own = Groups(len(line)), np.flatnonzero(line == lead)
        alike(sets, own, np.flatnonzero(line != lead), groups, similarity)
        near = groups.tops() == groups.tops()[own[0]]
        return pa.table({"lead": table.column("lead"), "line": line, "near": near})

    led = tables.cut(first.groupBy("lead", "tile").applyInArrow(with_lead, "lead long, line long, near boolean").where("line <> lead"))
    near = led.where("near").select(F.greatest("line", "lead").alias("u"), F.least("line", "lead").alias("v"))
    far = led.groupBy("lead").agg(F.count_if(~F.col("near")).alias("f")).select(F.col("lead").alias("k"), F.ceil(F.col("f") / TILE).cast("int").alias("m"))
    # Of each lead the lines unlike it, in parts, meet all of its lines, in tiles.
    left = looked_up(led.join(shared.select("lead", "line", "tiles"), ["lead", "line"]).where("NOT near"), "lead", "line", far, heavy).withColumn("part", F.pmod(F.xxhash64("line"), F.col("m")).cast("int"))
    left = left.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("lead", "part", "tile", "line", F.lit(True).alias("far"))
    right = looked_up(shared.where("line <> lead"), "lead", "line", far, heavy).where("m > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("lead", "part", "tile", "line", F.lit(False).alias("far"))
    work = left.unionByName(right).join(texts, F.col("line") == F.col("__line")).select("lead", "part", "tile", "line", "far", "text")

    def across(table: pa.Table) -> pa.Table:
        all_, far_ = table.column("line").to_numpy(), table.column("far").to_numpy(zero_copy_only=False)
        line, at = np.unique(all_, return_index=True)
        sets = sets_of(table.column("text").take(pa.array(at)).to_pylist())
        groups, first_ = Groups(len(line)), np.isin(line, all_[far_])
        inner = np.flatnonzero(first_ & np.isin(line, all_[~far_]))
        alike(sets, np.flatnonzero(first_), np.flatnonzero(~first_), groups, similarity)
        alike(sets, inner, None, groups, similarity)
        if len(inner) < int(first_.sum()):
            alike(sets, np.flatnonzero(first_ & ~np.isin(line, line[inner])), inner, groups, similarity)
        return forest_of(line, groups)

    return found.unionByName(near).unionByName(work.groupBy("lead", "part", "tile").applyInArrow(across, "u long, v long"))


def removals(spark: SparkSession, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, tag, numbers array<int>): lines that go from each document; rows is (id, tag, text). The result is a work table, those it is made of are removed."""
    out = Tables(spark, "lines")
    with Tables.passing():
        return out.cut(removed(Tables(spark, "lines"), rows, similarity))


def removed(tables: Tables, rows: DataFrame, similarity: float) -> DataFrame:
    many = ranges(rows)
    size = max(64, FILTER_BYTES // many)
    known = rows.where("id IS NOT NULL")
    links = tables.cut(downward(candidates(known, many)))
    found = with_sizes(tables, connected(tables, links, True))
    marks = filter_of(found, "node", many, size)
    sent = tables.spark.sparkContext.broadcast((size, marks.bits.tobytes()))
    again = tables.cut(second_reading(known, sent, many))
    texts = again.where("line IS NOT NULL").select("line", "text").join(found, F.col("line") == F.col("node")).dropDuplicates(["line"]).select("line", "component", "m", "text")
    sure = connected(tables, verified(texts, links, tables, partitions(tables.spark), similarity))
    occurring = tables.cut(occurrences(again.where("r IS NOT NULL").select("r", "n", "blob"), sent, many))
    lines = occurring.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tag", "number")).alias("first"))
    led = tables.cut(lines.join(sure, lines["line"] == sure["node"], "left").select("line", "n", "first", F.coalesce("component", "line").alias("root")))
    heads = led.groupBy("root").agg(F.sum("n").alias("all"), F.min("first").alias("head"), F.count(F.lit(1)).alias("n")).where("all > 1")
    led = looked_up(led.select("line", "root"), "root", "line", heads.select(F.col("root").alias("k"), F.col("head").alias("m")), heavy_keys(heads, "root", led.count()))
    lost = led.where("m IS NOT NULL").select(F.col("line").alias("__line"), F.col("m").alias("head"))
    gone = occurring.join(lost, occurring["line"] == lost["__line"]).where(F.struct("id", "tag", "number") != F.col("head"))
    return gone.groupBy("id", "tag").agg(F.array_distinct(F.collect_list("number")).alias("numbers"))


def without(text: str, numbers) -> str:
    gone = set(numbers)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def dedup(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with `text_col` without the lines that go; with counts also n_lines and n_removed long, the lines with a word and those of them that went, in place of columns so called."""
    gone = removals(spark, named(docs, id_col, text_col), similarity).select(F.col("id").alias("__i"), F.col("tag").alias("__t"), F.col("numbers").alias("__gone"))
    tag = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    tagged = docs.withColumn("__tag", tag)
    joined = tagged.join(gone, (tagged[id_col].cast("long") == gone["__i"]) & (tagged["__tag"] == gone["__t"]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    # The array of lines is bound once to a lambda's variable; array_except keeps the order of places.
    stay = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: F.get(x, i)), "\n")
    left = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.element_at(F.transform(F.array(lines), stay), 1))
    # From a line's first character that isn't white space to its end: one match for each line with a word.
    worded = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long")
    made = [worded.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    kept = [left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    return joined.select(*kept, *made)


def digest(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, kept_sha256)."""
    out = dedup(spark, docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), similarity, "id", "text", counts=True)
    return out.select("id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> dict[int, set[int]]:
    """The lines that go from each document, by comparing all pairs; for small tests."""
    where: dict[str, list[tuple[int, int]]] = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        for k, x in enumerate((text or "").split("\n")):
            if x.strip(" \t\n\v\f\r"):
                where.setdefault(x.strip(" \t\n\v\f\r"), []).append((i, k))
    lines = list(where)
    sets, groups = [shingles(x) for x in lines], Groups(len(lines))
    post: dict[str, list[int]] = {}
    for k, s in enumerate(sets):
        for g in s:
            post.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        count: dict[int, int] = {}
        for g in s:
            for j in post[g]:
                if j < k:
                    count[j] = count.get(j, 0) + 1
        hits = [j for j, n in count.items() if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9]
        if hits:
            groups.link(np.full(len(hits), k), np.array(hits))
    all_: dict[int, list[tuple[int, int]]] = {}
    for k, top in enumerate(groups.tops().tolist()):
        all_.setdefault(top, []).extend(where[lines[k]])
    out: dict[int, set[int]] = {}
    for places in all_.values():
        for i, k in sorted(places)[1:]:
            out.setdefault(i, set()).add(k)
    return out


