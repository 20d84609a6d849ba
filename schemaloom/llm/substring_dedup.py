"""Exact repeats of long passages, removed from all documents but the first by id, by fixed-block anchors.

Anchors: a document's words `[^\\x20\\x09-\\x0D]+` are cut into blocks of half the passage length that don't overlap.
A repeated passage of `width` words holds one whole block of each document that has it, wherever it begins. So blocks
are indexed by a hash, and every rolling window of a block's length probes that index.

1. Each task sends, by hash range and as sorted, compressed differences, the hashes of all its rolling windows, with a
   mark for the ones that are blocks. A range's task finds the hashes that are somebody's block and occur in two
   documents, and writes them into its segment of a Bloom filter of fixed size.
2. The documents are read again, in runs of bounded size. Where a rolling window hits an anchor, the hit is extended: the
   run lists the windows of `width` words around it. A document without hits is answered at once. Of the others the run
   keeps the texts and where each listed window is, and sends by hash range each window once, with the smallest
   document that has it, so that a window which all documents share is one record for each run, not each occurrence.
   A range's task answers each run with the smallest document of all runs and the place there.
3. Each run joins adjacent places whose answers are adjacent too to claims: these words of this document repeat those
   words of a smaller one. The words of both are read in the texts kept and their digests compared, by a count for
   each passage of the smaller document that is combined before the shuffle. So the 64-bit hashes only find repeats.
4. Claims that hold are cut. Where one fails, two different windows have the same hash: all windows with such hashes are
   then judged by SHA-256 of their words.

Defined cases: ids are whole numbers. Windows are judged on the input. A text without words, or null, has none and keeps
the empty string; a very long text is a run of its own. A null id is neither judged nor a reference: its row keeps all.
Rows that repeat an id are documents with equal ids, none smaller than the other. Extra columns are ignored, clashing
names included. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.words import span_hashes, window_hashes, word_places
from schemaloom.llm.work import Marks, Tables, as_bytes, buffers, by_range, filter_of, gathered_marks, pack, ranges, rises, slices, tidy, unpack

WIDTH = 50
#: Windows that a task gathers before it sends them, and bytes of the filters.
GATHER, FILTER_BYTES = 3 << 20, 16 << 20
#: Windows that are looked at in one go.
PIECE = 1 << 17
#: Text of a run.
RUN_BYTES = 3 << 20
#: A probe's record: 44 bits of hash, then 19 of the document within the gathered run, then whether it is a block.
DOC_BITS = 19


def windows(batch: pa.RecordBatch):
    """For a batch's texts: first word of each text (n + 1), hashes of the words, and how many words follow each in its text."""
    data, offsets = buffers(batch.column("text"))
    starts, ends, firsts = word_places(data, offsets)
    hashes = span_hashes(data, starts, ends)
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(len(starts))
    return firsts, hashes, left


def passages(hashes: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Hashes of all windows of so many words, of which the upper bits are used."""
    out = window_hashes(hashes, width)
    return out if bits == 64 else out & ~np.uint64((1 << 64 - bits) - 1)


def in_pieces(records: np.ndarray, many: int) -> Iterator[np.ndarray]:
    """Sorted records in runs of whole hash ranges, of PIECE records or of one range."""
    at = 0
    while at < len(records):
        after, end = int(Marks.range_of(records[min(at + PIECE, len(records)) - 1 :][:1], many)[0]) + 1, len(records)
        if after < many:
            end = int(np.searchsorted(records, np.uint64(-((-after << 32) // many) << 32)))  # the least hash of the range after
        yield records[at:end]
        at = end


def anchors(rows: DataFrame, width: int, many: int, size: int) -> DataFrame:
    """(r, bits): the filter's segments of blocks that occur in two documents."""
    block = width // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        count = docs = 0

        def flush():
            sorted_ = np.concatenate(kept)
            kept.clear()
            sorted_.sort()
            rs, ns, blobs = [], [], []
            for records in in_pieces(sorted_, many):
                keys = records >> np.uint64(DOC_BITS + 1)
                at = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
                last = np.append(at[1:], len(keys)) - 1
                doc = (records >> np.uint64(1)) & np.uint64((1 << DOC_BITS) - 1)
                flags = (doc[at] != doc[last]).astype(np.uint64) * np.uint64(2) | np.bitwise_or.reduceat(records & np.uint64(1), at)
                whole = keys[at] << np.uint64(DOC_BITS + 1)
                for r, part in by_range(whole, many):
                    rs.append(r)
                    ns.append(part.stop - part.start)
                    blobs.append(pack(rises(keys[at[part]] << np.uint64(2) | flags[part])))
            return pa.RecordBatch.from_arrays([pa.array(rs, pa.int32()), pa.array(ns, pa.int32()), pa.array(blobs, pa.binary())], names=["r", "n", "blob"])

        for whole in batches:
            for batch in slices(whole, "text"):
                firsts, hashes, left = windows(batch)
                h = window_hashes(hashes, block)
                fits = np.flatnonzero(left[: len(h)] >= block)
                if not len(fits):
                    continue
                doc = np.searchsorted(firsts, fits, side="right") - 1
                aligned = (fits - firsts[doc]) % block == 0
                if docs + batch.num_rows >= 1 << DOC_BITS and kept:
                    yield flush()
                    kept, count, docs = [], 0, 0
                kept.append((h[fits] >> np.uint64(DOC_BITS + 1)) << np.uint64(DOC_BITS + 1) | (doc + docs).astype(np.uint64) << np.uint64(1) | aligned.astype(np.uint64))
                count += len(fits)
                docs += batch.num_rows
                if count >= GATHER:
                    yield flush()
                    kept, count, docs = [], 0, 0
        if count:
            yield flush()

    def find(table: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([np.cumsum(unpack(b.as_py(), n.as_py(), "u8")[0], dtype=np.uint64) for b, n in zip(table.column("blob"), table.column("n"), strict=True)]))
        keys = values >> np.uint64(2)
        at = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
        flags = np.bitwise_or.reduceat(values & np.uint64(3), at)
        count = np.diff(at, append=len(keys))
        shared = (flags & np.uint64(1) > 0) & ((count > 1) | (flags & np.uint64(2) > 0))
        return pa.table({"r": table.column("r")[:1], "bits": pa.array([Marks.segment(keys[at[shared]] << np.uint64(DOC_BITS + 1), size)], pa.binary())})

    return rows.select("text").mapInArrow(tidy(send), "r int, n int, blob binary").groupBy("r").applyInArrow(find, "r int, bits binary")


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


#: What probe() writes: answers of documents without hits (kind 0), texts (1), places of a run's windows (2), its lists by hash range (3).
WRITTEN = {"kind": pa.int32(), "run": pa.int64(), "doc": pa.int32(), "id": pa.int64(), "text": pa.string(), "n_words": pa.int64(), "kept_sha256": pa.string(), "r": pa.int32(), "n": pa.int32(), "first": pa.int32(), "blob": pa.binary(), "ids": pa.binary()}
SPARK = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def made(count: int, **columns) -> pa.RecordBatch:
    """Rows of WRITTEN; a column that isn't named is null, a single value is that of all rows."""
    arrays = []
    for name, kind in WRITTEN.items():
        x = columns.get(name)
        arrays.append(pa.nulls(count, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x if isinstance(x, (list, np.ndarray)) else [x] * count, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(WRITTEN))


def probe(rows: DataFrame, marks, width: int, bits: int, many: int, full: bool) -> DataFrame:
    """The second reading; see WRITTEN."""
    block = width // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, part, k = Marks(many, marks.value[0], np.frombuffer(marks.value[1], np.uint8)), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", RUN_BYTES):
                run, k = part << 32 | k, k + 1
                firsts, hashes, left = windows(batch)
                h = window_hashes(hashes, block)
                fits = np.flatnonzero(left[: len(h)] >= block)
                hit = np.zeros(len(hashes) + 1, np.int32)
                hit[fits + 1] = filter_.has((h[fits] >> np.uint64(DOC_BITS + 1)) << np.uint64(DOC_BITS + 1))
                hit = np.cumsum(hit)
                full_ = passages(hashes, width, bits)
                at = np.flatnonzero(left[: len(full_)] >= width)
                at = at[hit[at + width - block + 1] > hit[at]]
                doc = np.searchsorted(firsts, at, side="right") - 1
                known = np.asarray(batch.column("id").is_valid())[doc]
                at, doc = at[known], doc[known]
                has = np.zeros(batch.num_rows, bool)
                has[doc] = True
                none, some = batch.take(pa.array(np.flatnonzero(~has))), batch.take(pa.array(np.flatnonzero(has)))
                if none.num_rows:
                    answers = [(len(w), sha(w), b" ".join(w).decode() if full else None) for w in map(bytes.split, as_bytes(none.column("text")))]
                    n_words, shas, texts = map(list, zip(*answers, strict=True))
                    yield made(none.num_rows, kind=0, id=none.column("id"), n_words=n_words, kept_sha256=shas, text=texts if full else None)
                if not some.num_rows:
                    continue
                yield made(some.num_rows, kind=1, run=run, doc=np.arange(some.num_rows), id=some.column("id"), text=some.column("text"))
                place = (at - firsts[doc]).astype(np.int32)
                doc = (np.cumsum(has) - 1)[doc].astype(np.int32)
                ids = some.column("id").to_numpy()
                keys, number = np.unique(full_[at], return_inverse=True)
                least = first_of(number, ids[doc], doc)
                yield made(1, kind=2, run=run, n=len(at), first=len(ids), blob=[pack(number.astype(np.int32), doc, place)], ids=[pack(ids)])
                parts = list(by_range(keys, many))
                yield made(len(parts), kind=3, run=run, r=[r for r, _ in parts], n=[p.stop - p.start for _, p in parts], first=[p.start for _, p in parts], blob=[pack(rises(keys[p]), ids[doc[least[p]]], doc[least[p]], place[least[p]]) for _, p in parts])

    return rows.mapInArrow(tidy(send), ", ".join(f"{c} {SPARK[t]}" for c, t in WRITTEN.items()))


def first_of(number: np.ndarray, ids: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """For each of the numbers 0, 1 ..., of which there is one at least, the place with the least id."""
    order = np.lexsort((*ties[::-1], ids, number))
    return order[np.flatnonzero(np.diff(number[order], prepend=-1))]


def answer(table: pa.Table) -> pa.Table:
    """Of one hash range: for each run that lists a window which another run lists too, the place of the smallest document."""
    ns = table.column("n").to_pylist()
    parts = [unpack(b.as_py(), n, "u8", "i8", "i4", "i4") for b, n in zip(table.column("blob"), ns, strict=True)]
    _, number = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    ids, docs, places = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    runs = np.repeat(table.column("run").to_numpy(), ns)
    least = first_of(number, ids, runs)[number]
    other = least != np.arange(len(least))
    out, begin = [], 0
    for run, first, n in zip(table.column("run").to_pylist(), table.column("first").to_pylist(), ns, strict=True):
        own = np.flatnonzero(other[begin : begin + n])
        if len(own):
            at = least[begin + own]
            out.append((run, len(own), pack((own + first).astype(np.int32), ids[at], runs[at], docs[at], places[at])))
        begin += n
    return pa.table({"run": pa.array([x[0] for x in out], pa.int64()), "n": pa.array([x[1] for x in out], pa.int32()), "blob": pa.array([x[2] for x in out], pa.binary())})


def claims_of(own: pa.Table, answers: pa.Table, width: int) -> pa.Table:
    """Of one run: (run, doc, start, words) repeats (s_run, s_doc, s_start, words), as long as both go on."""
    row = own.to_pylist()[0]
    number, doc, place = unpack(row["blob"], row["n"], "i4", "i4", "i4")
    ids = unpack(row["ids"], row["first"], "i8")[0]
    least = first_of(number, ids[doc], doc)
    s_id, s_doc, s_place, s_run = ids[doc[least]], doc[least], place[least], np.full(len(least), row["run"])
    for x in answers.to_pylist():
        at, *values = unpack(x["blob"], x["n"], "i4", "i8", "i8", "i4", "i4")
        s_id[at], s_run[at], s_doc[at], s_place[at] = values
    repeated = np.flatnonzero(ids[doc] > s_id[number])
    number, doc, place = number[repeated], doc[repeated], place[repeated]
    s_run, s_doc, s_place = s_run[number], s_doc[number], s_place[number]
    goes_on = (np.diff(doc) == 0) & (np.diff(place) == 1) & (np.diff(s_run) == 0) & (np.diff(s_doc) == 0) & (np.diff(s_place) == 1)
    at = np.flatnonzero(~np.append(False, goes_on)) if len(doc) else np.empty(0, np.int64)
    size = np.diff(at, append=len(doc)) + width - 1
    return pa.table({"run": np.full(len(at), row["run"]), "doc": doc[at], "start": place[at], "words": size.astype(np.int32), "s_run": s_run[at], "s_doc": s_doc[at], "s_start": s_place[at]})


CLAIM = "run long, doc int, start int, words int, s_run long, s_doc int, s_start int"


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The words that no span (start, length) covers."""
    out, at = [], 0
    for start, n in sorted(spans):
        out += words[at : max(at, start)]
        at = max(at, start + n)
    return out + words[at:]


CHECKED = "id long, run long, doc int, n_words long, n_removed long, kept_sha256 string, kept string, s_run long, s_doc int, s_start int, words int, digest binary"


def checked(texts: pa.Table, needs: pa.Table, full: bool) -> pa.Table:
    """Of one run: a row for each document, with the words that it claims cut; and a row for each passage that is claimed here or elsewhere, with its digest."""
    spans: dict[int, list] = {}
    for x in needs.to_pylist():
        spans.setdefault(x["doc"], []).append(x)
    rows = []
    for run, doc, id_, text in zip(texts.column("run").to_pylist(), texts.column("doc").to_pylist(), texts.column("id").to_pylist(), as_bytes(texts.column("text").combine_chunks()), strict=True):
        words, asked = text.split(), spans.get(doc, ())
        for x in asked:
            passage = b" ".join(words[x["start"] : x["start"] + x["words"]])
            rows.append({"s_run": x["s_run"], "s_doc": x["s_doc"], "s_start": x["s_start"], "words": x["words"], "digest": hashlib.blake2b(passage, digest_size=16).digest()})
        left = without(words, [(x["start"], x["words"]) for x in asked if x["mine"]])
        rows.append({"id": id_, "run": run, "doc": doc, "n_words": len(words), "n_removed": len(words) - len(left), "kept_sha256": sha(left), "kept": b" ".join(left).decode() if full else None})
    return pa.Table.from_pylist(rows, ARROW_CHECKED)


ARROW_CHECKED = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in CHECKED.split(", "))])


def by_run(texts: DataFrame, needs: DataFrame, full: bool) -> DataFrame:
    return texts.groupBy("run").cogroup(needs.groupBy("run")).applyInArrow(lambda t, n: checked(t, n, full) if t.num_rows else pa.Table.from_pylist([], ARROW_CHECKED), CHECKED)


def judged_by_words(tables: Tables, texts: DataFrame, claims: DataFrame, failed: DataFrame, width: int, bits: int, many: int, full: bool) -> DataFrame:
    """Rows of CHECKED for the documents with claims that failed: all windows whose hashes occur in these are judged by SHA-256 of their words."""
    source = ["s_run", "s_doc", "s_start", "words"]
    hurt = tables.cut(claims.join(failed, source, "left_semi"))
    size = max(64, FILTER_BYTES // many)

    def keys(t: pa.Table, spans: pa.Table) -> pa.Table:
        _, hashes, _, place = placed(t)
        full_ = passages(hashes, width, bits)
        at = [np.arange(place[x["doc"]] + x["start"], place[x["doc"]] + x["start"] + x["words"] - width + 1) for x in spans.to_pylist()] if t.num_rows else []
        return pa.table({"k": np.unique(full_[np.concatenate(at)]).view(np.int64) if at else np.empty(0, np.int64)})

    def placed(t: pa.Table):
        batch = t.select(["text"]).combine_chunks().to_batches()[0] if t.num_rows else pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"])
        firsts, hashes, left = windows(batch)
        return firsts, hashes, left, dict(zip(t.column("doc").to_pylist(), firsts[:-1].tolist(), strict=True))

    found = texts.groupBy("run").cogroup(hurt.groupBy("run")).applyInArrow(keys, "k long").distinct()
    marks = filter_of(found, "k", many, size)
    sent = tables.spark.sparkContext.broadcast((size, marks.bits.tobytes()))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Marks(many, sent.value[0], np.frombuffer(sent.value[1], np.uint8))
        for whole in batches:
            for batch in slices(whole, "text"):
                firsts, hashes, left = windows(batch)
                full_ = passages(hashes, width, bits)
                at = np.flatnonzero(left[: len(full_)] >= width)
                at = at[wanted.has(full_[at])]
                doc = np.searchsorted(firsts, at, side="right") - 1
                place = at - firsts[doc]
                words = {d: text.split() for d, text in enumerate(as_bytes(batch.column("text")))}
                digests = [hashlib.sha256(b" ".join(words[d][p : p + width])).digest() for d, p in zip(doc.tolist(), place.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(doc)) for c in ("run", "doc", "id")] + [pa.array(place, pa.int32()), pa.array(digests, pa.binary())], names=["run", "doc", "id", "start", "spelled"])

    all_ = tables.cut(texts.mapInArrow(spelled, "run long, doc int, id long, start int, spelled binary"))
    least = all_.groupBy("spelled").agg(F.min("id").alias("least"))
    again = all_.join(least, "spelled").where("id > least").select("run", "doc", "start", F.lit(width).alias("words"))
    held = claims.join(failed, source, "left_anti").select("run", "doc", "start", "words")
    docs = hurt.select("run", "doc").distinct()
    needs = again.unionByName(held).join(docs, ["run", "doc"]).select("*", *(F.lit(0).cast(t).alias(c) for c, t in (("s_run", "long"), ("s_doc", "int"), ("s_start", "int"))), F.lit(True).alias("mine"))
    return by_run(texts.join(docs, ["run", "doc"]), needs, full).where("id IS NOT NULL")


#: Bytes of the table's files that are written to one file, at least, if every core has work; bytes of such a file's row groups.
FILE_BYTES, GROUP_BYTES = 128 << 20, 16 << 20


def few_files(rows: DataFrame) -> int:
    """How many tasks write a table that is read once more: executors start processes for each folder and file that they write, and a file for every few MB is too many for a large table, too."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, min(size // FILE_BYTES, 1 << 20))


def dedup(spark: SparkSession, docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", full: bool = True, bits: int = 64) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 and, if full, kept): a row for each row of docs, read from work tables; kept is the words that stay, joined by one space. With fewer bits of the windows' hashes more of them agree by chance, and the result is the same."""
    many, tables = ranges(docs), Tables(spark, "substring")
    size = max(64, FILTER_BYTES // many)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = gathered_marks(anchors(rows.where("id IS NOT NULL"), width, many, size), many, size)
    sent = spark.sparkContext.broadcast((size, marks.bits.tobytes()))
    few = few_files(docs)
    written = tables.cut(probe(rows.coalesce(few), sent, width, bits, many, full), codec="zstd", group=GROUP_BYTES)
    texts = written.where("kind = 1").select("run", "doc", "id", "text")
    answers = written.where("kind = 3").select("run", "r", "n", "first", "blob").groupBy("r").applyInArrow(answer, "run long, n int, blob binary")
    own = written.where("kind = 2").select("run", "n", "first", "blob", "ids")
    # Claims are kept on the executors' disks till they are checked; if some are lost, they are worked out again from the written tables.
    claims = own.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(lambda o, a: claims_of(o, a, width), CLAIM).persist(StorageLevel.DISK_ONLY)
    mine = claims.withColumn("mine", F.lit(True))
    theirs = claims.select(F.col("s_run").alias("run"), F.col("s_doc").alias("doc"), F.col("s_start").alias("start"), "words", "s_run", "s_doc", "s_start").distinct().withColumn("mine", F.lit(False))
    done = tables.cut(by_run(texts, mine.unionByName(theirs), full).coalesce(few))
    digests = done.where("digest IS NOT NULL").groupBy("s_run", "s_doc", "s_start", "words").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    failed = digests.where("a <> b").select("s_run", "s_doc", "s_start", "words")
    results = done.where("id IS NOT NULL")
    if not failed.isEmpty():
        anew = tables.cut(judged_by_words(tables, texts, claims, tables.cut(failed), width, bits, many, full))
        results = results.join(anew.select("run", "doc"), ["run", "doc"], "left_anti").unionByName(anew, allowMissingColumns=True)
    claims.unpersist()
    columns = ["id", "n_words", "n_removed", "kept_sha256", *(["kept"] if full else [])]
    plain = written.where("kind = 0").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.col("text").alias("kept"))
    return plain.select(*columns).unionByName(results.select(*columns)).coalesce(few)
