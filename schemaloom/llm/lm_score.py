"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts (after Talbot and Osborne, 2007).

Tokens are lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` and one end of text. Documents train unless crc32(id as text)
mod 10 is 0. Counts of pairs of neighbours are quantised, exactly up to 7 and beyond that in steps of a quarter octave;
a pair with level q is put into the filter once for each level up to q. A probe asks level after level until one is
missing, and the middle of the last level found is the count. With c(v) the exact count of v, q(vw) the probed count of
the pair (at most that of v and of w) and p(w) the smoothed share of w among all tokens, which the base score also has,

    P(w | v) = (q(vw) + m p(w)) / (c(v) + m),   m = 4 + c(v) / 2.

The p(w) of all words and of one unknown word add up to 1, and the counts of the pairs that begin with v to c(v), so P is
a probability for each v, but for what quantising counts above 7 (within a tenth, errors cancel) and 0.4% of false hits add.

1. Each task reads whole texts, in runs of bounded size, and writes for each run its tokens as numbers in the run's own
   word list. By hash range the lists' hashes and training counts meet in tasks.
2. Each run sends its distinct pairs, held-out ones too, with training counts, sorted and packed, to the task of their hash range.
3. The task of a range sums the counts, and answers every run's list: words with their exact counts over all training
   documents, pairs from the range's segment of the filter, which it fills with their levels.
4. Each run is scored with the answers to its own lists.

The filter is sized by what was counted: LEVEL_BITS bits for each level that is put in, so 2 probes hit wrongly in 0.4%
at every size of corpus. It is never in one place: a segment lives in the task of its range, and neither the driver nor a
broadcast holds any of it. Every document is counted and scored whole.

Defined cases: ids are whole numbers. A very long text is a run of its own. A null or empty text is one token, the end. A null id counts as held out (as crc32 of an empty text).
Repeated rows count and are scored each. Extra columns are ignored. With no training documents all counts are 0, V is
0, and every score is 0 or negative and finite. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.words import mixed, span_hashes, word_places
from schemaloom.llm.work import Tables, buffers, by_range, pack, ranges, rises, slices, unpack

PROBES = 2
#: The least count of each level, from 1 on.
LEAST = np.unique(np.concatenate([np.arange(1, 9), np.ceil(2.0 ** np.arange(3, 62, 0.25))])).astype(np.int64)
#: Bits of the filter for each level of a pair: (1 - exp(-PROBES / LEVEL_BITS)) ** PROBES of foreign keys hit, 0.4%.
LEVEL_BITS = 32
#: Tokens of a run, about.
RUN_TOKENS = 1 << 20
#: Tokens that are scored together.
PIECE = 1 << 17
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
FLOOR = 0.1
#: The weight of a word's own share against the pairs of a context: so much, and so much for each time the context occurs.
PRIOR, PRIOR_SHARE = 4.0, 0.5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a batch's texts, each text's followed by the end, and the place of each text's first (n + 1)."""
    data, offsets = buffers(batch.column("text"))
    starts, ends, firsts = word_places(data, offsets)
    hashes = span_hashes(LOWER[data], starts, ends)
    return np.insert(hashes, firsts[1:], END), firsts + np.arange(len(firsts))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Tokens, first places and ids of runs of texts of bounded size."""
    toks, sizes, ids, count = [], [], [], 0
    for whole in batches:
        for batch in slices(whole, "text"):
            t, first = tokens(batch)
            toks.append(t)
            sizes.append(np.diff(first))
            ids += batch.column("id").to_pylist()
            count += len(t)
            if count >= RUN_TOKENS:
                yield np.concatenate(toks), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), ids
                toks, sizes, ids, count = [], [], [], 0
    if ids:
        yield np.concatenate(toks), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), ids


def pairs_of(toks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it in its text, or the start."""
    before = np.empty_like(toks)
    before[1:] = toks[:-1]
    before[first[:-1]] = START
    return pair_hash(before, toks)


def pair_hash(before: np.ndarray, toks: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) ^ (toks + np.uint64(0x632BE59BD9B4E019)))


class Levels:
    """The log-frequency filter. Keys' high bits choose the segment, so tasks fill segments of their own."""

    def __init__(self, many: int, size: int, bits: np.ndarray):
        self.many, self.size, self.bits = many, size, bits

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
        h = mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        for _ in range(PROBES):
            yield ((h >> np.uint64(32)) * np.uint64(size * 8) >> np.uint64(32)).astype(np.int64)
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level)

    @classmethod
    def segment(cls, keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        flags = np.zeros(size * 8, bool)
        level = quantised(counts)
        for q in range(1, int(level.max(initial=0)) + 1):
            for at in cls.places(keys[level >= q], q, size):
                flags[at] = True
        return np.packbits(flags, bitorder="little")

    @classmethod
    def sized(cls, keys: np.ndarray, counts: np.ndarray) -> Levels:
        """One segment of the size that the levels of these distinct keys need."""
        size = max(64, int(quantised(counts).sum()) * LEVEL_BITS // 8)
        return cls(1, size, cls.segment(keys, counts, size))

    def level(self, keys: np.ndarray) -> np.ndarray:
        base = ((keys >> np.uint64(32)) * np.uint64(self.many) >> np.uint64(32)).astype(np.int64) * self.size
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for q in range(1, len(LEAST) + 1):
            has = np.ones(len(left), bool)
            for at in self.places(keys[left], q, self.size):
                has &= (self.bits[base[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
            left = left[has]
            out[left] = q
            if not len(left):
                break
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The middle of the level that each key has, 0 for none."""
        return middle(self.level(keys))


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level."""
    last = np.append(LEAST[1:] - 1, LEAST[-1])
    return np.append(0.0, (LEAST + last) / 2)[level]


def quantised(counts: np.ndarray) -> np.ndarray:
    """The level of each count, 0 for 0."""
    return np.searchsorted(LEAST, counts, side="right")


def probability(pair: np.ndarray, context: np.ndarray, word: np.ndarray, base: float) -> np.ndarray:
    """P(w | v) from the probed count of the pair and the exact ones of both words."""
    prior = PRIOR + PRIOR_SHARE * context
    return (np.minimum(pair, np.minimum(context, word)) + prior * (word + FLOOR) / base) / (context + prior)


def summed(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of the lists of one range: their lengths, the distinct keys, each key's place among these, and the counts' sums."""
    ns = table.column("n").to_pylist()
    parts = [unpack(b.as_py(), n, "u8", "i4") for b, n in zip(table.column("blob"), ns, strict=True)]
    keys, number = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    return ns, keys, number, np.bincount(number, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def scored(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of docs."""
    many, tables = ranges(docs), Tables(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for toks, first, ids in runs(batches):
            run = part << 32 | k
            k += 1
            words, number = np.unique(toks, return_inverse=True)
            out = held_out(ids)
            trains = np.repeat(~out, np.diff(first))
            counts = np.bincount(number[trains], minlength=len(words)).astype(np.int32)
            docs_ = pack(np.diff(first).astype(np.int32), np.array([0 if i is None else i for i in ids], np.int64), out.astype(np.int8), np.array([i is None for i in ids], np.int8))
            rs, ns, blobs, more, own = [-1], [len(toks)], [pack(number.astype(np.int32))], [docs_], [pack(rises(words))]
            for r, p in by_range(words, many):
                rs.append(r)
                ns.append(p.stop - p.start)
                blobs.append(pack(rises(words[p]), counts[p]))
                more.append(b"")
                own.append(b"")
            same = lambda x: pa.array([x] * len(rs), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(rs), pa.int64()), pa.array(rs, pa.int32()), pa.array(ns, pa.int32()), same(len(ids)), same(len(words)), pa.array(blobs, pa.binary()), pa.array(more, pa.binary()), pa.array(own, pa.binary())], names=["run", "r", "n", "docs", "words", "blob", "more", "own"])

    written = tables.cut(rows.mapInArrow(write, "run long, r int, n int, docs int, words int, blob binary, more binary, own binary"))
    texts = written.where("r = -1").drop("r")

    def answer(table: pa.Table) -> pa.Table:
        ns, _, number, total = summed(table)
        blobs = [pack(c) for c in np.split(total[number], np.cumsum(ns)[:-1])]
        zeros = [0] * len(ns)
        return pa.table({
            "run": pa.array(table.column("run").to_pylist() + [-1], pa.int64()), "r": pa.array([table.column("r")[0].as_py()] * (len(ns) + 1), pa.int32()), "n": pa.array(ns + [0], pa.int32()),
            "blob": pa.array(blobs + [b""], pa.binary()), "total": pa.array(zeros + [int(total.sum())], pa.int64()), "distinct": pa.array(zeros + [int((total > 0).sum())], pa.int64()),
        })

    lists = tables.cut(written.where("r >= 0").select("run", "r", "n", "blob").groupBy("r").applyInArrow(answer, "run long, r int, n int, blob binary, total long, distinct long"))
    n_train, v_train = lists.where("run = -1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of a run: its words, its tokens as numbers of these, its pairs, and lengths, ids, held out and null by document."""
        (number,) = unpack(row["blob"], row["n"], "i4")
        about = unpack(row["more"], row["docs"], "i4", "i8", "i1", "i1")
        words = np.cumsum(unpack(row["own"], row["words"], "u8")[0], dtype=np.uint64)
        return words, number, pairs_of(words[number], np.concatenate([[0], np.cumsum(about[0])])) >> np.uint64(20), about

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                _, _, pairs, (lengths, _, out, _) = read(row)
                trains = np.repeat(out == 0, lengths)
                order = np.argsort(pairs)
                pairs = pairs[order]
                at = np.flatnonzero(np.diff(pairs, prepend=pairs[0] + np.uint64(1)))
                counts, pairs = np.add.reduceat(trains[order].astype(np.int32), at), pairs[at] << np.uint64(20)
                parts = list(by_range(pairs, many))
                yield pa.RecordBatch.from_arrays([pa.array([row["run"]] * len(parts), pa.int64()), pa.array([r for r, _ in parts], pa.int32()), pa.array([p.stop - p.start for _, p in parts], pa.int32()), pa.array([pack(rises(pairs[p] >> np.uint64(20)), counts[p]) for _, p in parts], pa.binary())], names=["run", "r", "n", "blob"])

    def answer_pairs(table: pa.Table) -> pa.Table:
        ns, keys, number, total = summed(table)
        level = Levels.sized(keys[total > 0], total[total > 0]).level(keys).astype(np.uint8)
        return pa.table({"run": table.column("run"), "r": table.column("r"), "n": table.column("n"), "pairs": pa.array([pack(q) for q in np.split(level[number], np.cumsum(ns)[:-1])], pa.binary())})

    pairs = texts.mapInArrow(send, "run long, r int, n int, blob binary").groupBy("r").applyInArrow(answer_pairs, "run long, r int, n int, pairs binary")
    answers = lists.where("run >= 0").select("run", "r", "n", "blob", F.lit(None).cast("binary").alias("pairs")).unionByName(pairs.withColumn("blob", F.lit(None).cast("binary")))
    base = n_train + FLOOR * (v_train + 1)

    def score(text: pa.Table, found: pa.Table) -> pa.Table:
        keys, number, pair, (lengths, ids, out, null) = read(text.to_pylist()[0])
        n, found = len(number), found.sort_by("r").to_pylist()
        # Ranges follow the order of keys, so the answers by range are in the order of the run's sorted words and pairs.
        counts = np.concatenate([unpack(x["blob"], x["n"], "i8")[0] for x in found if x["pairs"] is None])
        pair_counts = middle(np.concatenate([unpack(x["pairs"], x["n"], "u1")[0] for x in found if x["pairs"] is not None]))
        known = np.unique(pair)
        first = np.concatenate([[0], np.cumsum(lengths)])
        starts = counts[np.searchsorted(keys, END)]  # texts begin as often as they end
        opens, score_ = np.zeros(n, bool), np.empty(n, np.float64)
        opens[first[:-1]] = True
        for at in range(0, n, PIECE):
            own = slice(at, min(n, at + PIECE))
            previous = np.arange(at - 1, own.stop - 1)
            both = pair_counts[np.searchsorted(known, pair[own])]
            context = np.where(opens[own], starts, counts[number[previous]])
            score_[own] = np.log10(probability(both, context, counts[number[own]], base))
        add = lambda x: np.add.reduceat(x, first[:-1])
        table = {
            "id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(out.astype(bool)), "n_tokens": lengths.astype(np.int64), "n_known": add((counts > 0).astype(np.int64)[number]), "train_tokens": np.full(len(lengths), n_train, np.int64),
            "base_score": add(np.log10((counts + FLOOR) / base)[number]), "score": add(score_),
        }
        return pa.table(table)

    kinds = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(score, kinds)
