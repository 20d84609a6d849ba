"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features: words (runs of letters, digits and apostrophes, lower-cased) and word beginnings of 3 to 8 characters, each
counted once a distinct word. Of these the model keeps the ones that labelled texts of the two kinds use differently
enough to be no accident. One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k); the
output is the expected severity, the sum of these over k, and a text is rejected where P(grade > 0) > 0.5.

Grades of severity are ordered: 0 clean, then toxic texts in GRADES - 1 grades. Labels only say toxic or not, so a toxic
text's grade is its rank, among toxic ones, by how sure models are of it that have not seen it: the labelled texts are
dealt into FOLDS by a hash of their words, a model of two grades with features of its own is fitted without each fold,
and the fold's texts are scored by it. So grades are not made of the features that the final model selects and fits.

Fitting takes a bounded sample of labelled rows, about `sample` documents, chosen by a hash of their ids so that it
does not depend on order or partitions (a parameter; 8,000 unless told otherwise); the driver gets their distinct words.
Everything else covers all rows and whole texts, in one pass with no shuffle; the model that is sent to the executors is
bounded by `features`.

Defined cases: ids of labels are whole numbers. A null or empty text has no features and the severity of a text without
marks; a very long text is scored whole. Null ids and repeated rows are scored like others; of documents that share a
labelled id one, chosen by a hash of its text, is fitted. Labels whose id or grade is null are left out; of several
labels of an id the highest counts. With no labels, or labels of one kind only, nothing is rejected and severity is 0.
Columns of labels whose names clash with documents' do no harm: only the named ones are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.work import give_back, tidy

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
SHORTEST, LONGEST = 3, 8
#: A feature's value is the number of distinct words that have it, up to this.
MOST = 8
GRADES, FOLDS = 4, 3


def parts(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings with a mark that sets them apart."""
    return [word, *(word[:n] + "*" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def counts(self, words: set[str], kept: dict[str, tuple[int, ...]]) -> Counter:
        out: Counter = Counter()
        for w in words:
            if (ids := kept.get(w)) is None:
                ids = tuple(self.index[p] for p in parts(w) if p in self.index)
                if len(kept) > 500_000:
                    kept.clear()
                kept[w] = ids
            if ids:
                out.update(ids)
        return out

    def above(self, counts: Counter) -> np.ndarray:
        """P(grade > k) for each threshold."""
        x = sum(float(self.weights[i]) * min(n, MOST) for i, n in counts.items())
        return 1 / (1 + np.exp(-np.clip(x - self.thresholds, -60, 60)))


    def sure(self, counts: list[Counter]) -> np.ndarray:
        """w.x of texts given by their features."""
        return np.array([sum(float(self.weights[i]) * min(n, MOST) for i, n in c.items()) for c in counts])


#: A text's distinct words in order; equal words of texts are one object.
Words = tuple[str, ...]


def tally(texts: list[Words], index: dict[str, int]) -> list[Counter]:
    """For each text, given by its distinct words, how many of them have each feature of the index."""
    kept: dict[str, tuple[int, ...]] = {}
    counts = []
    for words in texts:
        out: Counter = Counter()
        for w in words:
            if (ids := kept.get(w)) is None:
                if len(kept) > 200_000:
                    kept.clear()
                ids = kept[w] = tuple(index[p] for p in parts(w) if p in index)
            if ids:
                out.update(ids)
        counts.append(out)
    return counts


def frequent(texts: list[Words], most: float) -> dict[str, int]:
    """How many texts have each feature that at least so many have. Longer beginnings are counted only where shorter ones are frequent, so few are held."""
    often: dict[str, int] = {}
    for n in range(SHORTEST, LONGEST + 1):
        has: Counter = Counter()
        for words in texts:
            has.update({w[:n] for w in words if len(w) >= n and (n == SHORTEST or w[: n - 1] + "*" in often)})
        often.update({p + "*": k for p, k in has.items() if k >= most})
    has = Counter()
    for words in texts:
        has.update({w for w in words if len(w) < SHORTEST or w[:LONGEST] + "*" in often})
    return often | {p: k for p, k in has.items() if k >= most}


def select(texts: list[Words], toxic: np.ndarray, features: int, least: int = 4, share: float = 0.015, gain: float = 20.0) -> dict[str, int]:
    """The features that toxic texts have more often than clean ones, most telling first.

    A feature needs a likelihood ratio of `gain` and a share of the toxic texts, so that a few copies of one text don't
    make all its words telling. Only features that enough toxic texts have are counted among the clean ones.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    often = frequent([t for t, y in zip(texts, toxic, strict=True) if y], max(least, share * n1))
    names = sorted(often)
    rest: Counter = Counter()
    for c in tally([t for t, y in zip(texts, toxic, strict=True) if not y], {p: i for i, p in enumerate(names)}):
        rest.update(c.keys())
    found, n = [], n1 + n0
    for i, p in enumerate(names):
        k, m = often[p], rest[i]
        if k * n0 <= 4 * m * n1:
            continue
        cells = ((k, n1 * (k + m)), (m, n0 * (k + m)), (n1 - k, n1 * (n - k - m)), (n0 - m, n0 * (n - k - m)))
        ratio = 2 * sum(o * np.log(o * n / e) for o, e in cells if o)
        if ratio >= gain:
            found.append((-ratio, p))
    return {p: i for i, (_, p) in enumerate(sorted(found)[:features])}


NOTHING = (np.zeros(0), np.array([60.0]))


def weighed(index: dict[str, int], counts: list[Counter], grade: np.ndarray, rounds: int, decay: float) -> Model:
    """The cumulative-link model of graded texts. Plain gradient steps with momentum from zero, so the same rows give the same model."""
    row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    col = np.array([i for c in counts for i in c], np.int64)
    val = np.minimum(np.array([n for c in counts for n in c.values()], float), MOST)
    levels = np.arange(grade.max())
    y = grade[:, None] > levels  # n x K
    w, theta = np.zeros(len(index)), np.linspace(2, 4, len(levels))
    mw, mt, n = np.zeros_like(w), np.zeros_like(theta), len(grade)
    vw, vt = np.zeros_like(w), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        x = np.bincount(row, val * w[col], n)
        p = 1 / (1 + np.exp(-np.clip(x[:, None] - theta, -60, 60)))
        e = (p - y) / n
        gw = np.bincount(col, val * e.sum(axis=1)[row], len(w)) + decay * w / n
        gt = -e.sum(axis=0)
        for g, m, v, at in ((gw, mw, vw, w), (gt, mt, vt, theta)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            at -= 0.1 * (1 - (step - 1) / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        np.maximum(w, 0, out=w)  # all features kept are marks of toxicity
        theta.sort()
    return Model(index, w, theta)


def severity(texts: list[Words], toxic: np.ndarray, features: int, rounds: int, decay: float) -> np.ndarray:
    """Grades: 0 for clean texts, and for toxic ones 1 to GRADES - 1 by the rank of the score that a model without their fold gives."""
    fold = np.array([zlib.crc32(" ".join(t).encode()) % FOLDS for t in texts])
    score = np.zeros(len(texts))
    for k in range(FOLDS):
        own, rest = np.flatnonzero((fold == k) & toxic), np.flatnonzero(fold != k)
        some = [texts[i] for i in rest]
        index = select(some, toxic[rest], features) if toxic[rest].any() and not toxic[rest].all() else {}
        if index and len(own):
            model = weighed(index, tally(some, index), toxic[rest].astype(int), rounds, decay)
            score[own] = model.sure(tally([texts[i] for i in own], index))
    grade = np.zeros(len(texts), np.int64)
    at = np.flatnonzero(toxic)
    cuts = np.quantile(score[at], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade[at] = 1 + np.searchsorted(cuts, score[at], side="left")
    return np.unique(grade, return_inverse=True)[1]  # grades that nobody has are closed up


def fit(texts: list[Words], toxic: np.ndarray, features: int = 4096, rounds: int = 1500, decay: float = 0.005) -> Model:
    """The model of labelled texts, given by their distinct words."""
    toxic = np.asarray(toxic, bool)
    none = Model({}, *NOTHING)
    if not toxic.any() or toxic.all():
        return none
    once = sorted(set(zip(texts, map(bool, toxic), strict=True)))  # a copy says nothing new
    texts, toxic = [t for t, _ in once], np.array([y for _, y in once])
    index = select(texts, toxic, features)
    if not index:
        return none
    return weighed(index, tally(texts, index), severity(texts, toxic, features, rounds // 4, decay), rounds, decay)


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Fits on about `sample` labelled documents."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(toxic_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    total = known.count()
    share = 1 << 20 if total <= sample else max(1, int((1 << 20) * sample / total))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).groupBy("id").agg(F.max("toxic").alias("toxic"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(known), "id")
    some = some.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([" ".join(sorted(words_of(t))) for t in batch.column("text").to_pylist()], pa.string()), batch.column("toxic")], names=["id", "words", "toxic"])

    rows = some.mapInArrow(distinct_words, "id long, words string, toxic int").collect()  # a row for each id of the sample
    rows.sort(key=lambda r: r["id"])
    known: dict[str, str] = {}
    texts, toxic = [tuple(known.setdefault(w, w) for w in r["words"].split()) for r in rows], np.array([r["toxic"] > 0 for r in rows], bool)
    del rows, known
    model = fit(texts, toxic)
    del texts
    give_back()
    return model


OUTPUT = ("expected_severity", "severity_grade", "toxic")


def scored(spark: SparkSession, docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None, text_col: str = "text", names: tuple[str, str, str] = OUTPUT) -> DataFrame:
    """The columns `keep` of docs (None: all that aren't called like the output) with expected_severity double, severity_grade int and toxic boolean."""
    keep = tuple(c for c in docs.columns if c not in names) if keep is None else keep
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept = sent.value, {}
        for batch in batches:
            above = [m.above(m.counts(words_of(t), kept)) for t in batch.column("__text").to_pylist()]
            made = [pa.array([float(a.sum()) for a in above], pa.float64()), pa.array([int((a > 0.5).sum()) for a in above], pa.int32()), pa.array([bool(a[0] > 0.5) for a in above], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *names])

    kinds = ("double", "int", "boolean")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))])
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(tidy(run), schema)


def keep_clean(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects, with the columns of docs whatever they are called."""
    return scored(spark, docs, model, None, text_col, ("__severity", "__grade", "__toxic")).where("NOT __toxic").select(*docs.columns)
