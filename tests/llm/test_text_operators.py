"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import gc
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from schemaloom.llm import bpe, line_dedup, lm_score, mixing, quality_rules, simhash, substring_dedup, toxicity, work
from schemaloom.llm.queries import table, vocabulary
from schemaloom.llm.words import span_hashes, window_hashes, word_places

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, tag string, fp string, node int, numbers string, copies int, place int, copy int, toxic string, n_lines int, n_tokens int, key int, component_id int, size string, block int"


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pool = ["alpha", "Beta", "gamma,", "delta.", "éclair", "straße", "#tag", "the", "of", "and", "zeta|eta", "x"] + [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(pool) for _ in range(80))
    out = [None, "", " \t\n ", "one", "One two three four five six", "\v\f\r a b  c", "x " * 5000]
    for k in range(60):
        body = "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 9)))
        out += [body] * rng.choice([1, 1, 1, 3])
        if k % 5 == 0:
            out += [body + "\n" + passage, passage[: len(passage) // 2 + 40] + " " + body, body.replace("w1", "v1", 1), body + " tail"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % 1009, t, "en", None if i % 11 == 0 else f"s{i % 4}" if i % 3 else "hot", 0 if t is None else len(t), *([i, "x", "y", 1, "z", 2, 3, 4, "t", 5, 6, 7, 8, "s", 9])) for i, t in enumerate(texts)]
    rows += [(None, "no id here but words", "en", "s1", 5, *([None] * 15)), rows[10], rows[10]]
    return spark.createDataFrame(rows, CLASH).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def test_quality_rules(docs, empty):
    got = Counter(tuple(r) for r in quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        w, t = words(r.text), r.text or ""
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w))] += 1
    assert got == want
    kept = quality_rules.judge(docs)
    assert kept.where("kept AND base_failed").count() == 0 and 0 < kept.where("kept").count() < kept.count()
    assert quality_rules.keep_good(docs).columns == docs.columns and quality_rules.judge(empty).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and kept.schema["n_words"].dataType.simpleString() == "bigint"


def test_substring_dedup(spark, docs, empty):
    first = {}
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        w = words(r.text)
        for k in range(len(w) - 49):
            if r.doc_id is not None:
                first[tuple(w[k : k + 50])] = min(r.doc_id, first.get(tuple(w[k : k + 50]), math.inf))
    want = Counter()
    for r in rows:
        w, lose = words(r.text), set()
        for k in range(len(w) - 49):
            if r.doc_id is not None and first[tuple(w[k : k + 50])] < r.doc_id:
                lose.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in lose)
        want[(r.doc_id, len(w), len(lose), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    got = Counter(tuple(r) for r in substring_dedup.dedup(spark, docs).select("id", "n_words", "n_removed", "kept_sha256", "kept").collect())
    assert got == want and sum(k[2] for k in want) > 1000
    few = Counter(tuple(r) for r in substring_dedup.dedup(spark, docs, bits=4).select("id", "n_words", "n_removed", "kept_sha256", "kept").collect())
    assert few == want  # nearly all windows share a hash with others
    assert substring_dedup.dedup(spark, empty).count() == 0


def plain_fingerprint(t, width):
    w = words(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(len(w) - width + 1)] or [xxhash.xxh64_intdigest(" ".join(w).encode(), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, near):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_many_small_files_of_documents_don_t_make_many_work_files(spark, docs, tmp_path, monkeypatch):
    """Executors start processes for each folder and file that they write."""
    monkeypatch.setattr(work, "shared_dir", lambda _: f"file://{tmp_path}")
    docs.select("doc_id", "text").repartition(40).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = substring_dedup.dedup(spark, spark.read.parquet(f"{tmp_path}/docs"), full=False)
        most = 2 * spark.sparkContext.defaultParallelism
        assert got.rdd.getNumPartitions() <= most
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    tables = list(tmp_path.glob("*/t*"))
    assert len(tables) == 2 and all(len(list(t.glob("*.parquet"))) <= most for t in tables)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, substring_dedup.dedup(spark, docs, full=False).collect()))


def test_pieces_hold_whole_ranges():
    records = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 400_000, np.uint64))
    records[1000:200_000] = records[1000]  # one range that is larger than a piece
    for many in (1, 7, 51, 70_000):
        pieces = list(substring_dedup.in_pieces(records, many))
        assert (np.concatenate(pieces) == records).all() and (many == 1) == (len(pieces) == 1)
        assert [(r, p.stop - p.start) for x in pieces for r, p in work.by_range(x, many)] == [(r, p.stop - p.start) for r, p in work.by_range(records, many)]
    assert not list(substring_dedup.in_pieces(records[:0], 7))


def test_simhash(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    prints = {(r.doc_id, r.text): plain_fingerprint(r.text, 4) for r in rows}
    of = {}
    for (i, _), p in prints.items():
        if i is not None:
            of.setdefault(i, set()).add(p)
    comp = plain_components(sorted(of), lambda a, b: any((x ^ y).bit_count() <= 4 for x in of[a] for y in of[b]))
    got = simhash.simhash_components(spark, docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.id, r.fp % (1 << 64), r.component_id) for r in got) == Counter((r.doc_id, prints[r.doc_id, r.text], comp.get(r.doc_id)) for r in rows)
    assert simhash.simhash_components(spark, empty).count() == 0 and simhash.keep_one(spark, empty).count() == 0
    left = simhash.keep_one(spark, docs)
    assert left.columns == docs.columns and left.where("doc_id IS NULL").count() == 1 and left.where("trim(text) = ''").select("doc_id").distinct().count() <= 1


def test_blocks_find_all_near_pairs():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    x[1500:] = x[:1500] ^ (np.uint64(1) << rng.integers(0, 63, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 1500).astype(np.uint64))
    want = {(int(min(i, j)), int(max(i, j))) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4), strict=True) if i != j}
    got = {(min(p), max(p)) for i, j in simhash.near(x, None, 4) for p in zip(i.tolist(), j.tolist(), strict=True)}
    across = {(p[0], p[1] + 1500) for i, j in simhash.near(x[:1500], x[1500:], 4) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == want and {(a, b) for a, b in want if a < 1500 <= b} == across


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(40)]
    near = [" ".join("new" if k in (50, 150) else w for k, w in enumerate(t.split())) for t in base[:20]]
    df = spark.createDataFrame(list(enumerate(base + near)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(spark, df).collect()) == list(range(40))


def test_documents_alike_by_exact_similarity(spark):
    """Pairs around the limit, against all pairs compared."""
    rng, rows = random.Random(12), ["", " \n", "one", "One ", "two three four five six", "Two three four five six"]
    for k in range(150):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        rows.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            for at in rng.sample(range(len(v)), max(1, int(len(v) * rng.choice([0.005, 0.015, 0.02, 0.025, 0.03, 0.05])))):
                v[at] = "x"
            rows.append(" ".join(v))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (lower(t).split() for t in rows)]
    comp = plain_components(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.id: r["head"] for r in simhash.alike(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got.keys() == comp.keys() and sum(got[i] != comp[i] for i in comp) <= 2 and 50 < sum(comp[i] != i for i in comp) < 290
    assert all(comp[got[i]] == comp[i] for i in got)  # what isn't alike is never joined


def test_line_dedup(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    gone = line_dedup.brute_force(sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=lambda r: (r[0], r[1] or "")))
    want = Counter()
    for r in rows:
        lose, lines = gone.get(r.doc_id, set()), (r.text or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in lose)
        want[(r.doc_id, sum(bool(words(x)) for x in lines), len(lose), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in line_dedup.digest(spark, docs).collect()) == want and sum(k[2] for k in want) > 50
    out = line_dedup.dedup(spark, docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert line_dedup.dedup(spark, empty).count() == 0


def test_large_line_components_in_tiles(spark):
    lines = [f"the same long line of text with a number somewhere {k:05d} and then it goes on and on until the end of it all" for k in range(1300)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    out = line_dedup.digest(spark, df).collect()
    assert sorted(r.id for r in out if r.n_removed == 0) == [0]


def test_lm_scores(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    toks = [[*words(lower(r.text)), None] for r in rows]
    held = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10 == 0 for r in rows]
    c = Counter(t for w, h in zip(toks, held, strict=True) if not h for t in w)
    n, v = sum(c.values()), len(c)
    base = lambda w: round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 6)
    want = Counter((r.doc_id, h, len(w), sum(c[t] > 0 for t in w), n, base(w)) for r, w, h in zip(rows, toks, held, strict=True))
    got = lm_score.scored(spark, docs).collect()
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm_score.scored(spark, empty).count() == 0
    none = lm_score.scored(spark, spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [r.train_tokens for r in none] == [0, 0] and all(math.isfinite(r.score) for r in none)


def test_lm_beats_the_base_on_held_out_texts(spark):
    got = lm_score.scored(spark, table(spark, SF, "documents")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_quantised_levels():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    counts = np.random.default_rng(2).integers(1, 1000, 2000)
    size = 1 << 17
    filter_ = lm_score.Levels(1, size, lm_score.Levels.segment(keys, counts, size))
    assert (filter_.level(keys) >= lm_score.quantised(counts)).all() and (filter_.level(keys) == lm_score.quantised(counts)).mean() > 0.95
    some = np.arange(1, 100_000)
    assert (lm_score.middle(lm_score.quantised(some[:7])) == some[:7]).all() and (np.abs(lm_score.middle(lm_score.quantised(some)) / some - 1) < 0.1).all() and lm_score.quantised(np.array([0]))[0] == 0


def test_the_filter_grows_with_what_is_counted():
    rng = np.random.default_rng(4)
    for n in (1000, 300_000):
        keys, counts = rng.integers(0, 1 << 62, n, dtype=np.uint64), rng.integers(1, 9, n)
        filter_ = lm_score.Levels.sized(keys, counts)
        assert (filter_.level(keys) >= lm_score.quantised(counts)).all()
        assert (filter_.level(rng.integers(1 << 62, 1 << 63, 100_000, dtype=np.uint64)) > 0).mean() < 0.006
    assert len(filter_.bits) == lm_score.quantised(counts).sum() * lm_score.LEVEL_BITS // 8


def test_lm_scores_against_counted_pairs(spark, docs):
    """Against the same model with exact counts and no filter, which is a probability for every context."""
    rows = docs.select("doc_id", "text").collect()
    toks = [[*words(lower(r.text)), None] for r in rows]
    held = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10 == 0 for r in rows]
    c = Counter(t for w, h in zip(toks, held, strict=True) if not h for t in w)
    both = Counter(p for w, h in zip(toks, held, strict=True) if not h for p in zip(["<start>", *w], w))
    all_ = sum(c.values()) + 0.1 * (len(c) + 1)
    seen = c | {"<start>": c[None]}

    def p(a, b):
        m = 4 + seen.get(a, 0) / 2
        return (both[a, b] + m * (c[b] + 0.1) / all_) / (seen.get(a, 0) + m)

    for a in ["<start>", "the", "alpha", "w7", "never seen"]:
        assert sum(p(a, b) for b in [*c, "unknown"]) == pytest.approx(1)
    got = {r.id: r.score for r in lm_score.scored(spark, docs).collect()}
    off = [abs(got[r.doc_id] - sum(math.log10(p(a, b)) for a, b in zip(["<start>", *w], w))) / len(w) for r, w in zip(rows, toks, strict=True)]
    assert np.mean(off) < 0.005 and max(off) < 0.1, (np.mean(off), max(off))
    assert sum(x < 1e-6 for x in off) >= 0.3 * len(off)  # the rest are large counts and false hits


def test_lm_counts_add_up_after_quantising():
    counts = np.random.default_rng(3).zipf(1.6, 5000).clip(max=10**6)
    assert abs(lm_score.middle(lm_score.quantised(counts)).sum() / counts.sum() - 1) < 0.03


def test_lm_tells_what_occurs_twice(spark):
    rng = random.Random(3)
    once = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(once + once[:20])]
    got = {r.id: r for r in lm_score.scored(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[i].score for i in range(20) if not got[i].held_out and not got[200 + i].held_out]
    assert min(twice) > np.quantile([got[i].score for i in range(20, 200)], 0.95)


def test_mixing(spark, docs, empty):
    mix = mixing.Mix(spark, docs)
    rows = mix.rows().collect()
    again = mixing.Mix(spark, docs.repartition(3)).rows().collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == docs.count()
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * 9, strict=False))
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        for s in over or list(open_):
            target[s] = 3 * sizes[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over or open_)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= max(60, 0.05 * target[s], largest[s]) for s in sizes)
    assert mixing.Mix(spark, empty).rows().count() == 0 and mixing.mixed(spark, docs).columns == docs.columns
    total = mixing.mixed(spark, docs).select(F.sum(mixing.size_of(F.col("text"))).alias("n")).first().n
    assert abs(total - sum(taken.values())) <= 3 * 120  # a row that is there three times comes for each
    shards = mix.shards(docs, 4)
    assert shards.agg(F.max("shard")).first()[0] <= 3 and shards.select("shard", "place", "copy", "doc_id").distinct().count() > 50


def test_mixing_against_a_plain_version(spark, docs):
    """Which documents are taken how often, from the same lots, by plain sums."""
    for frame in (docs, table(spark, SF, "documents")):
        mix = mixing.Mix(spark, frame)
        by_source: dict = {}
        for r in mix.chosen.collect():
            by_source.setdefault(r.source, []).append(r)
        for source, rows in by_source.items():
            size, target, blocks = mix.sizes[source], mix.targets[source], max(1, -(-len(rows) // mixing.BLOCK_DOCS))
            times = int(target // size) if size else 0
            need, before, want = target - times * size, 0, Counter()
            in_block: dict = {}
            for r in rows:
                in_block.setdefault(((r.lot % (1 << 64)) >> 33) * blocks >> 31, []).append(r)
            for b in sorted(in_block):
                words_ = sum(r.size for r in in_block[b])
                alike: dict = {}
                for r in in_block[b]:
                    alike.setdefault((r.lot, r.size, r.id), []).append(r)
                if before + words_ <= need:
                    extra = set(alike)
                elif before >= need:
                    extra = set()
                else:
                    extra, left = set(), need - before
                    for key in sorted(alike):
                        w = key[1] * len(alike[key])
                        if 0 < w <= left:
                            extra.add(key)
                            left -= w
                    over = [(key[1] * len(alike[key]), key) for key in sorted(alike) if key not in extra and left < key[1] * len(alike[key]) < 2 * left]
                    extra |= {min(over)[1]} if over else set()
                for key, same in alike.items():
                    want[key] += len(same) * (0 if not key[1] else times + (key in extra))
                before += words_
            got = Counter()
            for r in rows:
                got[r.lot, r.size, r.id] += r.copies
            assert got == want, source


def test_shards_of_the_query_have_their_quotas(spark):
    from schemaloom.llm.queries import op9_mixing

    # 3,000 documents of three sources, of which the mix takes a part of the first, and more than all of the last.
    df = spark.createDataFrame([(i, " ".join(["w"] * (5 + i % 7)), "abc"[0 if i < 600 else 1 if i < 900 else 2]) for i in range(3000)], "doc_id long, text string, source string")
    mix = mixing.Mix(spark, df)
    _, totals = mix.quotas()
    quota = {s: b * t + e for s, b, e, t in totals}
    drawn, rows = {}, mix.dealt(4).collect()
    for r in rows:
        assert len(r.shards) == len(r.places) == r.copies
        for c, k in enumerate(r.shards):
            drawn.setdefault((r.source, k), set()).add((r.block, c))
    order = sorted(quota)
    want = mixing.split_tree(np.array([quota[s] for s in order]), 4)
    assert [[len(drawn.get((s, k), ())) for s in order] for k in range(4)] == want.tolist()
    assert all(drawn.get((s, k)) for s in order for k in range(4))
    got = Counter((r.doc_id, r.copy, r.shard, r.place) for r in mix.shards(df, 4).collect())
    assert got == Counter((r.id, c + 1, r.shards[c], r.places[c]) for r in rows for c in range(r.copies))
    docs = table(spark, SF, "documents")
    assert all(len(r.shards) * r.size == r.taken for r in op9_mixing(spark, SF).collect()) and mixing.mixed(spark, docs).count() > 0


def test_splitting_tree():
    quotas = np.array([100, 37, 3, 0, 1])
    rows = mixing.split_tree(quotas, 7)
    assert (rows.sum(axis=0) == quotas).all() and rows.sum(axis=1).max() - rows.sum(axis=1).min() <= 1 and (rows >= 0).all()
    assert (rows == mixing.split_tree(quotas, 7)).all()
    shares = np.mean([mixing.split_tree(quotas, 7, seed)[0] for seed in range(300)], axis=0)
    assert np.allclose(shares, quotas / 7, atol=0.8)


def test_targets():
    t = mixing.targets([("a", 100), ("b", 10), ("c", 1000), (None, 5)])
    assert t["b"] == 30 and t[None] == 15 and sum(t.values()) == pytest.approx(1115) and t["a"] == 300 and mixing.targets([]) == {}


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), tuple(ids), back)] += 1
    got = bpe.encoded(spark, docs, vocabulary())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got.collect()) == want
    assert bpe.encoded(spark, empty, vocabulary(), keep=("doc_id",), more=()).count() == 0


def test_bpe_automaton_against_the_library():
    from tokenizers import Tokenizer

    tok, codec, rng = Tokenizer.from_file(vocabulary()), bpe.Codec(bpe.Automaton(bpe.read_file(vocabulary()))), random.Random(4)
    parts = ["a", "aa", "the", "  ", "\n", "\t", "é", "ß", "<|endoftext|>", "<|endof", "|>", "1", "23", "'s", "'re", "!!", "$$$", "th", "ing", "　", "\xa0", "\x1c", "😀", "中"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)] + [chr(c) * 2 + " " + chr(c) + "b" for c in range(1, 0x3100, 3)] + ["a" * 700, " " * 500]
    for t, e in zip(some, tok.encode_batch(some, add_special_tokens=False), strict=True):
        code = codec.encode(t)
        assert np.frombuffer(code, "<u4").tolist() == e.ids, t
        assert codec.decode(code).decode() == tok.decode(e.ids, skip_special_tokens=False)


def peak_mb(run):
    """MB that a call takes at most, and what it returns."""
    gc.collect()
    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, out


def test_tokenizer_tables_take_little_memory():
    """Each worker of an executor holds them beside its JVM."""
    file = bpe.read_file(vocabulary())

    def made():
        machine = bpe.Automaton(file)
        for n in range(300_000):  # answers about arcs are kept beside the tables
            machine.arc(n % 50_000, n // 6)
        return machine, tracemalloc.get_traced_memory()[0] / 1e6

    most, (_, kept) = peak_mb(made)
    assert kept < 60 and most < 90, (kept, most)


def test_hashes_of_long_texts_take_little_memory():
    """Equal spans and windows have equal hashes wherever they lie, a very long word too."""
    text = [b"w" * 400_000, *(b"%d" % (k % 70_000) for k in range(350_000)), b"w" * 400_000]
    data = np.frombuffer(b" ".join(text), np.uint8)
    starts, ends, _ = word_places(data, np.array([0, len(data)]))
    most, hashes = peak_mb(lambda: span_hashes(data, starts, ends))
    assert most < 60, most
    assert hashes[0] == hashes[-1] and (hashes[1:280_001] == hashes[70_001:-1]).all() and len(np.unique(hashes)) == 70_001
    assert (hashes[[0, 5]] == [span_hashes(np.frombuffer(w, np.uint8), np.zeros(1, int), np.array([len(w)]))[0] for w in (text[0], text[5])]).all()
    most, wide = peak_mb(lambda: window_hashes(hashes, 50))
    assert most < 12, most
    assert len(wide) == len(hashes) - 49 and (wide[1:279_952] == wide[70_001:349_952]).all() and len(np.unique(wide)) == 70_000 + 2


def test_automaton_by_gadgets_on_a_toy_vocabulary():
    """Against the definition: merge the leftmost pair of the least rank until none is left."""
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "b"), ("aa", "b"), ("ab", "ab")]
    vocab = {w: i for i, w in enumerate(["a", "b", *(x + y for x, y in merges)])}
    machine = bpe.Automaton({"model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}, "pre_tokenizer": {"type": "ByteLevel"}})
    rank = {m: i for i, m in enumerate(merges)}
    for n in range(1, 11):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            out = list(word)
            while pairs := [(rank[p], k) for k in range(len(out) - 1) if (p := (out[k], out[k + 1])) in rank]:
                k = min(pairs)[1]
                out[k : k + 2] = [out[k] + out[k + 1]]
            assert machine.encode_word(word.encode()) == [vocab[x] for x in out], word


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    clean = [" ".join(f"word{rng.randrange(200)}" for _ in range(80)) for _ in range(300)]
    foul = [c + " " + " ".join(rng.sample(["idiotic", "vilely", "scummy", "trashy"], rng.randrange(1, 4))) for c in clean[:60]]
    texts = clean + foul
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(len(texts)) if i % 2] + [(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    assert len(model.thresholds) >= 2 and (np.diff(model.thresholds) >= 0).all()
    out = {r.doc_id: r for r in toxicity.scored(spark, df, model, ("doc_id",)).collect()}
    assert all(not out[i].toxic for i in range(300)) and sum(out[i].toxic for i in range(300, 360)) >= 57
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.severity_grade <= 3 and r.toxic == (r.severity_grade > 0) for r in out.values())
    kept = toxicity.keep_clean(spark, df, model)
    assert kept.columns == df.columns and kept.where("doc_id < 300").count() == 300
    assert toxicity.scored(spark, docs, model).count() == docs.count() and toxicity.scored(spark, empty, model).count() == 0
    nothing = toxicity.train(df, labels.where("false"))
    assert toxicity.scored(spark, df, nothing, ("doc_id",)).where("toxic").count() == 0


def ranks(x):
    x = np.asarray(x, float)
    return np.array([((x < v).sum() + (x <= v).sum()) / 2 for v in x])


def test_expected_severity_ranks_held_out_texts(spark):
    """Texts are fouled to a known degree, of which training sees only whether it is zero; held-out texts are ranked by it."""
    rng, foul = random.Random(4), [f"{a}{b}" for a in ("idi", "scu", "vil", "tra", "wre") for b in ("otic", "mmy", "ely", "shy", "tch")]
    rows = []
    for i in range(1200):
        degree = 0 if i % 3 else rng.randrange(1, 9)
        w = [f"word{rng.randrange(300)}" for _ in range(90)] + rng.sample(foul, degree)
        rng.shuffle(w)
        rows.append((i, " ".join(w), degree))
    df = spark.createDataFrame(rows, "doc_id long, text string, degree int")
    model = toxicity.train(df, df.where("doc_id % 2 = 0").select("doc_id", F.expr("int(degree > 0)").alias("toxic")))
    out = toxicity.scored(spark, df.where("doc_id % 2 = 1"), model).collect()
    foul_ = [r for r in out if r.degree]
    assert sum(r.toxic for r in foul_) >= 0.9 * len(foul_) and not any(r.toxic for r in out if not r.degree)
    assert np.corrcoef(ranks([r.degree for r in foul_]), ranks([r.expected_severity for r in foul_]))[0, 1] > 0.85


def test_toxicity_does_not_depend_on_order(spark, docs):
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", F.expr("int(doc_id % 3 = 0)").alias("toxic"))
    one, two = (toxicity.train(docs.repartition(n), labels.repartition(n)) for n in (2, 5))
    assert one.index == two.index and np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(d, lab.where("doc_id % 2 = 0"))
    out = toxicity.scored(spark, d, model, ("doc_id",)).join(lab.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    assert sum(r.toxic and r.y for r in out) >= 0.6 * sum(r.y for r in out) and sum(r.toxic and not r.y for r in out) <= 0.02 * len(out)


def test_shingle_numbers_lose_nothing():
    rng = random.Random(6)
    for letters in ("abcdefgh éß中😀\0", [chr(c) for c in range(0x4E00, 0x9000)]):
        some = ["", "a", "abcdefg", "abcdefgh"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(200)]
        for a, x in zip(line_dedup.shingle_sets(some), some, strict=True):
            for b, y in zip(line_dedup.shingle_sets(some)[::9], some[::9], strict=True):
                assert len(np.intersect1d(a, b)) == len(line_dedup.shingles(x) & line_dedup.shingles(y))


def test_large_line_components_of_unlike_lines(spark, monkeypatch):
    """A chain of lines, each like the next, and lines like none, with tiles of few lines, so that all of the ways through verified() are taken."""
    monkeypatch.setattr(line_dedup, "TILE", 6)
    rng, texts = random.Random(7), []
    for _ in range(4):
        x = [rng.choice("abcdefghij ") for _ in range(90)]
        for _ in range(40):
            texts.append("".join(x))
            at = rng.randrange(82)
            x[at : at + rng.randrange(1, 4)] = [rng.choice("abcdefghij ") for _ in range(2)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = line_dedup.brute_force(rows)
    assert {r.id for r in line_dedup.digest(spark, df).collect() if r.n_removed} == set(gone) and 20 < len(gone) < 156
