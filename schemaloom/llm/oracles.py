"""DuckDB SQL of the queries that SQL can express over whole tables: vectors, quality rules, repeated passages, fingerprints and lines alike."""

from __future__ import annotations

import itertools

from schemaloom.llm.quality_rules import RULES, STOP_FORMS

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

EMBEDDINGS = """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings
  UNION
  SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u), degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.u LEFT JOIN degree d ON e.vec_id = d.u
"""


def quality() -> str:
    """The threshold table as SQL conditions over the same counts."""
    bounds = [c for r in RULES for c in ([f"{r.metric} >= {r.least}"] if r.least is not None else []) + ([f"{r.metric} <= {r.most}"] if r.most is not None else [])]
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_FORMS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 1))) t(i)),
recurring AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM recurring, range(5) r(k) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines, CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM d LEFT JOIN covered USING (doc_id)
), m AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio, coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_bullet_lines / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) AS ellipsis_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept, n_lines, n_stop_words, n_bullet_lines, n_ellipsis_lines FROM m
"""


PASSAGES = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM d, unnest(range(1, greatest(len(w) - 48, 1))) t(i)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id),
covered AS (SELECT DISTINCT doc_id, i + k AS p FROM gone, range(50) r(k)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (doc_id)
"""

#: All pairs of lines alike: such a pair shares one of the rarest fifth (and one more) of each line's shingles, in one order of all shingles.
LINES = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents
), raw AS (SELECT doc_id, k, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM split WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
texts AS (SELECT line, row_number() OVER (ORDER BY line) AS l FROM (SELECT DISTINCT line FROM raw)),
grams AS (SELECT DISTINCT l, substr(line, CAST(i AS BIGINT), 8) AS g FROM texts, unnest(range(1, greatest(length(line) - 6, 2))) t(i)),
sizes AS (SELECT l, count(*) AS n FROM grams GROUP BY l),
often AS (SELECT g, count(*) AS f FROM grams GROUP BY g),
ranked AS (SELECT l, g, row_number() OVER (PARTITION BY l ORDER BY f, g) AS r FROM grams JOIN often USING (g)),
heads AS (SELECT l, g FROM ranked JOIN sizes USING (l) WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.l AS u, b.l AS v FROM heads a JOIN heads b ON a.g = b.g AND a.l < b.l JOIN sizes x ON x.l = a.l JOIN sizes y ON y.l = b.l WHERE x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n),
shared AS (SELECT u, v, count(*) AS c FROM pairs JOIN grams a ON a.l = u JOIN grams b ON b.l = v AND a.g = b.g GROUP BY u, v),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.l = u JOIN sizes y ON y.l = v WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u, v FROM ways UNION SELECT r.u, w.v FROM reach r JOIN ways w ON r.v = w.u),
roots AS (SELECT u AS l, min(least(u, v)) AS root FROM reach GROUP BY u),
places AS (SELECT doc_id, k, row_number() OVER (PARTITION BY coalesce(root, l) ORDER BY doc_id, k) AS p FROM raw JOIN texts USING (line) LEFT JOIN roots USING (l)),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS text FROM split ANTI JOIN (SELECT doc_id, k FROM places WHERE p > 1) gone USING (doc_id, k) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (p > 1) AS n_removed FROM places GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: XXH64's five primes.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def xxh64(source: str, seed: int = 42) -> str:
    """SQL of (id, h uhugeint): XXH64 of the UTF-8 of each row's s, for a query of (id, s). Numbers stay below 2 ** 64 by remainders, as DuckDB's integers don't wrap."""
    p1, p2, p3, p4, p5 = PRIMES
    names, wrap = itertools.count(), 1 << 64
    big = lambda n: f"{n % wrap}::UHUGEINT"
    below = f"% {wrap}::UHUGEINT"
    times = lambda a, n: f"((({a}) * {big(n)}) {below})"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    turned = lambda x, r: f"(({x} * {big(1 << r)}) {below} + {x} // {big(1 << 64 - r)})"
    lane = lambda at, n: "(" + " + ".join(f"b[{at} + {j + 1}]::UHUGEINT * {big(1 << 8 * j)}" for j in range(n)) + ")"

    def let(value: str, body) -> str:
        name = f"x{next(names)}"
        return f"list_transform([{value}], lambda {name}: {body(name)})[1]"

    spun = lambda value, r: let(value, lambda x: turned(x, r))
    scrambled = lambda value: times(spun(times(value, p2), 31), p1)
    step = lambda h, k, r, n, more: f"(({spun(xor(h, k), r)} * {big(n)} + {big(more)}) {below})"
    lanes = ", ".join(f"list_reduce(list_transform(range(0, whole, 32), lambda o: {lane(f'o + {8 * k}', 8)}), lambda v, x: {times(spun(f'((v + {times("x", p2)}) {below})', 31), p1)}, {big(seed + start)}) AS v{k}" for k, start in enumerate((p1 + p2, p2, 0, -p1)))
    gathered = f"list_reduce([v0, v1, v2, v3], lambda h, v: (({xor('h', scrambled('v'))} * {big(p1)} + {big(p4)}) {below}), ({' + '.join(turned(f'v{k}', r) for k, r in enumerate((1, 7, 12, 18)))}) {below})"
    last = let(let(times(xor("h", f"h // {big(1 << 33)}"), p2), lambda x: times(xor(x, f"{x} // {big(1 << 29)}"), p3)), lambda x: xor(x, f"{x} // {big(1 << 32)}"))
    return f"""
SELECT id, {last} AS h FROM (
  SELECT id, list_reduce(list_transform(range(z, n), lambda o: {times("b[o + 1]::UHUGEINT", p5)}), lambda h, k: {step("h", "k", 11, p1, 0)}, h) AS h FROM (
    SELECT id, b, n, CASE WHEN n - z >= 4 THEN z + 4 ELSE z END AS z, CASE WHEN n - z >= 4 THEN {step("h", times(lane("z", 4), p1), 23, p2, p3)} ELSE h END AS h FROM (
      SELECT id, b, n, whole + (n - whole) // 8 * 8 AS z, list_reduce(list_transform(range(whole, n - 7, 8), lambda o: {scrambled(lane("o", 8))}), lambda h, k: {step("h", "k", 27, p1, p4)}, h {below}) AS h FROM (
        SELECT id, b, n, whole, CASE WHEN n < 32 THEN {big(seed + p5)} ELSE {gathered} END + n::UHUGEINT AS h FROM (
          SELECT id, b, n, whole, {lanes} FROM (
            SELECT id, b, len(b) AS n, len(b) // 32 * 32 AS whole FROM (
              SELECT id, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::UTINYINT) AS b FROM (
                SELECT id, hex(encode(s)) AS x FROM ({source})))))))))"""


def simhash() -> str:
    words = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    shingles = "SELECT doc_id AS id, array_to_string(w[i:i + 3], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, 2))) t(i) WHERE len(w) > 0"
    bits = " + ".join(f"CASE WHEN 2 * count(*) FILTER ((h >> {b}) & 1::UBIGINT = 1::UBIGINT) > count(*) THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents), hashes AS ({xxh64(shingles)}),
majority AS (SELECT id, ({bits})::UBIGINT AS fp FROM (SELECT id, h::UBIGINT AS h FROM hashes) GROUP BY id),
prints AS MATERIALIZED (SELECT d.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN majority ON d.doc_id = majority.id),
classes AS MATERIALIZED (SELECT fp, min(doc_id) AS first FROM prints GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp AS u, b.fp AS v FROM classes a JOIN classes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 4),
reach AS (SELECT fp AS u, fp AS v FROM classes UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(first) AS component_id FROM reach JOIN classes ON v = fp GROUP BY u)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN least ON fp = u
"""


SQL = {"op1_embedding_dedup": EMBEDDINGS, "op3_quality_rules": quality(), "op4_substring_dedup": PASSAGES, "op5_simhash": simhash(), "op10_line_dedup": LINES}
