"""Quality rules: a table of thresholds compiled into Spark expressions of one projection; no user functions.

RULES is the table: a metric, a least and a most value (None: no bound). compile_rules() turns it into one boolean
Column; metrics() gives the Columns that the rules may name. All of it runs inside the JVM on whole texts, row by row,
with no shuffle.

Defined cases: a very long text is judged whole, like others. A null or empty text, or one of white space only, has no words and all counts zero; ratios over nothing
are zero. Rows with null or repeated ids are judged like any other. Columns of the input whose names clash with metrics
are left alone: the metrics are made of the text column only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    metric: str
    least: float | None = None
    most: float | None = None


#: Common function words of the four languages, without which running prose is rare.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "au", "be", "by", "das", "de", "del", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "est", "et", "for", "from", "für", "in", "is", "ist", "it", "la", "las", "le", "les", "los", "mit", "of", "on", "or", "para", "por", "pour", "que", "sich", "sur", "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with", "y", "zu")

#: The production table. A text is kept if every metric is within its bounds.
RULES = (
    Rule("n_words", least=10),
    Rule("mean_word_chars", least=2, most=15),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_word_ratio", most=0.2),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
)

#: The forms in which a stop word may stand in a text: small or with a capital, with or without a closing mark.
STOP_FORMS = tuple(sorted({form + mark for w in STOP_WORDS for form in (w, w.capitalize()) for mark in ("", ",", ".")}))

WORD_GAP, WINDOW = r"[\x20\x09-\x0D]+", 5


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words are in windows that the text has twice or more, the first included.

    Windows are numbered by a 64-bit hash of their words. Only a text in which some hash recurs is looked at further:
    places are sorted by hash, places whose neighbour in that order has the same hash are the repeated windows' starts,
    and sorted by place again each adds its width less what the start before it covered.
    """

    def recur(h: Column) -> Column:
        def starts(s: Column) -> Column:
            same = lambda i, j: (j >= 1) & (j <= F.size(s)) & (F.try_element_at(s, j)["h"] == F.try_element_at(s, i)["h"])
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.element_at(s, i)["p"]))

        covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["at"])).alias("n"), x.alias("at")), lambda acc: acc["n"])
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(ranked, starts), covered))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda _, i: F.xxhash64(*[F.element_at(words, i + k) for k in range(1, WINDOW + 1)]))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(_let(windows, recur))


def metrics(text: Column) -> dict[str, Column]:
    """Columns (n_words and the like as long, ratios as double) of a text column."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    all_lines = F.split(text, "\n", -1)

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        )

    words = _let(F.filter(F.split(text, WORD_GAP, -1), lambda w: w != ""), of_words)
    lines = _let(F.filter(all_lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    symbols = (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long")
    return {"w": words, "l": lines, "n_symbols": symbols}


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column `__m` of all metrics."""
    m = metrics(F.col(text_col))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def full(x: Column) -> Column:
        w, ln, s = x["w"], x["l"], x["s"]
        return F.struct(
            *[w[c].alias(c) for c in ("n_words", "word_chars", "n_stop_words", "n_repeat_words")], s.alias("n_symbols"),
            *[ln[c].alias(c) for c in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")],
            ratio(w["word_chars"], w["n_words"]).alias("mean_word_chars"), ratio(s, w["n_words"]).alias("symbol_ratio"), ratio(w["n_stop_words"], w["n_words"]).alias("stop_word_ratio"),
            ratio(w["n_repeat_words"], w["n_words"]).alias("repeat_word_ratio"), *[ratio(ln[f"n_{k}_lines"], ln["n_lines"]).alias(f"{k}_line_ratio") for k in ("dup", "bullet", "ellipsis")],
        )

    return docs.withColumn("__m", _let(F.struct(m["w"].alias("w"), m["l"].alias("l"), m["n_symbols"].alias("s")), full))


def compile_rules(rules: tuple[Rule, ...], of: Column) -> Column:
    """One boolean Column: whether the metrics in the struct `of` keep all the rules."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (of[r.metric] >= F.lit(r.least))
        if r.most is not None:
            out = out & (of[r.metric] <= F.lit(r.most))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, the metrics, base_failed and kept."""
    m = F.col("__m")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return measured(docs.select(F.col(id_col), F.col(text_col)), text_col).select(
        F.col(id_col), *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), (~failed & compile_rules(rules, m)).alias("kept"),
        *[m[c].alias(c) for c in ("n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")],
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs without the rows that break a rule."""
    m = F.col("__m")
    return measured(docs, text_col).where(compile_rules(rules, m)).drop("__m")
