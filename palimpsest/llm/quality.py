"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is one boolean expression over a text that says whether the text is rejected. On a sample, every rule
is run by itself: the time it takes is its cost, the share of texts that it rejects its selectivity. Rules are
then tried in order of rejection per cost, and a text that one rejects never meets the next: the cascade is
one conjunction, which Spark evaluates from the left and leaves at the first failure. The order changes the
cost alone, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import numbered, pick, position

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
SAMPLE_ROWS = 2000


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside lambdas a plain expression would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return let(inner, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t\\n\\x0B\\f\\r]+")))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words: all but white space."""
    t = F.coalesce(text, F.lit(""))
    bare = t
    for c in WHITE:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.char_length(bare).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def n_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(_lines(text)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column) -> Column:
    return _repeated(words(text)).cast("long")


def _doubled(step: int):
    def body(h: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(h) - step - 1), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + step)))
        return F.when(F.size(h) > step, pairs).otherwise(F.array().cast("array<bigint>"))

    return body


def _repeated(own: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, first occurrences included.

    Windows are named by 64-bit hashes, built by doubling: of 1, 2, 4, then 8 words. Only where two windows
    share a name are they sorted and their words counted.
    """
    names = let(own, lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):
        names = let(names, _doubled(step))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.get(s, k)["h"].eqNullSafe(F.get(s, k - 1)["h"]) | F.get(s, k)["h"].eqNullSafe(F.get(s, k + 1)["h"])), lambda k: F.get(s, k)["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(F.sort_array(again), start, lambda a, x: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - x, F.lit(0))).alias("n"), (x + WINDOW).alias("end")), lambda a: a["n"])

    return let(names, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


@dataclass(frozen=True)
class Rule:
    """rejects(metric) of a text, where metric(name) gives one of METRICS as a column."""

    name: str
    needs: tuple[str, ...]
    rejects: object


METRICS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_lines": n_lines}
BASE = (
    Rule("short", ("n_words",), lambda m: m("n_words") < 20),
    Rule("repetitive", ("n_repeat_words", "n_words"), lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
MORE = (
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 16 * m("n_words"))),
    Rule("lines", ("n_dup_lines", "n_lines"), lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
)


#: What op10 reports of every text. Other metrics are computed only where the cascade comes to a rule that needs them.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines), one row per input row.

    A null text has no words: all are 0. Rows with null or repeated ids keep their row; an empty table gives no rows.
    """
    return pick(df, doc_id=id_col, text=text_col).select("doc_id", *[METRICS[n](F.col("text")).alias(n) for n in names])


def profile(df: DataFrame, rules: tuple[Rule, ...] = (*BASE, *MORE), text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample of about `sample_rows` rows, best rejection per cost first.

    Rows are drawn evenly over the whole table; `2 * sample_rows` bounds the draw. Each rule runs once so that its code
    is compiled, and then twice for time; the shorter run, less the same for a rule that costs nothing, is its cost.
    Ties keep the order given. On an empty table nothing is rejected.
    """
    share = min(1.0, sample_rows / max(1, df.count()))
    sample = pick(df, text=text_col).sample(share, seed=11).limit(2 * sample_rows).cache()

    def timed(hit: Column) -> tuple[float, int]:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            n = sample.agg(F.count_if(hit)).first()[0]
            took.append(time.perf_counter() - began)
        return min(took[1:]), n

    try:
        size = max(1, sample.count())
        nothing, _ = timed(F.col("text") == "")
        out = []
        for rule in rules:
            took, n = timed(rule.rejects(lambda m: METRICS[m](F.col("text"))))
            out.append((rule, max(took - nothing, 1e-3), n / size))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda x: -(x[2] + 1e-6) / x[1])


def accepted(df: DataFrame, rules: tuple[Rule, ...] | None = None, text_col: str = "text") -> DataFrame:
    """df's rows, all columns, that no rule rejects; rules in the order given, else as profiled on df.

    A null text has no words and is judged as an empty one. Repeated rows are judged alike, so all copies stay or go; an
    empty table gives no rows. The order of rules, ties of the profile included, changes no verdict.
    """
    if rules is None:
        rules = tuple(r for r, _, _ in profile(df, text_col=text_col))
    plain, text = numbered(df), F.col(f"c{position(df, text_col)}")
    for rule in rules:
        plain = plain.where(~rule.rejects(lambda m: METRICS[m](text)))
    return plain.toDF(*df.columns)


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, REPORTED..., base_failed, kept): no base rule rejects and no rule of the cascade does, one row per row.

    Reported metrics are due for every text; the cascade reuses them, and computes what else its rules need only for
    texts that come that far. A null text counts as empty and fails; rows with null or repeated ids keep their row, and
    equal texts get equal verdicts. An empty table gives no rows.
    """
    order = [r for r, _, _ in profile(df, more, text_col)]
    own = pick(df, doc_id=id_col, text=text_col)
    rows = own.select("doc_id", "text", *[METRICS[n](F.col("text")).alias(n) for n in REPORTED])
    m = lambda name: F.col(name) if name in REPORTED else METRICS[name](F.col("text"))
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | rule.rejects(m)
    cascade = F.when(F.col("base_failed"), False)
    for rule in order:
        cascade = cascade.when(rule.rejects(m), False)
    return rows.withColumn("base_failed", base_failed).withColumn("kept", cascade.otherwise(True)).drop("text")
