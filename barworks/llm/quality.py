"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The rules beyond the base run in an order that is measured: on a bounded sample each rule is timed
and its rejections are counted, and rules go by rejections per second. The order changes only the
cost; a document is kept when no rule rejects it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barworks.llm.arrow import prepared
from barworks.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 500  # documents on which rules are timed; the order alone depends on it


def bound(value: Column, make) -> Column:
    """``make(value)`` with the value computed once, although lambdas use it for every element."""
    return F.transform(F.array(value), make)[0]


def words_of(text: Column) -> Column:
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    has_word = r"[^\x20\x09-\x0D]"
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(has_word))


def count_of(text: Column, pattern: str) -> Column:
    """Characters of a text that lie in matches of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text holds more than once.

    Windows are compared by 64-bit hashes; two of the n windows of a text clash with a probability
    of n * n / 2^65.
    """

    def marked(rows: Column) -> Column:
        """First words of repeated windows: equal windows are neighbours once sorted."""
        same = lambda a, b: F.coalesce(F.get(rows, a)["h"] == F.get(rows, b)["h"], F.lit(False))
        hit = F.filter(rows, lambda r, i: same(i - 1, i) | same(i, i + 1))
        return F.flatten(F.transform(hit, lambda r: F.array(r["i"], r["i"] + 1, r["i"] + 2)))

    def counted(windows: Column) -> Column:
        numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, F.size(F.array_distinct(bound(numbered, marked)))).otherwise(0)

    def windows(w: Column) -> Column:
        firsts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.transform(firsts, lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))

    return bound(words, lambda w: bound(windows(w), counted)).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines_of(F.col("text"))})
    facts = split.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count_of(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_words", "_lines")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return facts.withColumn("base_failed", failed)


def rules() -> dict[str, Column]:
    """Conditions that reject a document, by name, over its text and base columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("n_words")
    # Every character is a letter, white space, or one of few others, which are faster to find.
    letters = F.col("word_chars") - count_of(text, r"[^\p{L}\x20\x09-\x0D]+")
    return {
        "symbols": 10 * F.col("n_symbols") > words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words),
        "repeated_words": 5 * F.col("n_repeat_words") > 2 * words,
        "repeated_lines": bound(lines_of(F.col("text")), lambda x: 10 * F.col("n_dup_lines") > 5 * F.size(x)),
        "capitals": 2 * count_of(text, r"\p{Lu}+") > letters,
        "digits": 3 * count_of(text, "[0-9]+") > F.col("word_chars"),
        "exclamations": 3 * count_of(text, "[!?]+") > words,
        "few_letters": 2 * letters < F.col("word_chars"),
    }


def cascade(docs: DataFrame, conditions: dict[str, Column]) -> list[tuple[str, float]]:
    """Names of the rules with their rejections per second on a sample, best first."""
    sample = materialize(base_columns(docs.select("text")).where("NOT base_failed").limit(SAMPLE_ROWS))
    measured = []
    for name, condition in conditions.items():
        began = time.perf_counter()
        rejected = sample.agg(F.count(F.when(condition, 1))).first()[0]
        measured.append((name, rejected / (time.perf_counter() - began)))
    return sorted(measured, key=lambda x: (-x[1], x[0]))


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``; null texts have none, fail the base and are not kept. The
    verdict of the rules is the same in any order. Rows are independent, so repeated rows and ties
    give equal verdicts; an empty table gives an empty result. Input columns named like the base
    columns are replaced.
    """
    prepared(docs.sparkSession)
    conditions = rules()
    order = [name for name, _ in cascade(docs, conditions)]
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        verdict = verdict.when(conditions[name], F.lit(False))
    return base_columns(docs).withColumn("kept", verdict.otherwise(F.lit(True)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that :func:`judge` keeps, with their own columns."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text")))
    return judged.where("kept").select("_row.*")
