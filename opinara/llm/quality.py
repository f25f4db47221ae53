"""Quality rules: a threshold table compiled into one Spark projection.

All measures are built-in column functions; no user function runs.  Words are
``[^\\x20\\x09-\\x0D]+``.  A text's words are read once into an array, and each
further measure is one pass over that array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WINDOW = 8

# Frequent function words of four languages, lower case.
STOP_WORDS = (
    "the of and to in is that for it on with as was are be by this at or an from "
    "le la les de des du un une et en que qui dans pour sur au par est pas il elle ou "
    "der die das und zu den von mit ist des auf dem ein eine nicht im für sich auch er sie "
    "el los las y a del se por con no su al lo como para es más o"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; None is no bound."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are those of ``measures`` and the ratios of ``ratios``.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.3),
)


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def measures(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words of each text.

    ``keep`` columns must not have these names.  Windows of eight words are compared
    by a 64-bit hash of their words' hashes, inside one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in keep]
    read = docs.select(
        *kept,
        words_of(F.col(text_col)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "").alias("_lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    counted = read.select(
        *kept,
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    others = [c for c in counted.columns if c != "_hashes"]
    windows = counted.select(
        *[f"`{c}`" for c in others],
        F.expr(
            f"CASE WHEN size(_hashes) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE "
            f"transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({', '.join(f'get(_hashes, i + {k})' for k in range(WINDOW))})) END"
        ).alias("_win"),
    )
    # texts without a repeated window, nearly all, skip the sort
    ranked = windows.select(
        *[f"`{c}`" for c in others],
        F.expr(
            "CASE WHEN size(_win) = size(array_distinct(_win)) THEN cast(array() AS array<struct<h:bigint,i:int>>) "
            "ELSE sort_array(transform(_win, (h, i) -> struct(h, i))) END"
        ).alias("_sorted"),
    )
    placed = ranked.select(
        *[f"`{c}`" for c in others],
        F.expr(
            "sort_array(filter(transform(_sorted, (e, k) -> CASE WHEN e.h <=> get(_sorted, k - 1).h OR e.h <=> get(_sorted, k + 1).h THEN e.i END), p -> p IS NOT NULL))"
        ).alias("_at"),
    )
    covered = f"aggregate(transform(_at, (p, k) -> least({WINDOW}, coalesce(get(_at, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)"
    # an expression that is not deterministic keeps filters on the result above the measures,
    # which would otherwise be written out into the filter and computed many times over
    return placed.select(*[f"`{c}`" for c in others], F.expr(f"{covered} + 0 * spark_partition_id()").alias("n_repeat_words"))


def ratios() -> dict[str, Column]:
    """Derived measures by name; a ratio over nothing is null and breaks no rule."""
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "repeat_word_ratio": F.col("n_repeat_words") / words,
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column for a threshold table."""
    known, good = ratios(), F.lit(True)
    for rule in rules:
        value = known.get(rule.measure, F.col(rule.measure))
        if rule.low is not None:
            good = good & F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            good = good & F.coalesce(value <= rule.high, F.lit(True))
    return good


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, the measures, base_failed, kept.

    Null and empty texts have no words and fail the base rule.  Repeated rows are
    judged alike, other columns are ignored, an empty table gives no rows.
    """
    got = measures(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), "_text", ["_id"])
    return got.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        base_failed().alias("base_failed"), (~base_failed() & compiled(rules)).alias("kept"),
    )


def kept_rows(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns unchanged, whatever their names;
    nulls and repeats as in ``judge``, an empty table gives no rows."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return measures(packed, "_text", ["_row"]).where(~base_failed() & compiled(rules)).select("_row.*")
