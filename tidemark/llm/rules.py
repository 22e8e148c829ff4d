"""Quality rules: a threshold table compiled into one projection, in DataFrame operations only.

:data:`MEASURES` holds the columns a text is measured by, :data:`THRESHOLDS` the bounds on
their ratios.  :func:`judge` turns both into plain expressions over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field

WHITE, SYMBOLS, MIN_WORDS = "\t\n\x0b\x0c\r", "[#*$%&|<>]", 50
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that with for was this are by on be from "
    "der die und den von zu mit ist nicht ein eine für auf im "
    "le la les des est que un une dans pour qui sur pas du "
    "el los las una por con para como del no se"
).split()


@dataclass(frozen=True)
class Threshold:
    """A ratio of two measures that must lie between two bounds (None: open)."""

    name: str
    top: str
    bottom: str
    low: float | None
    high: float | None


THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2.0, 12.0),
    Threshold("symbols_per_word", "n_symbols", "n_words", None, 0.15),
    Threshold("shouting_words", "n_upper_words", "n_words", None, 0.4),
    Threshold("stop_words", "n_stop_words", "n_words", 0.02, None),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", None, 0.4),
)


def _repeat_words(windows: Column, grams: Column) -> Column:
    """Words inside windows that occur more than once: each repeated window adds the words up to the next, three at most."""
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def repeated(sorted_pairs: Column) -> Column:
        same = F.filter(sorted_pairs, lambda x, i: (x["g"] == F.get(sorted_pairs, i - 1)["g"]) | (x["g"] == F.get(sorted_pairs, i + 1)["g"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    # A one-element transform binds a value that is used several times, so it is computed once.
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), bind(pairs, lambda p: bind(repeated(p), covered))).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """Counts over the whole of every text, one row per input row.

    Null, empty and blank texts have no words, and every count is 0.
    """
    text = F.coalesce(field(docs, "text", "string"), F.lit(""))
    split = docs.select(
        field(docs, "doc_id", "long").alias("doc_id"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \t-\r]")).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(windows, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    listed = split.withColumn("grams", grams).withColumn("joined", F.array_join("words", ""))
    return listed.select(
        "doc_id", n.cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(windows, F.col("grams")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_upper_words"),
    )


def broken(rule: Threshold) -> Column:
    """True where a ratio is outside its bounds; a ratio over nothing breaks no rule."""
    top, bottom = F.col(rule.top), F.col(rule.bottom)
    outside = F.lit(False)
    if rule.low is not None:
        outside = outside | (top < rule.low * bottom)
    if rule.high is not None:
        outside = outside | (top > rule.high * bottom)
    return outside


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The measures, the base rule, the names of broken thresholds and the verdict of every row.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated
    three-word windows.  ``kept``: neither that nor any threshold broken.
    """
    measured = measure(docs)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(broken(t), F.lit(t.name)) for t in thresholds]))
    return measured.withColumn("base_failed", base).withColumn("broken", failed).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
