"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with by at from this be an or "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que est pour dans qui par sur au pas avec "
    "el los las y que se un una del por con para no su es lo como más al"
).split()


class Rule(NamedTuple):
    """Fails where the feature is under ``least`` or over ``most`` (None: no bound)."""

    feature: str
    least: float | None
    most: float | None


#: Shares are of words or of lines with a word.
RULES = (
    Rule("n_words", 20, None),
    Rule("repeat_share", None, 0.30),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("bangs_per_word", None, 0.30),
    Rule("stop_share", 0.02, None),
    Rule("dup_line_share", None, 0.40),
    Rule("top_line_share", None, 0.90),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, each word counted once.

    Windows are compared by 64-bit hashes. Where some are equal, (hash, position) pairs are sorted, so equal ones stand
    together; the covered words follow from the gaps between the sorted positions.
    """

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        gaps = F.zip_with(F.slice(starts, 1, n - 1), F.slice(starts, 2, n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    def starts(pairs: Column) -> Column:
        def twin(pair: Column, k: Column) -> Column:
            hashed = pair["h"]
            return F.when((F.get(pairs, k + 1)["h"] == hashed) | (F.get(pairs, k - 1)["h"] == hashed), pair["at"])

        return F.sort_array(F.filter(F.transform(pairs, twin), lambda at: at.isNotNull()))

    def count(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        heavy = let(pairs, lambda p: let(starts(p), covered))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(heavy)

    def hashed(each: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(each) - (WINDOW - 1))
        return let(F.transform(at, lambda i: F.xxhash64(F.slice(each, i, WINDOW))), count)

    few = F.size(words) <= WINDOW
    return F.when(few, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def features(text: Column) -> Column:
    """A struct of the whole text's counts; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    inner = F.btrim(text, F.lit(WHITE))
    words = F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)

    def line_counts(x: Column) -> Column:
        listed = F.size(F.filter(x, lambda one: F.ltrim(one).rlike(r"^[-*•▪]|\.\.\.\s*$|…\s*$")))
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), listed.alias("n_list_lines"))

    def word_counts(x: Column) -> Column:
        stops = F.filter(x, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))
        return F.struct(F.size(x).alias("n_words"), F.size(stops).alias("n_stop"), _repeated_words(x).alias("n_repeat_words"))

    def without(chars: str) -> Column:
        return F.length(F.translate(text, chars, ""))

    return F.struct(
        let(words, word_counts).alias("w"),
        let(lines, line_counts).alias("l"),
        without(WHITE).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - without("!")).cast("long").alias("n_bangs"),
    )


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``failed_rules`` (names, comma-joined).

    Base: fewer than 20 words, or over 30 in 100 words inside repeated windows. A base failure is never kept; otherwise
    the table decides. Null and empty texts have no words and fail; repeated rows are judged alike.
    Whole texts are read, however long. A column of ``docs`` that has the name of one of these is replaced; others ride along.
    """
    counted = docs.withColumn("__f", features(F.col(f"`{text}`")))
    f = F.col("__f")
    n_words, n_lines = f["w"]["n_words"], f["l"]["n_lines"]
    share = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    values = {
        "n_words": n_words,
        "repeat_share": share(f["w"]["n_repeat_words"], n_words),
        "mean_word_chars": share(f["word_chars"], n_words),
        "symbols_per_word": share(f["n_symbols"], n_words),
        "bangs_per_word": share(f["n_bangs"], n_words),
        "stop_share": share(f["w"]["n_stop"], n_words),
        "dup_line_share": share(f["l"]["n_dup_lines"], n_lines),
        "top_line_share": share(f["l"]["n_list_lines"], n_lines),
    }
    fails = {
        r.feature: (F.lit(False) if r.least is None else values[r.feature] < r.least)
        | (F.lit(False) if r.most is None else values[r.feature] > r.most)
        for r in rules
    }
    repeats = f["w"]["n_repeat_words"].cast("long")
    base_failed = (n_words < 20) | (100 * repeats > 30 * n_words.cast("long"))
    failed = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in fails.items()])
    return counted.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in _ADDED],
        n_words.cast("long").alias("n_words"),
        f["word_chars"].alias("word_chars"),
        f["n_symbols"].alias("n_symbols"),
        f["l"]["n_dup_lines"].cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (failed == "")).alias("kept"),
        failed.alias("failed_rules"),
    )


_ADDED = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules", "__f"}
