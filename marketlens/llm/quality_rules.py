"""Line-first cleaning: rules judge each line, failing lines go, and a document that
loses too much of its text goes as a whole.

Everything is computed within the row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import SPACE, SPACE_CHARS, WORD, let, text_of, words_of

#: Characters that count as symbols in the base figures.
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window whose repetition counts.
WINDOW = 8

#: Sentence ends, and quotes and brackets that may close behind one.
TERMINAL = "[.!?:;…。！？؟।]"
CLOSING = "\"'”’»)]"
#: Separators of menus and paths; commas too, in a line without a sentence end.
SEPARATORS = r"[|»›·•]|[\x20\x09][/>][\x20\x09]"
COMMAS = r"[,，]"
ANY_SEPARATOR = r"[|»›·•/>]"
NOISE = r"[#*$%&]{2,}|[!?]{2,}"
BOILERPLATE = (r"cookie|privacy policy|terms of (use|service)|javascript|all rights reserved|lorem ipsum|subscribe"
               r"|sign (in|up)|log ?in|click here|read more|share (this|on)|skip to|powered by")
#: Every boilerplate phrase holds one of these; the lines of a text without any need no search.
HINTS = ("cookie", "privacy policy", "terms of ", "javascript", "all rights reserved", "lorem ipsum", "subscribe", "sign in", "sign up", "login", "log in",
         "click here", "read more", "share this", "share on", "skip to", "powered by")


@dataclass(frozen=True)
class Limits:
    """Production thresholds."""

    min_words: int = 20
    max_repeat_pct: int = 30
    #: navigation: at least so many separators, and one for at most so many words
    min_separators: int = 3
    words_per_separator: int = 4
    #: noise: at least so many runs of symbols, in at least so many of a hundred words
    min_noise: int = 2
    noise_pct: int = 30
    #: boilerplate: any phrase in a line of at most so many words, or one for at most so many
    boilerplate_words: int = 12
    words_per_boilerplate: int = 8
    #: a document that loses more than this share of its words goes
    max_lost_pct: int = 50


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Number of words inside windows of ``n`` words that occur at least twice."""
    windows = F.when(F.size(words) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n))))

    def covered(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(placed, lambda s: F.array_sort(F.filter(
            F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])),
            lambda x: x.isNotNull())))
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, x: F.struct(
            (a["total"] + n - F.greatest(F.lit(0), a["end"] - x)).alias("total"), (x + n).alias("end")), lambda a: a["total"])

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))


def line_verdicts(lines: Column, hinted: Column, limits: Limits) -> Column:
    """For each line: its number of words and whether a rule fails it; ``hinted`` tells whether the text holds a hint of boilerplate."""
    def judge(x: Column) -> Column:
        line, n = x["line"], x["n"]
        unended = ~F.right(F.rtrim(F.rtrim(line, F.lit(SPACE_CHARS)), F.lit(CLOSING)), F.lit(1)).rlike(TERMINAL)
        many = lambda k: (k >= limits.min_separators) & (k * limits.words_per_separator >= n)
        navigation = let(F.when(line.rlike(ANY_SEPARATOR), F.regexp_count(line, F.lit(SEPARATORS))).otherwise(0),
                         lambda k: many(k) | unended & let(k + F.regexp_count(line, F.lit(COMMAS)), many))
        noise = let(F.regexp_count(line, F.lit(NOISE)), lambda k: (k >= limits.min_noise) & (k * 100 >= n * limits.noise_pct))
        boilerplate = hinted & let(F.regexp_count(F.lower(line), F.lit(BOILERPLATE)),
                          lambda k: (k >= 1) & ((n <= limits.boilerplate_words) | (k * limits.words_per_boilerplate >= n)))
        return F.struct(line.alias("line"), n.alias("n"), unended.alias("unended"), navigation.alias("navigation"),
                        noise.alias("noise"), boilerplate.alias("boilerplate"))

    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return F.transform(counted, judge)


def failing(x: Column) -> Column:
    return x["unended"] | x["navigation"] | x["noise"] | x["boilerplate"]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per input row: id, base figures, line figures, verdicts and the cleaned text.

    A null text counts as empty: all figures 0, base_failed, not kept.  Repeated rows and
    equal ids are judged one by one, a null id is carried along, an empty table gives an
    empty result, and other columns of ``docs`` are not read.  Texts and lines of any length
    are judged whole.  ``clean_text`` is the text without its failing lines and blank lines.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    hinted = let(F.lower("_text"), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(h)) for h in HINTS]))
    split = base.select("_id", "_text", words_of(F.col("_text")).alias("_words"), lines.alias("_lines"), hinted.alias("_hinted"))
    judged = split.select(
        "_id", F.size("_words").cast("long").alias("n_words"),
        (F.char_length("_text") - F.regexp_count("_text", F.lit(rf"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        line_verdicts(F.col("_lines"), F.col("_hinted"), limits).alias("_verdicts"))
    count = lambda p: F.size(F.filter("_verdicts", p)).cast("long")
    lost = F.aggregate("_verdicts", F.lit(0), lambda a, x: a + F.when(failing(x), x["n"]).otherwise(0)).cast("long")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words"))
    figures = judged.select(
        "*", failed.alias("base_failed"), F.size("_verdicts").cast("long").alias("n_lines"),
        count(lambda x: x["unended"]).alias("n_unended_lines"), count(lambda x: x["navigation"]).alias("n_navigation_lines"),
        count(lambda x: x["noise"]).alias("n_noise_lines"), count(lambda x: x["boilerplate"]).alias("n_boilerplate_lines"),
        lost.alias("n_lost_words"),
        F.array_join(F.transform(F.filter("_verdicts", lambda x: ~failing(x)), lambda x: x["line"]), "\n").alias("clean_text"))
    kept = ~F.col("base_failed") & (100 * F.col("n_lost_words") <= limits.max_lost_pct * F.col("n_words"))
    return figures.select(F.col("_id").alias(id_col), *[c for c in figures.columns if c not in ("_id", "_verdicts")], kept.alias("kept"))
