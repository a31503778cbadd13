"""Quality rules [native]: a threshold table compiled into one Spark projection.

Every measure is a JVM-side expression over the whole text, and RULES is the table that the projection is
compiled from: (name, numerator, denominator, lower bound, upper bound, least words). A document is kept if the
base rules hold and no row of the table rejects it. No user function runs anywhere.

Defined results: null text has no words and no lines; a text without words fails the base rule and is not kept;
repeated rows are judged one by one; other columns of the input are carried along unread. The measures live in one
struct column, `_q` or the name given as `into`, which replaces a column of that name; no other name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the languages served.
STOP_WORDS = {
    "en": "the be to of and that have with a in is it for on are this was by an from",
    "de": "der die und den von das mit sich des auf ein eine im dem nicht ist als für",
    "fr": "de la le et les des en un une du que est pour dans par sur au avec",
    "es": "de la que el en los del las un por con una su para es se al lo",
}

#: (name, numerator, denominator, least, most, words from which the rule applies)
RULES = [
    ("word_length", "word_chars", "n_words", 2.0, 10.0, 20),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.6, 20),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.02, None, 50),
    ("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5, 20),
    ("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.9, 50),
    ("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.5, 50),
]


def _pairs(values: Column, step: int) -> Column:
    """v[i] xor (v[i + step] << step) for each i that has both; shorter arrays give none.

    Steps of 1, 2 and 4 make, of the words' 64-bit hashes, the xor of eight hashes shifted by 0 to 7: of the last
    word's hash 57 bits still count.
    """
    n = F.size(values) - step
    return F.when(
        n > 0,
        F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + step), n), lambda a, b: a.bitwiseXOR(F.shiftleft(b, step))),
    ).otherwise(F.array().cast("array<bigint>"))


def _paired(step: int):
    return lambda values: _pairs(values, step)


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more; windows holds a hash for each start.

    Hashes are sorted beside their starts, equal neighbours mark repeated windows, and each marked start adds the
    words up to the next marked start, eight at most: n log n for any text.
    """
    marked = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def starts(s: Column) -> Column:
        n = F.size(s)
        ahead = F.concat(F.slice(s["h"], F.lit(2), n - 1), F.array(F.lit(None).cast("bigint")))
        behind = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(s["h"], F.lit(1), n - 1))
        near = F.zip_with(ahead, behind, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        hit = F.zip_with(s, near, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
        return F.sort_array(F.filter(hit, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        n = F.size(p)
        gaps = F.zip_with(F.slice(p, F.lit(2), n - 1), F.slice(p, F.lit(1), n - 1), lambda b, a: F.least(b - a, F.lit(WINDOW_WORDS)))
        return F.aggregate(gaps, F.lit(WINDOW_WORDS), lambda acc, g: acc + g).cast("bigint")

    at = F.transform(F.array(F.sort_array(marked)), starts)
    return F.transform(at, covered)[0]


def measures(df: DataFrame, text: str = "text", into: str = "_q") -> DataFrame:
    """df with a struct column of all counts; other columns are untouched."""
    words_, lines_ = free(df, "__weft_words"), free(df, "__weft_lines")
    t = F.coalesce(F.col(text), F.lit(""))
    spaces = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.trim(t, spaces)
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    # columns of their own, not fields of a struct: the optimizer would inline a struct's fields at each use
    df = df.withColumns(
        {
            words_: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+")),
            lines_: F.filter(F.split(t, "\n"), lambda line: F.trim(line, spaces) != ""),
        }
    )
    words, lines = F.col(words_), F.col(lines_)
    h8 = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):  # transform over a one-element array binds each array once
        h8 = F.transform(F.array(h8), _paired(step))[0]
    repeat = F.transform(
        F.array(h8),
        lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0).cast("bigint")).otherwise(_repeat_words(a)),
    )[0]
    return df.withColumn(
        into,
        F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "‣"))).cast("bigint").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("bigint").alias("n_ellipsis_lines"),
            F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(",.;:!?"))).isin(stops))).cast("bigint").alias("n_stop_words"),
        ),
    ).drop(words_, lines_)


def judged(df: DataFrame, text: str = "text", rules: list = RULES, into: str = "_q") -> DataFrame:
    """df with a struct column (counts, base_failed, kept and one boolean reject_<rule> for each row of the table)."""
    df = measures(df, text, into)
    q = {k: F.col(into)[k] for k in df.schema[into].dataType.names}
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    rejects = []
    for name, up, down, least, most, words in rules:
        ratio = q[up] / F.greatest(q[down], F.lit(1))
        out = F.lit(False)
        if least is not None:
            out = out | (ratio < least)
        if most is not None:
            out = out | (ratio > most)
        rejects.append(((q["n_words"] >= words) & out).alias(f"reject_{name}"))
    verdict = ~failed
    for r in rejects:
        verdict = verdict & ~r
    return df.withColumn(into, F.struct(*[c.alias(k) for k, c in q.items()], failed.alias("base_failed"), verdict.alias("kept"), *rejects))
