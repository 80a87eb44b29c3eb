"""Line-first cleaning with DataFrame functions only.

Every line is judged alone (punctuation, navigation, boilerplate, shouting, repetition); failing lines
go; a document that loses too much of its text goes with them. Base measures of the whole text decide
first. All work is per row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contract, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line that ends so has terminal punctuation.
ENDS = r"[.!?:;…。！？][\"')\]»”’]*\z"
#: Short lines with one of these are boilerplate.
BOILERPLATE = r"(?i)(all rights reserved|licensed under|released under|terms of (use|service)|privacy policy|cookie|click here|read more|subscribe|sign up|copyright|powered by|javascript)"
#: Short lines that start so are navigation.
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(home|menu|next|previous|back|skip|log ?in|sign in|search|share)([^A-Za-z]|\z)"
MIN_WORDS = 50
MAX_LOST = 0.5


def word_list(text: Column) -> Column:
    """The words of a text: maximal runs without white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(without(text, letters))


def line_failures(line: Column) -> Column:
    """True where a line (with a word) fails a rule that looks at nothing but the line."""
    t = F.rtrim(line, F.lit(BLANKS))
    n = F.size(word_list(line))
    symbols, bars = count_of(line, SYMBOLS), count_of(line, "|»›•·")
    upper = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    lower = F.length(line) - F.length(F.regexp_replace(line, r"\p{Ll}", ""))
    return (
        ((n < 8) & ~t.rlike(ENDS))
        | ((symbols >= 3) & (10 * symbols > 3 * n))
        | ((bars >= 3) & (5 * bars > n))
        | ((n <= 6) & t.rlike(NAVIGATION))
        | ((n <= 25) & t.rlike(BOILERPLATE))
        | ((n >= 3) & (upper > 2 * lower))
    )


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_lost: float = MAX_LOST) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, cleaned, kept.

    ``cleaned`` is the text without the lines that failed. A null or empty text has no words, fails the
    base and is not kept; rows are independent, so ties and repeats need no rule; other columns are
    ignored. Repeated three-word windows are found by 64-bit hashes within one document.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("id", "text", word_list(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.length(without(x, " \t\r\x0b\x0c")) > 0).alias("lines"))
    w, n = F.col("w"), F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    d = d.select("id", "text", "lines", n.cast("long").alias("n_words"), windows.alias("h"))
    h = F.col("h")
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.select("id", "text", "lines", "n_words", placed.alias("s"))
    s = F.col("s")
    again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    d = d.select("id", "text", "lines", "n_words", F.sort_array(F.transform(again, lambda x: x["i"])).alias("at"))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    # Lines in sorted order show repeats side by side; then back in the order of the text.
    d = d.select(
        "id", "n_words", F.length(without(F.col("text"), " \t\n\r\x0b\x0c")).cast("long").alias("word_chars"), count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.sort_array(F.transform("lines", lambda x, k: F.struct(x.alias("line"), k.alias("k")))).alias("by_line"),
    )
    by = F.col("by_line")
    marked = F.sort_array(F.transform(by, lambda x, j: F.struct(x["k"].alias("k"), x["line"].alias("line"), F.coalesce(x["line"] == F.get(by, j - 1)["line"], F.lit(False)).alias("again"))))
    d = d.withColumn("marked", marked).drop("by_line")
    d = d.withColumn("n_dup_lines", F.size(F.filter("marked", lambda x: x["again"])).cast("long"))
    d = d.withColumn("judged", F.transform("marked", lambda x: F.struct(x["line"].alias("line"), F.length(without(x["line"], " \t\r\x0b\x0c")).alias("chars"), (x["again"] | line_failures(x["line"])).alias("bad"))))
    d = d.withColumn("lost_chars", F.aggregate("judged", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bad"], x["chars"]).otherwise(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "lost_chars",
        F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned"), (~failed & (F.col("lost_chars") <= max_lost * F.col("word_chars"))).alias("kept"),
    )
