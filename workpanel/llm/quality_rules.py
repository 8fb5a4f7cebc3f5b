"""Line-first cleaning: rules judge single lines, then the document by what is left.

Every line is held against rules on punctuation, navigation and boilerplate.
Failing lines go; a document that loses too much of its text, or keeps too
few words, is rejected.  Base counts of the whole text (words, symbols,
repeated lines and word windows) come with it.  Everything is DataFrame
functions on one row: no shuffle.

Defined cases: a null, empty or blank text has no words and fails; repeated
rows and an empty table go through row by row; other columns stay as they
are, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workpanel.llm.common import BLANKS

BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Lines shorter than this many words go when they carry one of the phrases.
BOILERPLATE_WORDS = 20
# Phrases of site furniture, as text.
PHRASES = ("cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved",
           "subscribe", "newsletter", "sign in", "log in", "sign up", "click here", "read more",
           "share this", "javascript", "skip to content", "back to top", "lorem ipsum")
BOILERPLATE = "|".join(PHRASES)


def words_of(text: Column) -> Column:
    """Words between blanks; null and blank texts give an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANKS))


def bad_line(line: Column, own_words: Column) -> Column:
    """True for a line with words that is navigation, boilerplate or not prose."""
    own = F.size(own_words)
    n = F.length(line)
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>~^={}\\_]"))
    separators = F.regexp_count(line, F.lit(r"[|»›·•>]"))
    return (
        (marks * 12 >= n)                                                                  # symbols
        | (separators >= 3) & (separators * 8 >= own)                                      # navigation
        | line.rlike(r"[!?]{2,}") & (F.regexp_count(line, F.lit(r"[!?]{2,}")) * 4 >= own)   # shouting marks
        | (own >= 5) & (F.regexp_count(line, F.lit(r"\p{Lu}")) * 2 >= n)                    # capitals
        | (own >= 10) & (F.size(F.array_distinct(own_words)) * 5 <= own)                   # one word over and over
        | (own <= 4) & ~line.rlike(r"[.!?…:;,\"'”»)\]。！？]\s*$")                          # a stray label
        | (own < BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE))


def repeat_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Add ``out``: how many of the words in array ``w`` lie in a 3-word window
    that the text has twice or more.

    Windows are hashed; sorting (hash, position) brings equal ones together,
    and the covered words are counted along the sorted positions, so the
    work is n log n for any text.
    """
    n = F.size(w)
    df = df.withColumn("_h", F.when(n >= 4, F.transform(w, lambda x: F.xxhash64(x))))
    two = F.zip_with("_h", F.slice("_h", 2, n - 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_h", F.slice(two, 1, n - 1)).withColumn("_t", F.slice("_h", 2, n - 2))
    # windows from words 1 and 2 hashed with those from words 2 and 3
    df = df.withColumn("_g", F.zip_with(F.slice("_h", 1, n - 2), "_t", lambda a, b: F.xxhash64(a, b)))
    pairs = F.transform(F.col("_g"), lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(pairs)))

    def again(x: Column, i: Column) -> Column:
        near = [F.get("_s", i + 1)["g"] == x["g"], F.get("_s", i - 1)["g"] == x["g"]]
        return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_s", again), lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("total")),
        lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total")),
        lambda acc: acc["total"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_g", "_s", "_h", "_t")


def clean_lines(docs: DataFrame, text_col: str = "text", min_words: int = 50, min_left: float = 0.5,
                max_repeat: float = 0.5) -> DataFrame:
    """``docs`` with base counts, ``clean_text`` (bad and repeated lines
    removed), ``n_lines``, ``n_bad_lines``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat`` of them in repeated windows.  ``kept``: not that, and the
    clean text has ``min_words`` words and ``min_left`` of the characters in
    lines with words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_w", words_of(text))
    df = repeat_words(df, "_w", "n_repeat_words")
    df = (df.withColumn("n_words", F.size("_w").cast("long"))
          .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
          .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
          .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).drop("_w"))
    df = (df.withColumn("_once", F.array_distinct("_lines"))
          .withColumn("_cut", F.transform("_once", lambda x: F.struct(x.alias("line"), words_of(x).alias("w"))))
          .withColumn("_good", F.filter("_cut", lambda x: ~bad_line(x["line"], x["w"])))
          .withColumn("_left", F.transform("_good", lambda x: x["line"])).drop("_cut"))
    chars = lambda c: F.length(F.array_join(c, ""))
    n_left = F.aggregate("_good", F.lit(0), lambda n, x: n + F.size(x["w"]))
    df = (df.withColumn("n_lines", F.size("_lines").cast("long"))
          .withColumn("n_dup_lines", (F.size("_lines") - F.size("_once")).cast("long"))
          .withColumn("n_bad_lines", (F.size("_once") - F.size("_good")).cast("long"))
          .withColumn("clean_text", F.array_join("_left", "\n")))
    df = df.withColumn("base_failed", (F.col("n_words") < min_words)
                       | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words")))
    enough = (100 * chars("_left") >= round(100 * min_left) * chars("_lines")) & (n_left >= min_words)
    return df.withColumn("kept", ~F.col("base_failed") & enough).drop("_lines", "_once", "_good", "_left")
