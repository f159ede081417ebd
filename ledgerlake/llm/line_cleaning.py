"""Line-first cleaning, with DataFrame functions only.

Every line of a text is judged on its own before the document is:

* navigation: separators (``|``, bullets, arrows) make up much of the line;
* boilerplate: a fixed phrase of notices, licences or menus occurs in a line of at most
  ``NOTICE_WORDS`` words (prose may mention one);
* punctuation: symbol clutter, or shouting with several exclamation marks at
  the rate of every third word.

Failing lines are removed; a document that loses more than ``MAX_LOSS`` per
cent of its characters that way is rejected, as is one that fails the base
limits (under 50 words, or over half of its words in repeated 3-word windows).

All of it is one narrow projection: no shuffle, no Python.  Steps that later
steps use several times are fenced by ``explode(array(...))``, so that the
optimizer computes them once.

Defined cases: a null text has no words and is rejected; empty or blank lines
are never judged; a text of one line is judged like any other; repeated rows
are judged alike; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT = 50
MAX_LOSS = 50
NOTICE_WORDS = 30
#: Phrases of notices, licences and menus (fixed values).
BOILERPLATE = (
    "all rights reserved", "licensed under", "is licensed under", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
    "subscribe to our newsletter", "sign up for our", "click here to", "share this article", "skip to content", "back to top",
)
_NAVIGATION = r"[|•·»«›‹→←]"
_CLUTTER = r"[#*$%&<>~^=_\\]{2,}"
_SHOUT = r"[!?]{2,}"


def _fence(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(value)).alias(name))


def _found(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def line_fails(line: Column) -> Column:
    """Whether one line is to be removed."""
    n_words = _found(line, f"{WORD}+")
    phrases = "(?i)" + "|".join(BOILERPLATE)
    marked = line.rlike(r"[|•·»«›‹→←!?#*$%&<>~^=_\\]")  # most lines have none of these: two scans decide them
    bad = lambda pattern, share: (_found(line, pattern) >= 3) & (_found(line, pattern) * share >= n_words)
    return (line.rlike(phrases) & (n_words <= NOTICE_WORDS)) | (marked & (bad(_NAVIGATION, 5) | bad(_CLUTTER, 3) | bad(_SHOUT, 3)))


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with the cleaned text and all figures."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("body"))
    df = _fence(df, "words", F.array_remove(F.split("body", SPACE), ""))
    df = _fence(df, "worded", F.filter(F.split("body", "\n"), lambda line: line.rlike(WORD)))
    n = F.size("words")
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    # Windows with their places, sorted so that equal windows are neighbours.
    df = _fence(df, "windows", F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("h"), i.alias("i")))))
    twice = F.filter("windows", lambda w, k: (F.get("windows", k - 1)["h"] == w["h"]) | (F.get("windows", k + 1)["h"] == w["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2))))
    lines = F.split("body", "\n")
    kept = F.filter(lines, lambda line: ~F.coalesce(line_fails(line), F.lit(False)))
    df = _fence(df, "figures", F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.array_join(kept, "\n").alias("cleaned")))
    df = df.select("row", "body", "figures.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    lost = 100 * (F.length("body") - F.length("cleaned")) > MAX_LOSS * F.length("body")
    return df.select("*", failed.alias("base_failed"), (~failed & ~lost).alias("kept")).drop("body")


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the figures, base_failed, kept, cleaned (the text left)."""
    return judged(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), "text").select(
        F.col("row.doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")


def cleaned_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that stay, failing lines removed and ``n_chars`` (if there) following."""
    out = judged(docs, text).where("kept")
    columns = []
    for name in docs.columns:
        value = F.col(f"row.`{name}`")
        if name == text:
            value = F.col("cleaned")
        elif name == n_chars:
            value = F.when(F.col(f"row.`{text}`") == F.col("cleaned"), value).otherwise(F.length("cleaned").cast(docs.schema[name].dataType))
        columns.append(value.alias(name))
    return out.select(*columns)
