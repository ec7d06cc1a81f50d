"""Quality rules, line first, in DataFrame operations only.

Every line with a word is judged by itself:

* punctuation: over a tenth of its words end in doubled marks, or it has a symbol for more than every tenth word;
* navigation: three or more of its words are menu separators, or fewer than three words and no closing mark;
* boilerplate: it speaks of cookies, scripts, logging in or terms of use in a short line.

Failing lines go; which rules can apply at all is looked up once per text, so most lines are never judged one by
one.  A document that loses more than ``LOST`` of its word characters is rejected, and so is one
that fails the base rules (too few words, or too many words in repeated five-word windows).

Everything is computed inside the row; nothing is shuffled.  Repeats are found by sorting a row's own window
hashes (64 bits), only where the hashes are not all different.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, fresh, let

LEAST_WORDS = 10
REPEATED = 20  # per cent of the words
WINDOW = 5
LOST = 0.5  # share of word characters in failing lines from which a document is rejected

SYMBOLS = "[#*$%&|<>]"
MARKED = r"[\p{L}\p{N}.,;:][!?]{2}(?:[\x20\x09-\x0D]|\z)"  # words that end in doubled marks
SEPARATORS = ("|", "»", "›", ">", "/", "•")
CLOSING = "[.!?:;…。！？\"'”’)\\]][\\x20\\x09-\\x0D]*\\z"
BOILERPLATE = (
    "(?:^|[^a-z])(?:accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|enable javascript"
    "|javascript is (?:disabled|required)|log ?in|sign ?up|subscribe now|skip to content|back to top)(?:[^a-z]|\\z)"
)  # in lower case
BOILERPLATE_WORDS = 20  # longest line that boilerplate takes out

# What a text must hold for a rule to apply to one of its lines.
BOILERPLATE_HINTS = ("cookie", "policy", "terms of", "javascript", "login", "log in", "signup", "sign up", "subscribe now", "skip to", "back to")
SEPARATOR_HINT = "(?:^|[\\x20\\x09-\\x0D])[|»›>/•](?:[\\x20\\x09-\\x0D]|\\z)"
SHORT_LINE_HINT = r"(?md)^[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+)?[\x20\x09\x0B-\x0D]*$"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; one without a word never does."""

    def broken(words: Column) -> Column:
        n = F.size(words)
        return (
            (_count(line, MARKED) * 10 > n)
            | ((_count(line, SYMBOLS) * 10 > n) & (_count(line, SYMBOLS) > 1))
            | (F.size(F.filter(words, lambda w: w.isin(*SEPARATORS))) >= 3)
            | ((n > 0) & (n < 3) & ~line.rlike(CLOSING))
            | ((n <= BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE))
        )

    return let(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), broken)


def may_fail(text: Column, n_symbols: Column) -> Column:
    """False only if no line can break a rule: what each rule needs, looked for once in the whole text."""
    low = F.lower(text)
    said = [F.contains(low, F.lit(word)) for word in BOILERPLATE_HINTS]
    return reduce(or_, said, (n_symbols > 1) | text.rlike("[!?]{2}") | text.rlike(SEPARATOR_HINT) | text.rlike(SHORT_LINE_HINT))


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words of an array stand in a window of ``window`` words that is found twice or more in it."""

    def covered(hashes: Column) -> Column:
        # places of one window next to each other, so those of a repeated window see their like before or after
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            like = F.filter(
                s, lambda x, k: ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            )
            return F.sort_array(F.transform(like, lambda x: x["i"]))

        def total(at: Column) -> Column:
            # each place adds what it does not share with the next one
            gaps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(window)), F.lit(window)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return let(placed, lambda s: let(repeated(s), total))

    def hashed(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(window)]))

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(word_hashes, lambda own: let(hashed(own), counted)))


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``, ``kept``
    (boolean) and ``clean``, the text without its failing lines.

    A null text has no words and fails; so does an empty one.  Repeated rows stay.  Columns of these names that
    ``df`` already has are replaced.
    """
    words, lines, mine, maybe = fresh(df, "_words", "_lines", "_mine", "_maybe")
    split = df.withColumn(mine, F.coalesce(F.col(text), F.lit("")))
    split = split.withColumns({words: F.regexp_extract_all(F.col(mine), F.lit(WORD), F.lit(0)), lines: F.split(F.col(mine), "\n", -1)})
    worded = F.filter(F.col(lines), lambda line: line.rlike(WORD))
    none_alike = F.size(F.array_distinct(lines)) == F.size(lines)
    counted = split.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": _count(F.col(mine), SYMBOLS),
            "n_dup_lines": F.when(none_alike, 0).otherwise(let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w)))).cast("long"),
            "n_repeat_words": repeated_words(F.col(words)),
        }
    )
    counted = counted.withColumn(maybe, may_fail(F.col(mine), F.col("n_symbols")))
    fine = F.array_join(F.filter(F.col(lines), lambda line: ~line_fails(line)), "\n")
    cleaned = counted.withColumn("clean", F.when(F.col(maybe), fine).otherwise(F.col(mine)))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    lost = F.when(F.col(maybe), F.col("word_chars") - _word_chars(F.col("clean"))).otherwise(F.lit(0))
    return (
        cleaned.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (lost <= F.col("word_chars") * LOST))
        .drop(words, lines, mine, maybe)
    )


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, all columns as they were but for ``text``, which loses its failing lines."""
    (held,) = fresh(df, "_row")
    judged = judge(df.select(F.struct(*df.columns).alias(held), F.col(text).alias("text"))).where("kept")
    return judged.select(*[F.col("clean").alias(c) if c == text else F.col(held)[c].alias(c) for c in df.columns])


def op2(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``."""
    judged = judge(documents.select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
