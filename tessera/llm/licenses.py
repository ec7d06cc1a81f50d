"""License scans: exact set-similarity join of text blocks with license templates, in DataFrame operations only.

Blocks are runs of consecutive lines, so that a notice is found however it is wrapped: from every line on, as many of the
next ``LINES`` lines as have ``BLOCK_WORDS`` words together (a longer line is a block of its own).  Templates are the word
sets of the notices below.  A block matches a template if it holds at least ``CONTAINED`` of the template's words.  Words are ordered by the number of documents that
have them, rarest first, over all documents; then

* prefix filter: a block that matches has one of the template's first ``size - need + 1`` words, so only
  those words are joined on;
* length filter: it has at least ``need`` words of the vocabulary;
* positional filter: behind the first common word both sides must still have enough words.

What is left is verified by the size of the intersection.  The templates are constants of this module (a few
dozen rows), which is why their index may be broadcast.  Case is folded by ``lower``.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let
from tessera.session import stable_copy

# The phrases whose every place is counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of public licenses as word lists (fixed values).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINED = 0.8
LINES = 6  # of a block
BLOCK_WORDS = 60  # of a block of several lines, three times the longest template

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between lower-case words


def normal(text: Column) -> Column:
    """Lower-case words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def spaced(words: Column, phrases=tuple(PHRASES)) -> Column:
    """A normal text with two spaces between words and one at the ends, so that every word has a pair of its own;
    empty where no phrase can be."""
    some = reduce(or_, [F.contains(words, F.lit(p)) for p in phrases])
    return F.when(some, F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise(F.lit(""))


def places(text: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Count, first and last start (null if none) of a phrase in a spaced text."""
    own = " " + phrase.replace(" ", "  ") + " "
    there = F.contains(text, F.lit(own))
    count = (F.length(text) - F.length(F.replace(text, F.lit(own), F.lit("")))) / F.lit(len(own))
    first = _spaces(F.substring_index(text, own, 1)) / F.lit(2)
    last = n_words - _spaces(F.substring_index(text, own, -1)) / F.lit(2) - F.lit(len(phrase.split()))
    return F.when(there, count).otherwise(F.lit(0)).cast("long"), F.when(there, first).cast("long"), F.when(there, last).cast("long")


def ordered_vocabulary(documents: DataFrame, text: str = "text", templates=TEMPLATES) -> list[str]:
    """The templates' words (a few hundred at most), those in the fewest documents first."""
    vocabulary = sorted({w for _, notice in templates for w in notice.split()})
    found = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(normal(F.col(text)), " "))
    counts = documents.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    often = {row["word"]: row["n"] for row in counts}
    return sorted(vocabulary, key=lambda w: (often.get(w, 0), w))


def template_index(spark: SparkSession, vocabulary: list[str], templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """One row per prefix word of each template: ``word, place, label, words, need``."""
    rank = {w: i for i, w in enumerate(vocabulary)}
    rows = []
    for label, notice in templates:
        words = sorted(set(notice.split()), key=rank.__getitem__)
        need = -int(-contained * len(words) // 1)
        rows += [(words[i], i, label, words, need) for i in range(len(words) - need + 1)]
    return spark.createDataFrame(rows, "word string, place int, label string, words array<string>, need int")


def line_blocks(low: Column, in_order: Column) -> Column:
    """Per line the block that starts with it, as its share of the vocabulary in vocabulary order."""
    share = lambda t: F.struct(F.when(t == "", 0).otherwise(_spaces(t) + 1).alias("n"), F.array_intersect(F.split(t, " "), in_order).alias("ws"))
    lines = F.transform(F.split(low, "\n", -1), lambda line: let(normal(line), share))

    def add_line(block: Column, line: Column) -> Column:
        """Take a line if it is the first, or if every line before it was taken and the words are not too many."""
        n = block["n"] + line["n"]
        takes = (block["lines"] == 0) | (block["open"] & (n <= BLOCK_WORDS))
        return F.struct(
            F.when(takes, n).otherwise(block["n"]).alias("n"),
            F.when(takes, F.concat(block["ws"], line["ws"])).otherwise(block["ws"]).alias("ws"),
            (block["lines"] + 1).alias("lines"),
            takes.alias("open"),
        )

    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("ws"), F.lit(0).alias("lines"), F.lit(True).alias("open"))
    block = lambda ls, i: F.aggregate(F.slice(ls, i + 1, LINES), none, add_line)["ws"]
    return let(lines, lambda ls: F.transform(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.array_intersect(in_order, block(ls, i))))


def containment_join(blocks: DataFrame, index: DataFrame, key: str = "rid", words: str = "block") -> DataFrame:
    """``key, label, contained`` for every block and template that match; ``words`` is a block's share of the
    vocabulary in vocabulary order, without repeats."""
    size = F.size(F.col(words))
    each = blocks.select(key, words, F.posexplode(words).alias("at", "word"))
    paired = each.join(F.broadcast(index), "word")
    possible = paired.where(
        (size >= F.col("need")) & (F.least(size - F.col("at"), F.size("words") - F.col("place")) + F.least("at", "place") >= F.col("need"))
    )
    common = F.size(F.array_intersect(words, "words"))
    verified = possible.where(common >= F.col("need"))
    return verified.select(key, "label", (common / F.size("words")).alias("contained"))


def scan(documents: DataFrame, text: str = "text", id_column: str = "doc_id", templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Per row: id, ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 with a fixed phrase, else the largest containment found, 0 without any.  Null and empty texts
    have no words and no labels; repeated rows stay; other columns are dropped.
    """
    vocabulary = ordered_vocabulary(documents, text, templates)
    index = template_index(documents.sparkSession, vocabulary, templates, contained)
    prefix = sorted({row["word"] for row in index.select("word").distinct().collect()})

    given = documents.select(F.col(id_column).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    worded = given.withColumn("normal", normal(F.col("low")))
    counted = worded.withColumns(
        {
            "n_words": F.when(F.col("normal") == "", 0).otherwise(_spaces(F.col("normal")) + 1).cast("long"),
            "spaced": spaced(F.col("normal")),
        }
    )
    found = {label: places(F.col("spaced"), F.col("n_words"), phrase) for phrase, label in PHRASES.items()}
    in_prefix, in_order = F.array(*map(F.lit, prefix)), F.array(*map(F.lit, vocabulary))
    blocks = F.filter(line_blocks(F.col("low"), in_order), lambda block: F.arrays_overlap(block, in_prefix))
    rows = counted.select(
        F.monotonically_increasing_id().alias("rid"),
        "id",
        "n_words",
        reduce(add, [f[0] for f in found.values()]).alias("n_base"),
        F.least(*[f[1] for f in found.values()]).alias("first_word"),
        F.greatest(*[f[2] for f in found.values()]).alias("last_word"),
        F.array_compact(F.array(*[F.when(f[0] > 0, F.lit(label)) for label, f in found.items()])).alias("base"),
        F.when(F.arrays_overlap(F.split("normal", " "), in_prefix), blocks).alias("blocks"),
    )
    rows = stable_copy(rows)  # row numbers hold from here on; texts are left behind
    links = containment_join(rows.where("blocks is not null").select("rid", F.explode("blocks").alias("block")), index)
    labels = links.groupBy("rid").agg(F.collect_set("label").alias("added"), F.max("contained").alias("contained"))
    merged = rows.drop("blocks").join(labels, "rid", "left")
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return merged.select(
        F.col("id").alias(id_column),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def op9(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    return scan(documents)
