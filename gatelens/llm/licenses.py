"""License scan by diagonal voting.

Every pair of consecutive words of a document, as a hash, meets the word pairs of the templates in one equi-join. A hit
at word ``p`` of the document and place ``t`` of a template votes for the diagonal ``p - t``. Votes are a bit per
template place, 64 places to a number, so that they merge by bitwise or, before and after the shuffle, for templates of
any length. A diagonal is merged with its neighbours (a few words more or less than in the template), but not with
theirs: whatever else a document repeats, a span is a window of the template's length. It is verified by the share of the
template's word pairs found at their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.llm.common import keyed, plain_id, stored

# Phrases that must be found word for word, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Opening words of well-known license texts and notices, and their labels.
TEMPLATES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gpl",
    ),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        "isc",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

# Word pairs made of these two alone say nothing and cast no vote in the longer templates.
COMMON = {"the", "of", "to", "and", "in", "is", "a", "or", "this", "are", "it", "for", "with", "that", "as", "by", "be"}

#: Templates of fewer words must be found whole.
SHORT = 16
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words: digits, ASCII letters, and everything beyond ASCII.

    Letters beyond ASCII become lower-case too. That moves no word border, and none of them turns into a letter of a
    phrase (the Kelvin sign becomes ``k``, a dotted capital I an ``i`` with a combining dot).
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``text, label, phrase``: the phrases and the given templates. Constants only."""
    rows = [(text, label, True) for text, label in PHRASES] + [(text, label, False) for text, label in templates]
    given = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("text", "label", "phrase"), row)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*given)).alias("t")).select("t.*")


def template_pairs(table: DataFrame) -> DataFrame:
    """``_hash, template, place, phrase, label, full, length``: a row per voting word pair."""
    common = F.array(*[F.lit(w) for w in sorted(COMMON)])
    own = table.select(F.xxhash64("text", "label").alias("template"), "phrase", "label", words(F.col("text")).alias("_own"))
    pair = F.transform("_own", lambda w, i: F.struct(
        i.alias("place"), F.xxhash64(w, F.get("_own", i + 1)).alias("_hash"),
        (F.array_contains(common, w) & F.array_contains(common, F.get("_own", i + 1))).alias("says_nothing"),
    ))
    voting = F.filter(pair, lambda p: (p["place"] < F.size("_own") - 1) & (F.col("phrase") | ~p["says_nothing"]))
    pairs = own.withColumn("_pairs", voting).select(
        "template", "phrase", "label", F.size("_pairs").alias("full"), F.size("_own").alias("length"), F.inline("_pairs")
    )
    return pairs.drop("says_nothing")


def license_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    gap: int = 2,
    least: float = 0.75,
    templates: DataFrame | None = None,
) -> DataFrame:
    """``_id, _key, phrase, label, first, last, share``: places of phrases and verified spans of templates.

    ``templates`` (``text, label, phrase``; by default ``template_table``) may hold texts of any length and number. A phrase
    stands where all its pairs vote for one diagonal. A longer template's span has the votes of a diagonal and of those at
    most ``gap`` apart; it counts if at least ``least`` of the template's pairs are among them (of a short template all).
    Of overlapping spans, no two ``2 * gap`` diagonals apart or less, the best stays.
    """
    own = keyed(docs, id_col, text_col, by_text=True).select("_id", "_key", words(F.col("_text")).alias("_words"))
    pairs = own.select(
        "_id", "_key", F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1))).alias("_hashes")
    )
    # the constants are broadcast; a table that is given goes as Spark sees fit for its size
    wanted = F.broadcast(template_pairs(template_table(docs.sparkSession))) if templates is None else template_pairs(templates)
    hits = pairs.select("_id", "_key", F.posexplode_outer("_hashes").alias("at", "_hash")).join(wanted, "_hash")
    place = F.col("place")
    of = ["_id", "_key", "template", "phrase", "label", "full", "length"]
    votes = hits.groupBy(*of, (F.col("at") - place).alias("diagonal"), F.floor(place / 64).alias("chunk")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)).alias("votes"),
        F.min("at").alias("first"),
        F.max(F.col("at") + 1).alias("last"),
    )
    votes = stored(votes, "votes")
    found = F.sum(F.bit_count("votes"))
    phrases = (
        votes.filter("phrase")
        .groupBy(*of, "diagonal")
        .agg(found.alias("found"), F.min("first").alias("first"), F.max("last").alias("last"))
        .filter("found = full")
        .withColumn("share", F.lit(1.0))
    )
    near = F.explode(F.sequence(F.col("diagonal") - gap, F.col("diagonal") + gap)).alias("centre")
    exact = F.when(F.col("centre") == F.col("diagonal"), F.bit_count("votes")).otherwise(0)
    around = (
        votes.filter("NOT phrase")
        .select("*", near)
        .groupBy(*of, "centre", "chunk")
        .agg(F.bit_or("votes").alias("votes"), F.sum(exact).alias("exact"), F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy(*of, "centre")
        .agg(found.alias("found"), F.sum("exact").alias("exact"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("share", F.col("found") / F.col("full"))
        .filter(F.col("share") >= F.when(F.col("length") < SHORT, 1.0).otherwise(least))
        .withColumn("_rank", F.struct("share", "exact", (-F.col("centre")).alias("back")))
    )
    side = Window.partitionBy("_id", "_key", "template").orderBy("centre").rangeBetween(-2 * gap, 2 * gap)
    spans = around.withColumn("_best", F.max("_rank").over(side)).filter(F.col("_rank") == F.col("_best"))
    columns = ["_id", "_key", "phrase", "label", "first", "last", "share"]
    return phrases.select(*columns).union(spans.select(*columns))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for every row of ``docs``.

    ``n_base``: places of the phrases; ``first_word, last_word``: their smallest and largest first word, from 0;
    labels are distinct, sorted and joined by commas, empty if there are none; ``score``: the largest share found of a
    phrase or template, 0 without; ``spans``: label, first and last word and share of all of them.

    Null text: empty. Null and repeated ids: each row by its own text; a repeated row has the result of the other.
    Empty input: no rows. Other columns play no part.
    """
    found = license_spans(docs, id_col, text_col, **options)
    base = F.col("phrase")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    per = found.groupBy("_id", "_key").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"),
    )
    counted = keyed(docs, id_col, text_col, by_text=True).select(
        "_id", "_key", F.size(words(F.col("_text"))).cast("long").alias("n_words")
    )
    return counted.join(per, ["_id", "_key"], "left").select(
        plain_id(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
