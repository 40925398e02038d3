"""License scans by diagonal voting.

All rolling word k-grams of every text are joined, by hash and then by their
words, to the positions of the same k-grams in the templates.  Hashes are compared
within the row first, so only k-grams that some template may have are ever built,
exploded and joined.  A hit votes for
the diagonal "position in the text minus position in the template".  Diagonals
that lie close together (words put in or left out) are merged into one span, and a
span counts when the share of the template's k-grams found in it reaches
``MIN_SHARE`` and it is no longer than ``MAX_STRETCH`` times the template.  A longer
one is made up of hits scattered over the text, or of copies on neighbouring diagonals
(less than a few words apart); it counts if one of its diagonals alone does.

The base phrases are templates of their own with two-word grams; a place counts
when every gram of the phrase votes for one and the same diagonal.

The template side of the join is a fixed list, so it is broadcast; hits are few and
only they are shuffled.  Rows without hits ride along as one marker row each.

Defined results: null text is the empty text (no words, no places); repeated rows
get equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.binding import let
from logtide.llm.common import lower_ascii

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases with their labels, in words.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Opening passages of well-known license notices, in words as WORD_GAP cuts them.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
GRAM, NOTICE_GRAM = 2, 5
#: Diagonals at most this far apart belong to one span.
SLACK = 3
MIN_SHARE = 0.6
MAX_STRETCH = 1.5


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def _templates(spark, phrases, notices) -> DataFrame:
    """One row per k-gram position of a template: id, label, whether base, gram, position, number of grams and words."""
    rows = []
    listed = [(label, text, GRAM, True) for text, label in phrases] + [(label, text, NOTICE_GRAM, False) for label, text in notices]
    for i, (label, text, k, base) in enumerate(listed):
        ws = text.split()
        grams = [" ".join(ws[j : j + k]) for j in range(len(ws) - k + 1)]
        rows += [(i, label, base, g, j, len(grams), len(ws)) for j, g in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, t_gram string, t_pos int, t_grams int, t_words int")


def _hashes(spark, grams: list[str]) -> list[int]:
    """Hashes of the words of k-grams, as the scan works them out."""
    return list(spark.range(1).select(*(F.xxhash64(*(F.lit(w) for w in g.split())).alias(f"h{i}") for i, g in enumerate(grams))).first()) if grams else []


def _hits(ws: Column, k: int, hashes: list[int]) -> Column:
    """(pos, gram) of the k-grams whose hash is one of ``hashes``."""

    def gram(i: Column) -> list[Column]:
        return [F.get(ws, i + j) for j in range(k)]

    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ws) - k, F.lit(0))), lambda i: F.xxhash64(*gram(i)).isin(hashes))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *gram(i)).alias("gram")))


def scan(docs: DataFrame, key: str = "doc_id", phrases=BASE, notices=NOTICES) -> DataFrame:
    """Counts, places and labels of every row of ``docs`` (key, text)."""
    spark = docs.sparkSession
    templates = _templates(spark, phrases, notices)
    marker = F.struct(F.lit(-1).alias("pos"), F.lit("").alias("gram"))

    by_size = {k: sorted({r["t_gram"] for r in templates.collect() if r["t_gram"].count(" ") == k - 1}) for k in (GRAM, NOTICE_GRAM)}
    hashes = {k: _hashes(spark, grams) for k, grams in by_size.items()}

    def exploded(ws: Column) -> Column:
        parts = [_hits(ws, k, hashes[k]) for k in hashes if hashes[k]]
        return F.struct(F.size(ws).alias("n"), F.concat(F.array(marker), *parts).alias("grams"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), let(words(docs["text"]), exploded).alias("e"))
    grams = rows.select("row", "key", F.col("e.n").alias("n_words"), F.explode("e.grams").alias("g")).select("row", "key", "n_words", "g.pos", "g.gram")
    hits = grams.join(F.broadcast(templates), grams["gram"] == templates["t_gram"], "left").where("pos < 0 or template is not null")
    # votes by diagonal; a text's own row comes out with a null template
    votes = hits.groupBy("row", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.first("key", ignorenulls=True).alias("key"),
        F.max("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.first("t_grams").alias("t_grams"),
        F.first("t_words").alias("t_words"),
        F.collect_set("t_pos").alias("found"),
        F.min("pos").alias("low"),
        F.max("pos").alias("high"),
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(near) > SLACK).cast("int")
    votes = votes.withColumn("span", F.when(F.col("base"), F.col("diagonal")).otherwise(F.sum(F.coalesce(new, F.lit(0))).over(near)))
    spans = votes.groupBy("row", "template", "span").agg(
        F.first("key", ignorenulls=True).alias("key"),
        F.max("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.min("diagonal").alias("at"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("found")))) / F.first("t_grams")).alias("share"),
        ((F.max("high") - F.min("low") + NOTICE_GRAM) <= MAX_STRETCH * F.first("t_words")).alias("plausible"),
        (F.max(F.size("found")) / F.first("t_grams")).alias("best_share"),
    ).withColumn("share", F.when(F.col("base") | F.col("plausible"), F.col("share")).otherwise(F.col("best_share")))
    place = F.col("base") & (F.col("share") == 1)
    found = place | (~F.col("base") & (F.col("share") >= MIN_SHARE))
    out = spans.groupBy("row").agg(
        F.first("key", ignorenulls=True).alias(key),
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("at"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.least(F.col("share"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
