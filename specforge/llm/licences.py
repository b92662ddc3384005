"""Licence scans by a positional index of rare words, in DataFrame expressions only.

The index holds the words of licence notices and clauses with their positions. How many documents hold each of these
words gives its inverse document frequency (IDF), smoothed so that a word of every document keeps some. A template is
known by its highest-IDF words. A file's rarest licence words are looked up: each occurrence names a template and a shift
(position in the file less position in the template). There the template's postings are intersected with the file's: the
share of the looked-up IDF that stands in its place is the match. The rarest words that are looked up are so many that no
match can do without them all. A match counts if the template's mandatory key phrase stands at that shift, too. Beside
it, base labels come from phrases whose words stand consecutively.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, settle, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that give the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Fixed values: (label, notice or clause of the licence text, mandatory key phrase in it), in lower case without punctuation.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included in all copies"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("gpl-2", "as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("gpl-3", "as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "permission is granted to anyone to use this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]
#: Words by which a template is looked up, those of the highest IDF.
LOOKED_UP = 12
#: Least share of a template's IDF that must stand in its place.
LEAST_SHARE = 0.7


def _starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, words from 0."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - F.lit(len(parts)))
    hit = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + j) == p for j, p in enumerate(parts)))
    return F.filter(at, hit)


def _index(spark) -> DataFrame:
    """template, label, word, at: one posting for each word of each template; key: whether it belongs to the key phrase."""
    rows = []
    for k, (label, text, phrase) in enumerate(TEMPLATES):
        words, keys = text.split(), phrase.split()
        first = next(i for i in range(len(words)) if words[i : i + len(keys)] == keys)
        rows += [(k, label, w, at, first <= at < first + len(keys)) for at, w in enumerate(words)]
    return spark.createDataFrame(rows, "template int, label string, word string, at int, key boolean")


def scan(docs: DataFrame, looked_up: int = LOOKED_UP, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score: one row for each input row.

    A null text is empty: no words, no places, no labels, score 0. score is the largest share of a template's
    looked-up IDF that stands in its place, over templates whose key phrase stands there. Rows are told apart by their
    place in the input, so repeated and null ids are kept. Other columns are not read.

    located holds a file's licence words at their places and nulls between them: a posting is looked up by its place.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    words = F.col("words")
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_extract_all(ascii_lower(text_of()), F.lit(WORD), F.lit(0)).alias("words"),
    )
    places = F.array_sort(F.concat(*(F.when(F.col("line").contains(f" {p} "), _starts(words, p)).otherwise(F.array().cast("array<int>")) for p in BASE)))
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.col("line").contains(f" {p} "), F.lit(x)) for p, x in BASE.items())))))
    located = F.transform(words, lambda w: F.when(w.isin(vocabulary), w))
    rows = settle(
        split.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.size("words").cast("long").alias("n_words"), "words", line.alias("line")).select(
            "doc_id", "rid", "n_words", places.alias("places"), labels.alias("base_labels"), located.alias("located")
        )
    )
    n = rows.count()
    df = rows.select(F.explode(F.array_distinct("located")).alias("word")).filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # one row for each word of the templates, also for those that no document holds
    idf = _index(spark).select("word").distinct().join(F.broadcast(df), "word", "left")
    idf = settle(idf.select("word", F.log(1 + F.lit(n + 1) / F.coalesce("df", F.lit(1))).alias("idf")))
    by_idf = Window.partitionBy("template").orderBy(F.desc("idf"), "word")
    index = _index(spark).join(F.broadcast(idf), "word").withColumn("place", F.dense_rank().over(by_idf)).filter(F.col("place") <= looked_up)
    # without the rarest words, up to where they hold more than a match may lack, there is no match: only they bring files
    rarer = Window.partitionBy("template").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    weighed = settle(index.withColumns({"whole": F.sum("idf").over(Window.partitionBy("template")), "before": F.coalesce(F.sum("idf").over(rarer), F.lit(0.0))}))
    rare = weighed.filter(F.col("before") <= F.col("whole") * (1 - least_share) + 1e-9).select("template", "word", "at")
    held = rows.select("rid", F.posexplode("located").alias("pos", "word")).filter("word is not null")
    candidates = held.join(F.broadcast(rare), "word").select("rid", "template", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    postings = weighed.groupBy("template", "label", "whole").agg(F.collect_list(F.struct("word", "at", "idf")).alias("postings"))
    keys = _index(spark).filter("key").groupBy("template").agg(F.collect_list(F.struct("word", "at")).alias("phrase"))
    templates = postings.join(F.broadcast(keys), "template")
    # by place, so that a file's work grows with its places and not with their square
    stands = lambda p: F.get("located", p["at"] + F.col("shift")) == p["word"]
    matches = (
        settle(candidates)
        .join(F.broadcast(templates), "template")
        .join(rows.select("rid", "located"), "rid")
        .withColumn("stands", F.aggregate(F.filter("postings", stands), F.lit(0.0), lambda s, p: s + p["idf"]))
        .withColumn("share", F.least(F.col("stands") / F.col("whole"), F.lit(1.0)))
    )
    verified = matches.filter(F.col("share") >= least_share).filter(F.size(F.filter("phrase", stands)) == F.size("phrase"))
    found = verified.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("share").alias("score"))
    return rows.join(found, "rid", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op9_licences(spark, sf_dir):
    return scan(documents(spark, sf_dir)).withColumns(
        {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    )


def phrase_words(text: str) -> list[str]:
    """The words of one text, as the scan takes them; used by the tests."""
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
