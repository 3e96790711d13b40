"""License scans by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of every document is hashed and joined to the positions of the same gram in the templates (a fixed,
small table that is broadcast). A pair (document position p, template position t) votes for the diagonal p - t. Votes are counted
by document, template and diagonal; a phrase stands where all its grams vote for one diagonal. For notices, diagonals that
lie within ``GAP`` words of each other and follow one another are merged, so that inserted, dropped or replaced words do not cut a
span. A merged span is verified word by word: its share is that of the template's words which some voting gram covers, each counted
once however many diagonals agree on it; a notice is found at a share of ``LEAST``.

The join compares the words themselves as well as the hash, so a hash collision has no effect. Positions whose hash no template has are
left out within the row, before any row is made for them: the work is linear in a text's length, and only the few voting rows, each
with its own gram, are shuffled. A place is one row of its document, so a document with a phrase a million times makes groups of a few
votes each.

Defined cases: null and empty texts have no words, no places, null positions, empty labels and score 0; repeated rows repeat their
result; equal labels count once; further columns are ignored. Words are lower-cased by ``lower``, which on words of ASCII
letters is A-Z only; phrases consist of such words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import ROW, documents, row_columns, same_row, written

#: Phrases of the base and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of the method's own.
MORE = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "mozilla public license": "mpl", "creative commons attribution": "cc-by",
    "bsd license": "bsd", "isc license": "isc", "eclipse public license": "epl", "apache license version 2 0": "apache-2.0",
    "gnu general public license version 3": "gpl-3.0", "gnu general public license version 2": "gpl-2.0",
}
#: Notices of well-known licenses (normalised words).
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
    "merge publish distribute sublicense and or sell copies of the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
    "use compile sell or distribute this software",
}
PHRASE_GRAM, NOTICE_GRAM, GAP, LEAST = 2, 5, 16, 0.8
#: Template grams up to which the template side is broadcast; larger sets are joined by hash.
BROADCAST_GRAMS = 200_000
#: Template grams up to which their hashes are put into the plan, so that a row's other positions never leave it.
LISTED_GRAMS = 5_000
LOWERED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates(spark: SparkSession, base=BASE, more=MORE, notices=NOTICES) -> DataFrame:
    """One row for each gram: template id, label, kind, number of grams, k, position and the gram's words."""
    kinds = [*((t, x, "base") for t, x in base.items()), *((t, x, "phrase") for t, x in more.items()), *((t, x, "notice") for x, t in notices.items())]
    rows = []
    for n, (text, label, kind) in enumerate(kinds):
        words = text.split()
        k = NOTICE_GRAM if kind == "notice" else PHRASE_GRAM
        grams = len(words) - k + 1
        if grams < 1:
            raise ValueError(f"a template needs {k} words at least: {text!r}")
        rows += [(n, label, kind, grams, k, at, " ".join(words[at : at + k])) for at in range(grams)]
    return spark.createDataFrame(rows, "template int, label string, kind string, grams int, k int, at int, gram string").withColumn("hash", gram_hash(F.split("gram", " "), F.lit(0), "k"))


def gram_hash(words: Column, at: Column, k) -> Column:
    """Hash of the k words from ``at`` on (k: a number, or the column's name for both sizes)."""
    of = lambda n: F.xxhash64(F.lit(n), *[F.get(words, at + i) for i in range(n)])
    return of(k) if isinstance(k, int) else F.when(F.col(k) == PHRASE_GRAM, of(PHRASE_GRAM)).otherwise(of(NOTICE_GRAM))


def worded(docs: DataFrame) -> DataFrame:
    """What tells a row, and its words in lower case."""
    return docs.select(*row_columns(), F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), LOWERED), "").alias("words"))


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``ROW``, template and position pairs of all grams that documents and templates share."""
    words, n = F.col("words"), F.size("words")
    count = table.count()
    listed = [r.hash for r in table.select("hash").distinct().collect()] if count <= LISTED_GRAMS else None

    def places(k: int) -> Column:
        all_of_them = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return all_of_them if listed is None else F.filter(all_of_them, lambda i: gram_hash(words, i, k).isin(listed))

    def grams(k: int) -> Column:
        gram = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])
        return F.transform(F.col(f"at_{k}"), lambda i: F.struct(i.alias("pos"), F.lit(k).alias("size"), gram_hash(words, i, k).alias("hash"), gram(i).alias("gram")))

    sizes = (PHRASE_GRAM, NOTICE_GRAM)
    found = worded(docs).select(*ROW, "words", *[places(k).alias(f"at_{k}") for k in sizes])
    found = found.select(*ROW, F.explode(F.concat(*map(grams, sizes))).alias("g")).select(*ROW, "g.*")
    side = F.broadcast(table) if count <= BROADCAST_GRAMS else table
    same = (found["hash"] == side["hash"]) & (found["size"] == side["k"]) & (found["gram"] == side["gram"])
    return found.join(side, same).select(*ROW, "template", "label", "kind", "grams", "k", "at", "pos")


def spans(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Verified spans: ``ROW``, template, label, kind, first word, last word (exclusive) and covered share."""
    by = [*ROW, "template", "label", "kind", "grams", "k"]
    lines = votes(docs, table).withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*by, "diagonal").agg(
        F.array_sort(F.collect_set("at")).alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    lines = written(lines, "votes")  # a few rows: read twice below, made once
    shown = by[:-2]
    exact = lines.where((F.col("kind") != "notice") & (F.size("ats") == F.col("grams"))).select(*shown, F.col("diagonal").alias("first"), (F.col("high") + F.col("k")).alias("last"), F.lit(1.0).alias("share"))
    order = Window.partitionBy(*by).orderBy("low", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    away = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > GAP) | (F.col("low") - F.max("high").over(before) > GAP + F.col("k"))
    runs = lines.where("kind = 'notice'").withColumn("new", F.coalesce(away, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*by, "run").agg(F.flatten(F.collect_list("ats")).alias("ats"), F.min("low").alias("first"), (F.max("high") + F.max("k")).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    return exact.unionByName(merged.select(*shown, "first", "last", (covered / (F.col("grams") + F.col("k") - 1)).alias("share")))


def licenses(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    table = templates(docs.sparkSession) if table is None else table
    base, sure = F.col("kind") == "base", F.col("share") >= LEAST
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans(docs, table).groupBy(*ROW).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"), labels(base).alias("base_labels"), labels(sure).alias("labels"),
        F.max("share").alias("score"))
    all_docs = worded(docs).select(*ROW, F.size("words").cast("long").alias("n_words"))
    return all_docs.join(found, same_row(all_docs, found), "left").select(
        all_docs["row_id"].alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))
