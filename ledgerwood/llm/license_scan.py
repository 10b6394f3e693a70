"""License texts in documents (operator 3), by diagonal voting in DataFrame operations alone.

Every rolling word k-gram of a document is hashed and joined with the positions of
the same hash in license templates. A match at document word p and template word t
votes for the diagonal p - t. Votes are summed by diagonal, neighbouring diagonals
(a few inserted or dropped words apart) are merged into spans, and a span stands if
it covers enough of the template's k-grams. The hash only selects: each vote also
compares the k-gram itself.

The templates are fixed, a few hundred rows that the plan itself holds, so they are
broadcast. Of a document only its matches and one header row are shuffled, and the words
of a text go no further than its own row: the time is linear in its length.

Defined results: a null or empty text has no words and no labels, score 0; repeated
rows and repeated ids are kept apart; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .decontaminate import PLAIN_WORDS

# Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices, by label.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved."),
]

K = 3
#: Diagonals that lie at most this far apart are one span.
NEIGHBOUR = 3
#: Share of a template's k-grams that a span covers at least.
COVERED = 0.6
HEADER = -1


def template_rows() -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, is a phrase, words in a gram, grams, position, gram)."""
    rows = []
    texts = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]
    for n, (label, text, phrase) in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", text.lower())
        k = min(K, len(words))
        grams = len(words) - k + 1
        rows += [(n, label, phrase, k, grams, i, " ".join(words[i : i + k])) for i in range(grams)]
    return rows


def plain_word_array(text: Column) -> Column:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    # The Kelvin sign is the one character that lower() would turn into an ASCII word of a template.
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_grams(spark: SparkSession) -> DataFrame:
    """The grams of all templates as literals of the plan, and the header's own row of 0 words."""
    values = ", ".join(f"({t}, '{label}', {phrase}, {k}, {n}, {i}, '{g}')" for t, label, phrase, k, n, i, g in template_rows())
    grams = spark.sql(f"SELECT * FROM VALUES {values}, ({HEADER}, CAST(NULL AS STRING), false, 0, 0, 0, '') AS t(template, label, phrase, k, grams, tpos, gram)")
    split = F.split("gram", " ")
    hashed = F.when(F.col("k") == 3, F.xxhash64(split[0], split[1], split[2])).when(F.col("k") == 2, F.xxhash64(split[0], split[1])).otherwise(F.lit(0))
    return grams.withColumn("h", hashed)


def votes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each place where a template's gram stands, and a header row for each document."""
    grams = F.broadcast(template_grams(docs.sparkSession))
    words = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), plain_word_array(F.col(text_col)).alias("w"))
    # A place enters the join if its two first words begin some template's gram. Each takes its own three
    # words along, so that no row carries the document's.
    begin = [sorted({r[6].split(" ")[i] for r in template_rows()}) for i in range(2)]
    place = lambda x, i: F.struct(i.alias("pos"), x.alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"))
    starts = F.transform("w", lambda x, i: F.when(x.isin(begin[0]) & F.get("w", i + 1).isin(begin[1]), place(x, i)))
    kinds = lambda e, *of: F.array(*[F.struct(e["pos"].alias("pos"), F.lit(k).alias("size"), h.alias("h"), g.alias("text")) for k, h, g in of])
    header = kinds({"pos": F.lit(0)}, (0, F.lit(0).cast("bigint"), F.lit("")))
    entries = words.select("doc_id", "row", F.size("w").cast("bigint").alias("n_words"), F.explode(F.concat(F.array(F.struct(F.lit(HEADER).alias("pos"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))), F.array_compact(starts))).alias("e"))
    e = F.col("e")
    rolled = kinds(e, (3, F.xxhash64(e["a"], e["b"], e["c"]), F.concat_ws(" ", e["a"], e["b"], e["c"])), (2, F.xxhash64(e["a"], e["b"]), F.concat_ws(" ", e["a"], e["b"])))
    entries = entries.select("doc_id", "row", "n_words", F.inline(F.when(e["pos"] == HEADER, header).otherwise(rolled)))
    found = entries.join(grams, "h").where((F.col("size") == F.col("k")) & (F.col("text") == F.col("gram")))
    return found.select("row", "doc_id", "n_words", "template", "label", "phrase", "k", "grams", "tpos", "pos")


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: votes merged over neighbouring diagonals; the header row stays a row of its own."""
    by_diagonal = (
        found.repartition("row")
        .groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "k", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.min("pos").alias("start"), F.max("pos").alias("last"), F.collect_set("tpos").alias("hit"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR)
    numbered = by_diagonal.withColumn("group", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "grams", "group").agg(
        F.min("start").alias("start"),
        F.max(F.col("last") + F.col("k")).alias("stop"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("hit")))) / F.greatest("grams", F.lit(1))).alias("covered"),
    )
    return merged.where((F.col("template") == HEADER) | (F.col("covered") >= COVERED))


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: base places, labels of phrases and of notices, best coverage."""
    base = F.col("phrase")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans(votes(docs, text_col, id_col))
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start").cast("bigint"))).alias("first_word"),
            F.max(F.when(base, F.col("start").cast("bigint"))).alias("last_word"),
            labels(F.when(base, F.col("label"))).alias("base_labels"),
            labels(F.col("label")).alias("labels"),
            F.max(F.when(F.col("template") == HEADER, 0.0).otherwise(F.col("covered"))).alias("score"),
        )
        .drop("row")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


_ROWS = ", ".join(f"({t}, '{label}', {str(phrase).lower()}, {k}, {n}, {i}, '{g}')" for t, label, phrase, k, n, i, g in template_rows())

ORACLE = f"""
WITH t(template, label, phrase, k, grams, tpos, gram) AS (VALUES {_ROWS}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {PLAIN_WORDS} AS w FROM documents),
g AS (SELECT rid, k, p - 1 AS pos, array_to_string(w[p:p + k - 1], ' ') AS gram
      FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (VALUES (2), (3)) AS s(k) WHERE len(w) >= k)),
v AS (SELECT rid, template, label, phrase, k, grams, pos - tpos AS diagonal, min(pos) AS start, list(DISTINCT tpos) AS hit
      FROM g JOIN t USING (k, gram) GROUP BY ALL),
n AS (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER o > {NEIGHBOUR} THEN 1 ELSE 0 END AS apart FROM v WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
m AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS grp FROM n),
s AS (SELECT rid, template, label, phrase, min(start) AS start, len(list_distinct(flatten(list(hit)))) / grams AS covered
      FROM m GROUP BY rid, template, label, phrase, grams, grp HAVING covered >= {COVERED})
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (WHERE phrase) AS n_base,
       min(start) FILTER (WHERE phrase) AS first_word, max(start) FILTER (WHERE phrase) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(covered), 0.0)::DOUBLE AS score
FROM d LEFT JOIN s USING (rid) GROUP BY d.rid, d.doc_id, d.w
"""
