"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.llm.common import table


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False  # an exact phrase: each place counts by itself


#: Separators of words; what is left are a-z, 0-9 and all beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases of the query's contract.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

#: Public notices that the method recognises besides, whole or in large part.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    Template("apache-2", "licensed under the apache license version 2.0"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4.0 international license"),
    Template("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Words of a rolling gram, words between diagonals that are merged, and the share of a notice's grams that a span must hold.
K = 3
MAX_GAP = 3
MIN_COVER = 0.8
#: Most template grams that are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased words of a text. Letters beyond ASCII may be lower-cased too,
    which no template can tell, but never into ASCII: texts with one of the two
    capitals that would be keep the slow path."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(
        F.contains(t, F.lit("K")) | F.contains(t, F.lit("İ")),
        F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    ).otherwise(F.lower(t))
    return F.split(low, SEPARATORS, -1)


def _trimmed(words: Column) -> Column:
    """Without the empty strings that a separator at either end leaves."""
    first = F.when(F.get(words, F.lit(0)) == "", F.lit(1)).otherwise(F.lit(0))
    last = F.when((F.size(words) > 1) & (F.get(words, F.size(words) - 1) == ""), F.lit(1)).otherwise(F.lit(0))
    return F.slice(words, first + 1, F.greatest(F.size(words) - first - last, F.lit(0)))


def _grams(df: DataFrame, words: str, keep: Sequence[str], k: int) -> DataFrame:
    """A row for each word with the gram that begins there; grams cut by the end hold nulls."""
    w = F.col(words)
    zipped = F.arrays_zip(*[(w if i == 0 else F.slice(w, i + 1, F.greatest(F.size(w) - i, F.lit(0)))).alias(f"w{i}") for i in range(k)])
    out = df.select(*keep, F.posexplode_outer(zipped).alias("pos", "g"))
    grams = [F.col("g")[f"w{i}"] for i in range(k)]
    return out.select(*keep, "pos", *[g.alias(f"w{i}") for i, g in enumerate(grams)])


def gram_rows(templates: Sequence[Template], k: int = K, min_cover: float = MIN_COVER) -> list[tuple]:
    """(tid, label, base, tlen, tpos, tells, words of the gram) of each position of the templates.

    Two notices of different labels of which one's grams cover the other well
    enough to pass for it (version 2 and version 3) are told apart by the grams
    that only one has: ``tells`` is set on those. Where nothing can pass for a
    template, all its grams tell.
    """
    cut = []
    for t in templates:
        words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in t.text.lower()).split()
        if len(words) < k:
            raise ValueError(f"a template needs at least {k} words: {t.text!r}")
        cut.append((t, len(words), [tuple(words[p : p + k]) for p in range(len(words) - k + 1)]))
    rows = []
    for tid, (t, n, grams) in enumerate(cut):
        like = [set(g) for o, _, g in cut if o.label != t.label and not o.base and len(set(g) & set(grams)) >= min_cover * len(set(grams))]
        rows += [(tid, t.label, t.base, n, p, not any(g in x for x in like), *g) for p, g in enumerate(grams)]
    return rows


def template_grams(spark: SparkSession, templates: Sequence[Template], k: int, min_cover: float) -> DataFrame:
    """gram_rows as a table with the hash ``th`` of each gram."""
    rows = gram_rows(templates, k, min_cover)
    schema = "tid int, label string, base boolean, tlen int, tpos int, tells boolean, " + ", ".join(f"t{i} string" for i in range(k))
    grams = spark.createDataFrame(rows, schema).withColumn("th", F.xxhash64(*[f"t{i}" for i in range(k)]))
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = BASE + NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    max_gap: int = MAX_GAP,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """Finds license templates in texts by voting on diagonals.

    All rolling word k-grams of all texts are hashed and joined with the
    template positions of that hash; equal words confirm each hit. Hits are
    summed by (document, template, position - template position); neighbouring
    diagonals (starts at most a template apart, offsets at most ``max_gap``
    words apart) are merged, which bridges words put in or left out; a merged
    span is verified by the share of the template's grams that it holds, and,
    where another notice could pass for it, by a gram that only it has. Base
    templates count wherever one diagonal holds all their grams. A row for
    every document rides along in the same pass, so texts are neither joined
    nor shuffled.

    Returns a row for each row of ``docs``: ``id_col``, ``n_words``,
    ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` (the largest share of a template found) and ``spans``, an array of
    (label, first word, last word, cover).

    Edge cases: a null or empty text has no words and no labels (empty strings,
    null places, score 0); rows that repeat id and text are judged once and all
    returned; a null id is a value like any other; very long texts are read
    whole; a span that two templates of one label hold counts for each; notices
    that only differ in words a text does not have give no label; an empty table
    gives an empty table; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    base = (
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("th0"), _trimmed(words_of(F.col(text_col))).alias("words"))
        .withColumn("n_words", F.size("words").cast("long"))
    )
    grams = _grams(base, "words", ["doc", "th0", "n_words"], k)
    # copies of a row are counted where its first gram is
    hit = grams.withColumn("one", (F.coalesce(F.col("pos"), F.lit(0)) == 0).cast("long")).withColumn("h", F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*[f"w{i}" for i in range(k)])))
    tpl = template_grams(spark, templates, k, min_cover)
    same = F.col("h") == F.col("th")
    for i in range(k):
        same = same & (F.col(f"w{i}") == F.col(f"t{i}"))
    votes = (
        hit.join(tpl, same, "left")
        .where(F.col("tid").isNotNull() | (F.col("one") == 1))
        .groupBy("doc", "th0", "n_words", "tid", "label", "base", "tlen", (F.col("pos") - F.col("tpos")).alias("diag"))
        .agg(F.collect_set("tpos").alias("tposes"), F.coalesce(F.max("tells"), F.lit(False)).alias("tells"), F.sum("one").alias("copies"))
        .withColumns({"got": F.size("tposes"), "lo": F.col("diag") + F.array_min("tposes"), "hi": F.col("diag") + F.array_max("tposes") + (k - 1)})
    )
    order = W.partitionBy("doc", "th0", "tid").orderBy("lo", "diag")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    apart = (
        (F.col("lo") - F.max("hi").over(before) > max_gap)
        | (F.abs(F.col("diag") - F.lag("diag").over(order)) > max_gap)
        | (F.col("lo") - F.lag("lo").over(order) >= F.col("tlen"))
    )
    merged = (
        votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc", "th0", "n_words", "tid", "label", "base", "tlen", "island")
        .agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.size(F.array_distinct(F.flatten(F.collect_list("tposes")))).alias("got"),
            F.sum((F.col("got") == F.col("tlen") - (k - 1)).cast("long")).alias("whole"),
            F.min(F.when(F.col("got") == F.col("tlen") - (k - 1), F.col("diag"))).alias("first"),
            F.max(F.when(F.col("got") == F.col("tlen") - (k - 1), F.col("diag"))).alias("last"),
            F.max("tells").alias("tells"),
            F.max("copies").alias("copies"),
        )
        .withColumn("cover", F.coalesce(F.col("got") / (F.col("tlen") - (k - 1)), F.lit(0.0)))
    )
    is_base = F.col("base") & (F.col("whole") > 0)
    found = is_base | (~F.col("base") & (F.col("cover") >= min_cover) & F.col("tells"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        merged.groupBy("doc", "th0", "n_words")
        .agg(
            F.coalesce(F.sum(F.when(is_base, F.col("whole"))), F.lit(0)).alias("n_base"),
            F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(is_base, F.col("last"))).cast("long").alias("last_word"),
            labels(is_base).alias("base_labels"),
            labels(found).alias("labels"),
            F.max("cover").alias("score"),
            F.array_sort(F.collect_list(F.when(found, F.struct(F.col("lo").alias("first"), F.col("hi").alias("last"), "label", "cover")))).alias("spans"),
            F.max("copies").alias("copies"),
        )
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select(F.col("doc").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _oracle_sql() -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({tid}, {text(label)}, {base}, {n}, {p}, {tells}, {text(' '.join(g))})" for tid, label, base, n, p, tells, *g in gram_rows(BASE + NOTICES))
    whole = f"FILTER (WHERE got = tlen - {K - 1})"
    return f"""
WITH t(tid, label, base, tlen, tpos, tells, gram) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT rid, i - 1 AS pos, a || ' ' || b || ' ' || c AS gram FROM (SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM d)),
v AS (SELECT rid, tid, label, base, tlen, pos - tpos AS diag, list(DISTINCT tpos) AS tp, count(DISTINCT tpos) AS got, min(pos) AS lo, max(pos) + {K - 1} AS hi, bool_or(tells) AS tells
      FROM g JOIN t USING (gram) GROUP BY ALL),
o AS (SELECT *, coalesce(lo - max(hi) OVER (PARTITION BY rid, tid ORDER BY lo, diag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {MAX_GAP}
        OR abs(diag - lag(diag) OVER u) > {MAX_GAP} OR lo - lag(lo) OVER u >= tlen, TRUE)::INT AS new FROM v WINDOW u AS (PARTITION BY rid, tid ORDER BY lo, diag)),
s AS (SELECT *, sum(new) OVER (PARTITION BY rid, tid ORDER BY lo, diag) AS island FROM o),
m AS (SELECT rid, tid, label, base, tlen, island, len(list_distinct(flatten(list(tp)))) / (tlen - {K - 1}) AS cover, count(*) {whole} AS n_whole,
        min(diag) {whole} AS first, max(diag) {whole} AS last, bool_or(tells) AS tells FROM s GROUP BY rid, tid, label, base, tlen, island),
f AS (SELECT *, base AND n_whole > 0 AS is_base, (base AND n_whole > 0) OR (NOT base AND cover >= {MIN_COVER} AND tells) AS found FROM m),
r AS (SELECT rid, sum(n_whole) FILTER (WHERE is_base) AS n_base, min(first) FILTER (WHERE is_base) AS first_word, max(last) FILTER (WHERE is_base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(cover) AS score
      FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (rid)
"""


ORACLE_SQL = _oracle_sql()
