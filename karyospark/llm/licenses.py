"""License scans by diagonal voting, in DataFrame operations only.

All rolling word pairs of a text are joined by hash to the places of the same pair in license templates. A match votes
for its diagonal, the difference of the two places; votes are counted per row, template and diagonal. Votes on
neighbouring diagonals are merged, so a word more or less doesn't break a span, and a span is verified by the share
of the template's pairs that it holds, compared as words and not as hashes. A phrase is found exactly where
all its pairs lie on one diagonal.

The template table is small by its nature and is broadcast; text rows never meet each other. What is shuffled is one
row per document and one per match.

Defined results: a null or empty text has no words, no places and score 0; repeated rows give repeated results;
null ids are kept; an empty table gives no rows; other columns are never read. Texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karyospark.llm import common

# Phrases whose places are counted.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Wording of common notices, found as spans, and the least share of a notice's pairs that a span holds.
NOTICES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3", 1.0),
    ("gpl-2.0", "licensed under the gnu general public license version 2", 1.0),
    ("apache-2.0", "licensed under the apache license version 2 0", 0.75),
    ("mit", "released under the mit license", 0.75),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.75),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.75),
    ("cc-by-nc", "licensed under cc by nc 4 0", 0.75),
    ("cc-by-sa", "licensed under cc by sa 4 0", 0.75),
    ("cc-by-nd", "licensed under cc by nd 4 0", 0.75),
    ("lgpl", "gnu lesser general public license", 0.75),
    ("agpl", "gnu affero general public license", 0.75),
    ("mpl", "mozilla public license version 2 0", 0.75),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.75),
    ("all-rights-reserved", "all rights reserved", 0.75),
)
#: Diagonals that are merged to either side.
SLACK = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(chr(c) for c in range(128) if not (chr(c).isalnum()))


def word_array(text: Column) -> Column:
    """Words of a text: lower-cased A-Z; all ASCII but digits and letters separates."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """A row per pair of a template: template, label, base, least, pairs, at, gram. Template -1 marks each document's own row."""
    rows = [F.struct(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(1.0).alias("least"), F.lit(0).alias("pairs"),
                     F.lit(0).alias("at"), F.lit("").alias("gram"))]
    for k, (base, label, phrase, least) in enumerate([*((True, *p, 1.0) for p in phrases), *((False, *n) for n in notices)]):
        words = phrase.split()
        rows += [F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(least).alias("least"),
                          F.lit(len(words) - 1).alias("pairs"), F.lit(at).alias("at"), F.lit(" ".join(words[at:at + 2])).alias("gram"))
                 for at in range(len(words) - 1)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, template, label, base, least, pairs, diagonal, n (rows), places (set of template places)."""
    worded = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), word_array(F.col("text")).alias("words"))
    pairs = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    grams = worded.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
                          F.posexplode(F.concat(F.array(F.lit("")), pairs)).alias("pos", "gram"))
    places = F.broadcast(table.withColumnRenamed("gram", "template_gram").withColumn("gram_hash", F.xxhash64("template_gram")))
    same = (F.xxhash64("gram") == F.col("gram_hash")) & (F.col("gram") == F.col("template_gram"))
    diagonal = F.when(F.col("template") >= 0, F.col("pos") - 1 - F.col("at")).otherwise(0).cast("long")
    return (grams.join(places, same)
            .groupBy("doc_id", "text_hash", "n_words", "template", "label", "base", "least", "pairs", diagonal.alias("diagonal"))
            .agg(F.count("*").alias("n"), F.collect_set("at").alias("places")))


def spans(voted: DataFrame, slack: int = SLACK) -> DataFrame:
    """Votes with ``share``: the part of the template's pairs on this diagonal and its neighbours, and ``whole``: all on this one."""
    near = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near))))
    return voted.where("template >= 0").select(
        "doc_id", "text_hash", "label", "base", "least", "diagonal", (F.size("places") == F.col("pairs")).alias("whole"),
        F.when(F.col("base"), F.size("places")).otherwise(merged).alias("held"), "pairs")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, slack: int = SLACK) -> DataFrame:
    """One row per document: words, phrase places, labels, and the best share of a template that was found."""
    voted = votes(docs, templates(docs.sparkSession, phrases, notices))
    rows = voted.where("template < 0").select("doc_id", "text_hash", "n_words", "n", *(
        F.lit(None).cast(kind).alias(name) for name, kind in (("label", "string"), ("base", "boolean"), ("least", "double"), ("diagonal", "long"), ("share", "double"))))
    share = F.when(F.col("base") & ~F.col("whole"), F.lit(0.0)).otherwise(F.col("held") / F.col("pairs"))
    found = spans(voted, slack).select(
        "doc_id", "text_hash", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("n"), "label", "base", "least", "diagonal",
        share.alias("share"))
    at = F.when(F.col("base") & (F.col("share") == 1), F.col("diagonal"))
    label = F.when(F.col("share") >= F.col("least"), F.col("label"))
    one = rows.unionByName(found).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.max("n").alias("n"), F.count(at).alias("n_base"), F.min(at).alias("first_word"),
        F.max(at).alias("last_word"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return one.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                      F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("row")).drop("row")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    kinds = [*((True, *p, 1.0) for p in PHRASES), *((False, *n) for n in NOTICES)]
    rows = ", ".join(f"({k}, '{label}', {str(base).lower()}, '{phrase}', {least})" for k, (base, label, phrase, least) in enumerate(kinds))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT id, label, base, least, string_split(phrase, ' ') AS p FROM (VALUES {rows}) AS v(id, label, base, phrase, least)),
tg AS (SELECT id, label, base, least, n, tp, p[tp] || ' ' || p[tp + 1] AS g
       FROM (SELECT id, label, base, least, p, len(p) - 1 AS n, unnest(range(1, len(p))) AS tp FROM t)),
dg AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM docs)),
hits AS (SELECT DISTINCT r, id, label, base, least, n, i - tp AS diag, tp FROM dg JOIN tg USING (g)),
own AS (SELECT r, id, label, base, least, n, diag, count(*) AS k FROM hits GROUP BY ALL),
merged AS (SELECT o.r, o.id, o.diag, count(DISTINCT h.tp) AS k FROM own o
           JOIN hits h ON h.r = o.r AND h.id = o.id AND h.diag BETWEEN o.diag - {SLACK} AND o.diag + {SLACK} GROUP BY ALL),
found AS (SELECT o.r, o.label, o.base, o.least, o.diag,
                 CASE WHEN o.base THEN CASE WHEN o.k = o.n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE m.k::DOUBLE / o.n END AS share
          FROM own o JOIN merged m ON m.r = o.r AND m.id = o.id AND m.diag = o.diag),
per AS (SELECT r, count(*) FILTER (base AND share = 1) AS n_base, min(diag) FILTER (base AND share = 1) AS first_word,
               max(diag) FILTER (base AND share = 1) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND share >= least) AS base_labels,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= least) AS labels, max(share) AS score
        FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN per USING (r)
"""


ORACLE_SQL = _sql()
