"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import partitions
from ..sources.tables import table
from . import encode, language, mix, neardup, split, subject, terms

REG = Registry()


def _languages(spark, d):
    documents = table(spark, d, "documents")
    filters = language.fit(language.training_texts(documents, sample_rows=2000))
    return language.detect_languages(language.items(documents, table(spark, d, "chunks"), table(spark, d, "eval_queries")), filters)


@REG.add("p1_found")
def p1_found(spark, d):
    return language.label_cases(_languages(spark, d))


@REG.add("p1_segments")
def p1_segments(spark, d):
    return _languages(spark, d).select("item_table", "item_id", F.explode("segments").alias("s")).select("item_table", "item_id", "s.*").distinct()


_SIZE = "length(text) + CASE WHEN len(headings) > 0 THEN length(array_to_string(headings, ' > ')) + 2 ELSE 0 END"


@REG.add("p3_found", f"SELECT DISTINCT chunk_id FROM chunks WHERE text IS NOT NULL AND {_SIZE} > 1500")
def p3_found(spark, d):
    return split.split_items(table(spark, d, "chunks"), once=False).select("chunk_id").distinct()


@REG.add("p3_pieces")
def p3_pieces(spark, d):
    return split.split_items(table(spark, d, "chunks"))


_TAGS = r"""
WITH t AS (
  SELECT path, lower(trim(ltrim(trim(tag, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '#'), ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS tag FROM tags),
c AS (SELECT tag, count(*) AS rows, count(DISTINCT path) AS notes FROM t WHERE tag IS NOT NULL AND tag <> '' GROUP BY tag),
m AS (SELECT *, CASE WHEN notes < 3 THEN 'rare' WHEN notes > 0.05 * (SELECT count(DISTINCT path) FROM tags) THEN 'common' END AS mark FROM c)
"""


@REG.add("p5_found", _TAGS + "SELECT tag, mark FROM m WHERE mark IS NOT NULL")
def p5_found(spark, d):
    return terms.tag_counts(table(spark, d, "tags")).filter("mark is not null").select("tag", "mark")


@REG.add("p5_counts", _TAGS + "SELECT tag, rows, notes, mark FROM m")
def p5_counts(spark, d):
    return terms.tag_counts(table(spark, d, "tags"))


@REG.add("p5_parts", _TAGS + """, s AS (SELECT path, list_filter(string_split(tag, '/'), lambda x: x <> '') AS w FROM t WHERE tag IS NOT NULL),
g AS (SELECT path, n, array_to_string(list_slice(w, i, i + n - 1), '/') AS part FROM s, unnest(range(1, len(w) + 1)) AS a(n), unnest(range(1, len(w) + 1)) AS b(i) WHERE i + n - 1 <= len(w))
SELECT CAST(n AS INT) AS n, part, count(*) AS rows, count(DISTINCT path) AS notes FROM g GROUP BY ALL""")
def p5_parts(spark, d):
    return terms.tag_part_counts(table(spark, d, "tags"))


@REG.add("p6_ids")
def p6_ids(spark, d):
    return encode.encode_corpus(table(spark, d, "documents"))


def _mixed(spark, d):
    return mix.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"), shards=partitions(spark, 16))


@REG.add("p7_draws")
def p7_draws(spark, d):
    return _mixed(spark, d)[0]


@REG.add("p7_shares")
def p7_shares(spark, d):
    return _mixed(spark, d)[1]


@REG.add("p7_options")
def p7_options(spark, d):
    return _mixed(spark, d)[2]


@REG.add("p4_found")
def p4_found(spark, d):
    return neardup.NearDuplicates(table(spark, d, "chunks"), table(spark, d, "notes")).pairs()


@REG.add("p4_groups")
def p4_groups(spark, d):
    return neardup.NearDuplicates(table(spark, d, "chunks"), table(spark, d, "notes")).groups()


def _subject_model(spark, d):
    subjects = subject.allowed(table(spark, d, "subject_areas"))
    blocks = subject.cut_texts(table(spark, d, "documents"), table(spark, d, "subject_labels"), subjects)
    return blocks, subject.fit_blocks(blocks, subjects)


def _subjects(spark, d):
    blocks, model = _subject_model(spark, d)
    return subject.block_shares(blocks, model), model


@REG.add("p8_found")
def p8_found(spark, d):
    return subject.subject_rows(*_subjects(spark, d)).select("doc_id", "subject").distinct()


@REG.add("p8_composition")
def p8_composition(spark, d):
    return subject.composition(*_subjects(spark, d))


@REG.add("p8_functions")
def p8_functions(spark, d):
    _, model = _subject_model(spark, d)
    return spark.createDataFrame(model.functions(), "function string, coverage double, accuracy double, accuracy_none double")
