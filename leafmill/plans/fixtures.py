"""Views derived from the driver's tables, so that every operator has data. Each view is one SQL text for
Spark and one for DuckDB, made from the same template; FIXTURES.md has the rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("nation", "region", "events", "documents", "embeddings", "conversations")

_BOOK = """
SELECT source, page, total_pages, concat('books/', source, '.pdf') AS file_path,
  concat(CASE WHEN page % 3 <> 0 THEN concat('Lecture Notes ', source, chr(10)) ELSE '' END,
         CASE WHEN page % 5 = 0 THEN concat('# Chapter ', CAST(page AS {str}), chr(10))
              WHEN page % 5 IN (1, 3) THEN concat('## Section ', CAST(page AS {str}), chr(10))
              WHEN page % 5 = 2 THEN concat('### Topic ', CAST(page AS {str}), chr(10)) ELSE '' END,
         replace(replace(text, 'ention', concat('en-', chr(10), 'tion')), ' the ', concat('  the ', chr(7))),
         CASE WHEN page % 4 = 0 THEN concat('   ', chr(10), chr(10), chr(10), chr(10), 'Draft copy') ELSE '' END,
         chr(10), 'Page ', CAST(page + 1 AS {str})) AS page_content
FROM {pages} t"""
_BOOK_PAGES = """(SELECT source, coalesce(text, '') AS text,
             CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page,
             CAST(count(*) OVER (PARTITION BY source) AS INT) AS total_pages FROM documents WHERE source IS NOT NULL)"""

SQL = {
    # Spark numbers the pages in two levels (``numbered_documents``).
    "book_pages": {"spark": _BOOK.replace("{pages}", "numbered_documents").format(str="STRING"), "duck": _BOOK.replace("{pages}", _BOOK_PAGES).format(str="VARCHAR")},
    "doc_sentences": {
        "spark": r"""
SELECT doc_id, CAST(pos AS INT) AS pos, sentence FROM (
  SELECT doc_id, posexplode(filter(transform(split(regexp_replace(text, '([.!?]["\')\\]]*)\\s+', concat('$1', chr(1))), chr(1)),
         x -> regexp_replace(x, '\\A[\\s\\p{Z}\\x1c-\\x1f\\x85]+|[\\s\\p{Z}\\x1c-\\x1f\\x85]+\\z', '')), x -> x <> '')) AS (pos, sentence) FROM documents)""",
        "duck": r"""
SELECT doc_id, unnest(range(0, len(s)))::INT AS pos, unnest(s) AS sentence FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)),
         lambda x: regexp_replace(x, '\A[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+\z', '', 'g')), lambda x: x <> '') AS s FROM documents)""",
    },
    "sentence_vectors": """
SELECT s.doc_id, s.pos, s.sentence, e.embedding FROM doc_sentences s
CROSS JOIN (SELECT count(*) AS n FROM embeddings) c JOIN embeddings e ON e.vec_id = (s.doc_id * 31 + s.pos) % c.n""",
    "doc_pages": {
        "spark": """
SELECT concat('doc_', doc_id) AS source, CAST(floor(pos / 12) AS INT) AS page,
  array_join(transform(array_sort(collect_list(struct(pos, sentence))), x -> x.sentence), chr(10)) AS page_content
FROM doc_sentences GROUP BY doc_id, floor(pos / 12)""",
        "duck": """
SELECT 'doc_' || doc_id AS source, CAST(pos // 12 AS INT) AS page, string_agg(sentence, chr(10) ORDER BY pos) AS page_content
FROM doc_sentences GROUP BY doc_id, pos // 12""",
    },
    "blocks": """
SELECT concat('doc_', CAST(doc_id AS {str})) AS source, CAST(pos % 3 AS INT) AS page_num, pos AS seq,
  CAST((pos * 35 + 10) % 700 AS DOUBLE) AS y0, CAST((pos % 2) * 300 AS DOUBLE) AS x0,
  CASE WHEN pos % 11 = 10 THEN '  ' ELSE sentence END AS text FROM doc_sentences""",
    "scans": """
SELECT doc_id, CAST(doc_id % 3 AS INT) AS n_images, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text FROM documents""",
    "cells": {
        "spark": """
SELECT r_name AS source, array(transform(array_sort(collect_list(struct(n_nationkey, n_name))),
  x -> array(CAST(x.n_nationkey AS STRING), CASE WHEN x.n_nationkey % 6 = 0 THEN NULL ELSE x.n_name END))) AS tables
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
        "duck": """
SELECT r_name AS source, [list([CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_name END] ORDER BY n_nationkey)] AS tables
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    },
    "chunk_store": """
SELECT {sha}(concat(source, '::chunk_', CAST(vec_id AS {str})){bits}) AS chunk_id, doc_id, source, text, embedding, CAST(vec_id % 7 AS INT) AS page_start FROM (
  SELECT vec_id, concat('src', CAST(label AS {str})) AS source, concat('d', CAST(vec_id % 10 AS {str})) AS doc_id, d.text AS text, embedding
  FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM documents) c JOIN documents d ON d.doc_id = vec_id % c.n) v""",
    # Every row whose id is divisible by 50, against all rows but itself.
    "queries": """
SELECT vec_id AS query_id, embedding, {sha}(concat('src', CAST(label AS {str}), '::chunk_', CAST(vec_id AS {str})){bits}) AS own_chunk
FROM embeddings WHERE vec_id % 50 = 0""",
    "requests": """
SELECT conv_id AS request_id, concat('d', CAST(conv_id % 13 AS {str})) AS doc_id, text AS topic,
  CASE WHEN conv_id % 11 = 0 THEN NULL ELSE CAST(conv_id % 23 AS INT) END AS num_questions,
  CASE conv_id % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' WHEN 3 THEN 'extreme' ELSE NULL END AS difficulty
FROM conversations WHERE turn = 0""",
    "responses": """
SELECT request_id, attempt, CASE kind
  WHEN 0 THEN concat('[', good, ']')
  WHEN 1 THEN concat('```json', chr(10), '[', good, ',', good, ']', chr(10), '```')
  WHEN 2 THEN concat('Here you are: [', good, '] Good luck.')
  WHEN 3 THEN concat('[', good, ',{{"question":"', q, '","options":{{"A":"one","B":"two","C":"three","D":"four"}},"correct":"B"}}]')
  WHEN 4 THEN concat('[', replace(good, '"correct":"B"', '"correct":"E"'), ']')
  WHEN 5 THEN '[]'
  WHEN 6 THEN concat('I cannot answer that. ', q)
  WHEN 7 THEN good
  WHEN 8 THEN concat('[', replace(good, concat('"question":"', q, '"'), '"question":5'), ']')
  WHEN 10 THEN '["only text"]'
  WHEN 11 THEN concat('[', replace(good, concat('"question":"', q, '",'), ''), ']')
  WHEN 12 THEN concat('[', good, ',', replace(good, concat('"question":"', q, '"'), '"question":"  "'), ']')
  WHEN 13 THEN concat('[{{"question":"', q, '","correct":"B","explanation":"Because ', q, '"}}]')
  WHEN 14 THEN concat('[', replace(good, '{{"A":"one","B":"two","C":"three","D":"four"}}', '["one","two"]'), ']')
  WHEN 15 THEN concat('[', replace(good, '"D":"four"', '"E":"four"'), ']')
  WHEN 16 THEN concat('[', replace(good, '"C":"three"', '"C":" "'), ']')
  WHEN 17 THEN concat('[', replace(good, ',"correct":"B"', ''), ']')
  WHEN 18 THEN concat('[', replace(good, concat('"explanation":"Because ', q, '"'), '"explanation":7'), ']')
  WHEN 19 THEN concat('[', good, ',', good, ',', replace(good, concat('"explanation":"Because ', q, '"'), '"explanation":"short"'), ']')
  ELSE concat('[', substr(good, 1, 60)) END AS raw_response
FROM (SELECT request_id, attempt, q, CAST((request_id * 7 + attempt) % 20 AS INT) AS kind,
    concat('{{"question":"', q, '","options":{{"A":"one","B":"two","C":"three","D":"four"}},"correct":"B","explanation":"Because ', q, '"}}') AS good
  FROM (SELECT conv_id AS request_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS attempt,
      concat('q', CAST(conv_id AS {str}), ' ', translate(text, concat('"', chr(92), chr(10), chr(9), chr(13)), '')) AS q
    FROM conversations WHERE role = 'assistant') a) b""",
    "answers": """
SELECT user_id AS session_id, CAST(event_id % 20 + 1 AS INT) AS question_id,
  substr('ABCD', CAST(floor(event_id / 20) % 4 AS INT) + 1, 1) AS selected, ts, event_id FROM events""",
    "answer_key": """
SELECT CAST(question_id AS INT) AS question_id, substr('ABCD', CAST(question_id % 4 AS INT) + 1, 1) AS correct
FROM (SELECT DISTINCT event_id % 20 + 1 AS question_id FROM events) k""",
}

#: Bits of a doc_id within a block, in which pages are numbered.
BLOCK_BITS = 10

#: Views that a view reads.
NEEDS = {"sentence_vectors": ["doc_sentences"], "doc_pages": ["doc_sentences"], "blocks": ["doc_sentences"]}

_SPARK = {"str": "STRING", "sha": "sha2", "bits": ", 256"}
_DUCK = {"str": "VARCHAR", "sha": "sha256", "bits": ""}


def _text(view: str, dialect: str) -> str:
    sql = SQL[view]
    if isinstance(sql, dict):
        return sql[dialect]
    return sql.format(**(_SPARK if dialect == "spark" else _DUCK))


def numbered_documents(docs: DataFrame) -> DataFrame:
    """The documents of each source as its pages, by doc_id: source, text, page (from 0), total_pages. They are numbered
    within blocks of ids, and blocks on one row each, so that no task holds a source. Documents of one id are ordered by
    what they hold: every reading numbers them alike."""
    own = docs.where("source IS NOT NULL").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("block", F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(-(1 << 63))))
    per = own.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    source = Window.partitionBy("source")
    earlier = F.sum("n").over(source.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = per.select("source", "block", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("n").over(source).alias("total"))
    place = F.row_number().over(Window.partitionBy("source", "block").orderBy("doc_id", F.xxhash64("text"))) - 1
    placed = own.withColumn("place", place).join(blocks, ["source", "block"])
    return placed.select("source", "text", (F.col("place") + F.col("before")).cast("int").alias("page"), F.col("total").cast("int").alias("total_pages"))


def fixture(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A derived view over the tables in ``sf_dir``."""
    sql = _text(view, "spark")
    inputs = {n: fixture(spark, sf_dir, n) for n in NEEDS.get(view, [])}
    if view == "book_pages":
        inputs["numbered_documents"] = numbered_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    read = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql))
    inputs |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in read}
    for name, df in inputs.items():
        df.createOrReplaceTempView(f"leafmill_{name}")
        sql = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 leafmill_{name}", sql)
    return spark.sql(sql)


def duck_ctes(*views: str) -> str:
    """The views (with those they read) as common table expressions for DuckDB."""
    order: list[str] = []
    for v in views:
        for x in [*NEEDS.get(v, []), v]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{v} AS ({_text(v, 'duck')})" for v in order)
