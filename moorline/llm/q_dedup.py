"""op3: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moorline.llm.minhash import near_duplicates
from moorline.llm.shared import table


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_superminhash": op3_superminhash}

ORACLE = {
    "op3_superminhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM sets),
reps AS (SELECT min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s, list_sort(s) AS k FROM sizes WHERE n > 0 GROUP BY list_sort(s)),
shingles AS (SELECT rep, n, unnest(s) AS g FROM reps),
common AS (
  SELECT a.rep AS u, b.rep AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS inter
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT u, v FROM common WHERE 100 * inter >= 75 * (nu + nv - inter)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT rep AS id, rep AS dst FROM reps
  UNION
  SELECT reach.id, both_ways.v FROM reach JOIN both_ways ON reach.dst = both_ways.u),
comps AS (SELECT id, min(dst) AS component_id FROM reach GROUP BY id)
SELECT z.doc_id, z.n AS n_shingles, coalesce(c.component_id, z.doc_id) AS component_id, z.doc_id = coalesce(c.component_id, z.doc_id) AS kept
FROM sizes z LEFT JOIN reps r ON z.n > 0 AND r.k = list_sort(z.s) LEFT JOIN comps c ON c.id = r.rep
""",
}
