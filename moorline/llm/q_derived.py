"""Queries of spelling variants, vector codes and mixes: op11, op12, op13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moorline.llm import mixing, spelling, vectorcodes
from moorline.llm.shared import table


def op11_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_bounded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings"))


def op13_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.draw(table(spark, sf_dir, "documents"))).drop("n_pieces", "first_shard")


QUERIES = {f.__name__: f for f in (op11_gram_variants, op12_bounded_codes, op13_splitting_tree)}


def _crc32(text: str) -> str:
    """crc32 of a string of ASCII and Latin-1 letters, in SQL: the table and the running remainder by folds over lists."""
    byte = "flatten(list_transform(string_split({t}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + unicode(c) // 64)::BIGINT, (128 + unicode(c) % 64)::BIGINT] END))".format(t=text)
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


#: Remainders of the 256 bytes, eight folded shifts each by the reversed polynomial (fixed value of the checksum).
CRC = "crc AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], list_transform(range(8), lambda k: 0::BIGINT)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS r FROM (SELECT unnest(range(256))::BIGINT AS i)))"

VARIANTS = f"""WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT * FROM (SELECT a.word AS a, b.word AS b, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest UNION ALL SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest)),
best AS (SELECT a AS word, count(*)::BIGINT AS n_near, max(n) AS form_n, first(b ORDER BY n DESC, b) AS form FROM pairs GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
path(word, root, further) AS (SELECT word, coalesce(form, word), form IS NOT NULL FROM forms UNION ALL SELECT p.word, f.form, true FROM path p JOIN forms f ON f.word = p.root WHERE p.further AND f.form IS NOT NULL),
ends AS (SELECT p.word, p.root FROM path p JOIN forms f ON f.word = p.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds spelled out one after the other: parts of vectors as rows, entries as rows, nearest by distance and index."""
    sound = "embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0"
    nearest = "SELECT vid, part, v, first(entry ORDER BY d, entry) AS entry, min(d) AS d FROM (SELECT p.vid, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN b{r} b USING (part)) GROUP BY vid, part, v"
    mean = "SELECT part, entry, list(m ORDER BY j) AS e FROM (SELECT part, entry, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM a{r}) GROUP BY ALL) GROUP BY ALL"
    steps = ""
    for r in range(rounds):
        steps += f",\na{r} AS ({nearest.format(r=r)}), m{r} AS ({mean.format(r=r)}), b{r + 1} AS (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS vid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings WHERE {sound}),
parts AS (SELECT vid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM (SELECT vid, v, unnest(range({parts})) AS part FROM kept)),
b0 AS (SELECT part, vid - 1 AS entry, v AS e FROM parts WHERE vid <= {entries}){steps},
last AS ({nearest.format(r=rounds)}),
codes AS (SELECT vid, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vid),
book AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vid), book"""


MIX = r"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS name FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
ranked AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source IS NULL, source) AS k FROM s),
shared AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM ranked),
unit AS (SELECT coalesce(arg_min(unit, k) FILTER (unit * weight <= cap), 0) AS unit FROM shared),
targets AS (SELECT source, source_size, least(cap::DOUBLE, unit.unit * weight) AS target, least(floor(least(cap::DOUBLE, unit.unit * weight) + 0.5)::BIGINT, cap) AS words FROM ranked, unit),
line AS (SELECT d.*, source_size, target, words, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY name, doc_id, size, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source),
taken AS (SELECT doc_id, size, source_size, target, list_transform([0, 1, 2], lambda e: greatest(0, least(begin_at + e * source_size + size, words) - (begin_at + e * source_size))) AS each FROM line)
SELECT doc_id, size, source_size, target, list_sum(each)::BIGINT AS taken FROM taken"""

ORACLE = {"op11_gram_variants": VARIANTS, "op12_bounded_codes": _codes_sql(), "op13_splitting_tree": MIX}
