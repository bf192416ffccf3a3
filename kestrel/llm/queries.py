"""Queries over the whole tables, one per operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import (
    bpe,
    exact_dedup,
    filter_audit,
    langid,
    line_dedup,
    minhash,
    packing,
    sharding,
    simhash,
    spelling,
    substring_dedup,
    topk,
    url_rules,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op2_prefix_sum_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.report(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op7_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(_table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    """The public tokenizer file of op8."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(_table(spark, sf_dir, "documents"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(_table(spark, sf_dir, "documents"))


ALL = (
    op1_simhash_near_dedup,
    op2_prefix_sum_sharding,
    op3_exact_dedup,
    op4_language_id,
    op5_url_rules,
    op6_line_dedup,
    op7_ball_tree_topk,
    op8_bpe_distinct_words,
    op9_substring_dedup,
    op10_best_fit_packing,
    op11_spelling_variants,
    op12_filter_interaction_audit,
    op13_minhash_near_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i,
         unnest(string_split(text, chr(10))) AS line
  FROM (SELECT doc_id, source, text, 1 AS i FROM documents)
), numbered AS (
  SELECT doc_id, source, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
         row_number() OVER () AS at
  FROM l
), pages AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), common AS (
  SELECT n.source, n.t
  FROM numbered n JOIN pages p ON n.source IS NOT DISTINCT FROM p.source
  WHERE n.t <> ''
  GROUP BY n.source, n.t, p.pages
  HAVING count(DISTINCT n.doc_id) >= 2 AND count(DISTINCT n.doc_id) > p.pages * 0.1
)
SELECT n.doc_id,
       count(*) AS n_lines,
       count(c.t) AS n_dropped,
       sha256(coalesce(string_agg(n.line, chr(10) ORDER BY n.at) FILTER (c.t IS NULL), '')) AS kept_sha256
FROM numbered n LEFT JOIN common c ON n.source IS NOT DISTINCT FROM c.source AND n.t = c.t
GROUP BY n.doc_id
"""

OP7_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d
), spans AS (
  SELECT doc_id, pos, word,
         CASE WHEN count(*) OVER s = 35 THEN md5(string_agg(word, ' ') OVER s) END AS span
  FROM w
  WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), starts AS (
  SELECT doc_id, pos, word, span IS NOT NULL AND count(*) OVER (PARTITION BY span) > 1 AS again FROM spans
), marked AS (
  SELECT doc_id, pos, word,
         bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM starts
)
SELECT d.doc_id, count(m.word) AS n_words, count(*) FILTER (m.gone) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.pos) FILTER (NOT m.gone), '')) AS kept_sha256
FROM d LEFT JOIN marked m ON d.doc_id = m.doc_id
GROUP BY d.doc_id
"""


OP11_SQL = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM bits WHERE k = 8
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents
), lowered AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM found
), occurring AS (
  SELECT doc_id, r, count(*) AS n FROM lowered GROUP BY doc_id, r
), coded AS (
  SELECT doc_id, r, n,
         flatten(list_transform(string_split(doc_id || ':' || r, ''),
                 lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS bytes
  FROM occurring
), hashed AS (
  SELECT r, n,
         xor(list_reduce(bytes, lambda h, b: xor(h // 256, crcs[xor(h % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM (SELECT r, n, list_transform(bytes, lambda b: b::BIGINT) AS bytes FROM coded) CROSS JOIN crc_table
), runs AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(r, 1, (h % length(r))::INT) || substring(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM runs WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (
  SELECT word, i, substring(word, 1, i::INT - 1) || substring(word, i::INT + 1) AS cut
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION
  SELECT c.word, w.word FROM cuts c JOIN words w ON c.cut = w.word
  UNION
  SELECT w.word, c.word FROM cuts c JOIN words w ON c.cut = w.word
), ranked AS (
  SELECT p.a, p.b, w.n AS b_n, count(*) OVER (PARTITION BY p.a) AS n_near,
         row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, encode(p.b)) AS k
  FROM near p JOIN words w ON p.b = w.word
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
         CASE WHEN r.b_n >= 2 * w.n THEN r.b END AS form, CASE WHEN r.b_n >= 2 * w.n THEN r.b_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.a AND r.k = 1
), chain(word, last) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON c.last = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.last AS root FROM chain c JOIN formed f ON c.last = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON f.word = r.word
"""


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(words) < 100 AS a,
         100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), fails AS (
  SELECT part, good, toxic,
         (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS f
  FROM flags
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before
  FROM orders, range(1, 6) AS k(step)
), kinds AS (
  SELECT part, good, toxic, f, count(*) AS n FROM fails GROUP BY part, good, toxic, f
), counted AS (
  SELECT part, filter_order, step, own,
         n, good, toxic, f, contains(f, own) AS failing,
         len(list_intersect(string_split(f, ''), string_split(before, ''))) > 0 AND before <> '' AND f <> '' AS gone
  FROM kinds, steps
), summed AS (
  SELECT part, filter_order, step::INT AS step, own,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (f = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost
  FROM counted GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))))
                 END AS s
  FROM w
), nodes AS (
  SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS (
  SELECT node, n, unnest(s) AS t FROM nodes
), links AS (
  SELECT a.node AS a, b.node AS b
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, other) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
), roots AS (
  SELECT node, min(other) AS root FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, s.doc_id = coalesce(r.root, s.doc_id) AS kept
FROM sets s LEFT JOIN nodes m ON s.s = m.s AND len(s.s) > 0 LEFT JOIN roots r ON m.node = r.node
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3_SQL,
        "op6_line_dedup": OP6_SQL,
        "op7_ball_tree_topk": OP7_SQL,
        "op9_substring_dedup": OP9_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_filter_interaction_audit": OP12_SQL,
        "op13_minhash_near_dedup": OP13_SQL,
    }
