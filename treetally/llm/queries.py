"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_sliced, hard_negatives, language, line_dedup, multi_index, packing, pii, prefix_trie, quality, sentencepiece_sampling, simhash, substring_dedup, url_rules
from .common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_products(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), language.held_out("doc_id", 3, 1))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.neighbours(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), language.held_out("doc_id", 5, 0)
    rows = language.identify(docs, language.fit(docs, ~held_out), keep=["doc_id"])
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.sequences(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_sentencepiece, op3_url_rules, op4_bit_sliced_topk, op5_best_fit_packing, op6_line_dedup, op7_simhash, op8_quality, op9_multi_index, op10_language, op11_hard_negatives, op12_substring_dedup, op13_prefix_trie)}

ORACLE_SQL = {
    "op3_url_rules": r"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM v)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(low, '\.org([^a-zA-Z0-9_.%-]|$).*\?utm_source=feed([^a-zA-Z0-9_.%-]|$)', 's') THEN 'allow'
  WHEN low LIKE '%.casino-win.%' OR low LIKE '%.cheap-pills.%' OR low LIKE '%.ads-track.%' OR regexp_matches(low, '\?utm_source=feed([^a-zA-Z0-9_.%-]|$)') THEN 'block'
  ELSE 'allow' END AS verdict FROM r
""",
    "op4_bit_sliced_topk": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, n, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
o AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.*, coalesce(l.doc_id <> o.first_doc, false) AS gone FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
""",
    "op11_hard_negatives": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.e, c.e)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.r <> a.r AND len(c.e) = len(a.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) AS n FROM s WHERE same),
f AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id, s.c) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.n <= 5)
SELECT * FROM f WHERE rank <= 3
""",
    "op12_substring_dedup": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w FROM documents),
k AS MATERIALIZED (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
g AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
c AS (SELECT r, list(p) AS gone FROM g GROUP BY r),
x AS (SELECT d.r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE r IN (SELECT r FROM c)),
y AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN g ON g.r = x.r AND g.p = x.p GROUP BY x.r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN y USING (r)
""",
    "op13_prefix_trie": r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(concat(CAST(strlen(role) AS VARCHAR), ':', role, text))) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, own, conv_id - conv_id % 5 AS base, CAST(xor(list_reduce(list_concat([4294967295], flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS INTEGER) AS h FROM o),
r AS MATERIALIZED (SELECT c.conv_id, list_concat(CASE WHEN b.own IS NULL OR c.h = 0 THEN [] ELSE b.own[1:c.h] END, c.own[c.h + 1:]) AS seq FROM c LEFT JOIN o b ON b.conv_id = c.base),
m AS (SELECT conv_id, seq, d, CASE WHEN d = 0 THEN [] ELSE seq[1:d] END AS node FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(node[d].text) END AS bytes,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = d), '')) AS ends FROM m GROUP BY node, d),
k AS (SELECT CASE WHEN d = 1 THEN [] ELSE node[1:d - 1] END AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
s AS (SELECT CASE WHEN e = 0 THEN [] ELSE node[1:e] END AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN n p ON f.d > 0 AND p.d = f.d - 1 AND p.node = CASE WHEN f.d = 1 THEN [] ELSE f.node[1:f.d - 1] END
""",
}
