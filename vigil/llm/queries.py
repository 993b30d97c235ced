"""The registered queries of this subpackage and their SQL, where SQL can
express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm.batches import small_batches
from vigil.session import checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            checkpoint_dir(spark)
            small_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_byte_level_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from vigil.llm.bpe import bpe
    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
               public_tokenizers.PATTERN, keep_ids=False)


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.pii import scan
    return scan(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.licenses import scan
    return scan(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (
  SELECT item_id, w, least(10, len(w)) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM it, unnest(range(1, len(w) - m + 2)) t(i)),
dw AS (SELECT d.doc_id, i, l.m, array_to_string(list_slice(w, i, i + l.m - 1), ' ') AS g
  FROM d, (SELECT DISTINCT m FROM win) l, unnest(range(1, len(w) - l.m + 2)) t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.m, win.item_id FROM dw JOIN win USING (m, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


@query("op7_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.decontaminate import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.html import extract
    return extract(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
        FROM d, unnest(range(1, len(w) - 11)) t(i)),
first AS (SELECT g, min(doc_id) AS doc_id FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (
  SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first ON win.g = first.g
  WHERE first.doc_id < win.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.substring import dedup
    return dedup(table(spark, sf_dir, "documents"))


@query("op4_lm_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.ngram_lm import score
    return score(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.langid import identify
    return identify(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS g
      FROM d, unnest(range(1, len(w) - least(4, len(w)) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""


@query("op8_ngram_jaccard_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.jaccard import join
    return join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL)),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
      WHERE p.norm > 0 AND q.norm > 0 AND list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, m.vec_id = c.c AS kept
FROM embeddings m JOIN c ON c.a = m.vec_id LEFT JOIN n ON n.a = m.vec_id
"""


@query("op1_embedding_neardup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.neardup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.secret_scan import scan
    return scan(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, len(embedding) AS dim,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, e.r AS er, e.vec_id AS id, e.label = a.label AS same,
             CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
      FROM e a JOIN e ON a.r <> e.r AND a.dim = e.dim WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id, er) AS k FROM s WHERE same)
      WHERE k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id, s.er) AS rank
      FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.hard_negatives import hard_negatives
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH k AS (SELECT DISTINCT conv_id AS c, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT,
           [ascii(x)::UBIGINT for x in string_split(CAST(conv_id AS VARCHAR), '')]), lambda a, b: list_reduce(
           list_prepend(xor(a, b), [i::UBIGINT for i in range(8)]), lambda z, i: CASE WHEN z & 1 = 1
           THEN xor(z >> 1, 3988292384::UBIGINT) ELSE z >> 1 END)), 4294967295::UBIGINT) % 9 AS BIGINT) AS h
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS pos, m, b FROM (
  SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m,
         strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL)),
u AS (SELECT k.c, 0 AS own, t.pos, t.m, t.b FROM k JOIN t ON t.c = k.c - k.c % 5 AND t.pos < k.h
      UNION ALL SELECT k.c, 1, t.pos, t.m, t.b FROM k JOIN t ON t.c = k.c AND t.pos >= k.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, m, b FROM u),
s AS (SELECT c, list(m ORDER BY d) AS s FROM r GROUP BY c),
pre AS (SELECT r.c, r.d, r.b, md5(array_to_string(list_slice(s.s, 1, r.d), ',')) AS p FROM r JOIN s USING (c)
        UNION ALL SELECT c, 0, 0, '' FROM k),
n AS (SELECT d, p, min(c) AS conv, count(*) AS n, any_value(b) AS b FROM pre GROUP BY d, p),
up AS (SELECT n.d, n.p, n.conv, n.n, n.b, q.p AS up FROM n LEFT JOIN pre q ON q.c = n.conv AND q.d = n.d - 1),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS kids FROM up WHERE d > 0 GROUP BY ALL),
below AS (SELECT a.d, a.p, sum(CASE WHEN kids.kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.b) AS saved
  FROM n LEFT JOIN kids ON kids.d = n.d AND kids.p = n.p JOIN pre a ON a.c = n.conv AND a.d <= n.d GROUP BY a.d, a.p),
ends AS (SELECT d, p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (
  SELECT c, max(d) AS d, arg_max(p, d) AS p FROM pre GROUP BY c) GROUP BY d, p)
SELECT up.conv AS conv_id, CAST(up.d AS BIGINT) AS depth, par.conv AS parent_conv_id, up.n AS n_convs,
       coalesce(kids.kids, 0) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM up JOIN below ON below.d = up.d AND below.p = up.p LEFT JOIN kids ON kids.d = up.d AND kids.p = up.p
LEFT JOIN n par ON par.d = up.d - 1 AND par.p = up.up LEFT JOIN ends ON ends.d = up.d AND ends.p = up.p
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.prefix_trie import trie
    return trie(table(spark, sf_dir, "conversations"))
