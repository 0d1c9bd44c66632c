"""The queries opN_<name> of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, langid, packing, piece_codec, prefix_trie, quality, simhash, substring_dedup, suffix_dedup, token_counts, topk, toxicity, warc
from .common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), piece_model_path(), limit=4096)


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_codec.encode(_table(spark, sf_dir, "documents"), piece_model_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_source_bytes"),
        "ids",
    )
    decoded = piece_codec.decode(encoded, piece_model_path())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_source_bytes")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=13))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(suffix_dedup.remove_passages(_table(spark, sf_dir, "documents"), window=50))


def _digested(cut: DataFrame) -> DataFrame:
    """The kept words joined by single spaces, as a digest."""
    words = F.concat_ws(" ", F.filter(F.split("kept_text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), piece_model_path(), entries=0)
    return packing.pack(counted)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    manifest = warc.write(_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_quality_rules, op3_substring_dedup, op4_piece_codec, op5_simhash, op6_language_id, op7_suffix_dedup, op8_bestfit_packing, op9_warc, op10_exact_topk, op11_filter_audit, op12_prefix_trie, op13_toxicity)
    return {f.__name__: f for f in ops} | {"pipeline": _pipeline}


def _window_sql(window: int) -> str:
    """Words that a window covers which also starts in an earlier document, cut out."""
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(ws[s:s + {window - 1}], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS s FROM w)),
m AS (SELECT hash(t) AS h, t, min(doc_id) AS least FROM g GROUP BY t),
r AS (SELECT g.doc_id, list(s) AS starts FROM g JOIN m ON g.t = m.t WHERE g.doc_id > m.least GROUP BY g.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + {window})))) AS gone FROM r),
k AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS removed, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n AS n_words, CAST(removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS least FROM d),
b32 AS (SELECT *, array_to_string(list_transform(range(8), lambda i: (
  array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), ''))), '') AS digest FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM b32
"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_AUDIT_SQL = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, s AS step, 1 << (ascii(o[s]) - 65) AS own, list_sum([0] || list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))) AS earlier FROM (SELECT o, CAST(unnest(range(1, 6)) AS INT) AS s FROM o))
SELECT part, o AS filter_order, step,
  CAST(sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN b ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & own > 0 THEN n * (120 // bit_count(mask::BIGINT)) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, o, step
"""

_TRIE_SQL = """
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, list(x ORDER BY pos) AS path FROM t GROUP BY conv_id),
h AS (SELECT conv_id, path, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h FROM p),
r AS (SELECT h.conv_id, coalesce(b.path[1:h.h], []) || h.path[h.h + 1:] AS path FROM h LEFT JOIN p b ON b.conv_id = h.conv_id - h.conv_id % 100),
u AS (SELECT conv_id, path, len(path) AS size, unnest(range(0, len(path) + 1)) AS d FROM r),
n AS (SELECT d, path[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM u GROUP BY d, path[1:d]),
e AS (SELECT d, k, conv_id, n_convs, ends, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].t) END AS own, CASE WHEN d > 0 THEN k[1:d - 1] END AS up FROM n),
c AS (SELECT up, count(*) AS n_children FROM e WHERE d > 0 GROUP BY up),
z AS (SELECT e.*, coalesce(c.n_children, 0) AS n_children FROM e LEFT JOIN c ON e.k = c.up),
a AS (SELECT own, n_children, k[1:i] AS top FROM (SELECT own, n_children, k, unnest(range(0, d + 1)) AS i FROM z)),
s AS (SELECT top, sum(own) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM a GROUP BY top)
SELECT z.conv_id, CAST(z.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(z.n_convs AS BIGINT) AS n_convs, CAST(z.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(z.ends) AS ends_sha256
FROM z JOIN s ON s.top = z.k LEFT JOIN n q ON q.k = z.up
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": _window_sql(13), "op7_suffix_dedup": _window_sql(50), "op9_warc": _WARC_SQL, "op10_exact_topk": _TOPK_SQL, "op11_filter_audit": _AUDIT_SQL, "op12_prefix_trie": _TRIE_SQL}
