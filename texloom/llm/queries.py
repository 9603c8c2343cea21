"""The registered queries opN_<name>, each a thin application of its operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, fim, langid, licenses, merkle, minhash, mixing, quality, resharding, token_counts, topk, toxicity, urlfilter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), size=2, threshold=80).drop("h")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", counted.n_tokens > 1024)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir)).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "drawn")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


# Rules of the URL query and what they say (fixed values).
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES, urlfilter.claimed_twice(pages))


def op10_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 6
    placed = resharding.reshard(_documents(spark, sf_dir), old, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op11_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(_documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_minmax_dedup": op3_minmax_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_pivot_topk": op5_pivot_topk,
    "op6_token_counts": op6_token_counts,
    "op7_source_mixing": op7_source_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_url_filter": op9_url_filter,
    "op10_flow_resharding": op10_flow_resharding,
    "op11_toxic_segments": op11_toxic_segments,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op5_pivot_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT row_number() OVER () AS ask, * FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0)),
s AS (SELECT q.ask, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op9_url_filter": """
WITH p AS (SELECT page_id, url, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (SELECT *, CASE WHEN host <> '' THEN concat(regexp_replace(host, '^www\\.', ''), regexp_replace(path, '/+$', '')) END AS canonical FROM h),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1),
r AS (SELECT c.page_id, c.host, c.path, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
  l.canonical IS NOT NULL AS listed FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r""",
    "op12_merkle_manifest": """
WITH RECURSIVE d AS (SELECT doc_id, source, text, concat(_F(doc_id), _F(source), _F(lang), _F(n_chars)) AS head,
  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, b)), 4294967295), 4294967295) % 5 = 0 AS hit FROM documents),
l AS (SELECT doc_id, source, sha256(concat(head, _F(text))) AS leaf,
  CASE WHEN hit THEN sha256(concat(head, _F(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) END AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
t AS (SELECT source, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM p
  UNION ALL SELECT source, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY source, level, idx // 16, n),
r AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, idx, subroot AS digest, n FROM r
  UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, idx // 16, n),
ts AS (SELECT a.source, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lo, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS hi
  FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY 1, 2, 3),
us AS (SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lo, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS hi
  FROM u a JOIN u b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY 1, 2),
f AS (SELECT source, idx AS leaf_idx, 0 AS level, idx, coalesce(changed, leaf) AS digest, '' AS proof FROM p
  UNION ALL SELECT f.source, f.leaf_idx, f.level + 1, f.idx // 16, sha256(concat(lo, f.digest, hi)), concat(f.proof, lo, hi) FROM f JOIN ts ON ts.source IS NOT DISTINCT FROM f.source AND ts.level = f.level AND ts.idx = f.idx),
top AS (SELECT source, leaf_idx, digest, proof FROM f QUALIFY row_number() OVER (PARTITION BY source, leaf_idx ORDER BY level DESC) = 1),
g AS (SELECT top.source, leaf_idx, 0 AS level, r.idx, digest, proof FROM top JOIN r ON r.source IS NOT DISTINCT FROM top.source
  UNION ALL SELECT g.source, g.leaf_idx, g.level + 1, g.idx // 16, sha256(concat(lo, g.digest, hi)), concat(g.proof, lo, hi) FROM g JOIN us ON us.level = g.level AND us.idx = g.idx),
e AS (SELECT source, leaf_idx, digest, proof FROM g QUALIFY row_number() OVER (PARTITION BY source, leaf_idx ORDER BY level DESC) = 1)
SELECT p.doc_id, p.leaf, r.subroot, w.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = w.digest AS verified
FROM p JOIN e ON e.source IS NOT DISTINCT FROM p.source AND e.leaf_idx = p.idx JOIN r ON r.source IS NOT DISTINCT FROM p.source, (SELECT digest FROM u WHERE n = 1) w""",
    "op13_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
n AS (SELECT *, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST(concat('0x', substr(h, i, 8)) AS BIGINT)) AS d FROM t),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(units[1:low], '') AS pre, array_to_string(units[low + 1:high], '') AS mid, array_to_string(units[high + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE concat(pre, mid, suf) END) AS restored_sha256 FROM p""",
}
# _F(x) stands for a value as the manifest hashes it.
ORACLES["op12_merkle_manifest"] = re.sub(r"_F\(((?:[^()]|\([^()]*\))*)\)", r"coalesce(concat(strlen(CAST(\1 AS VARCHAR)), ':', CAST(\1 AS VARCHAR)), '-')", ORACLES["op12_merkle_manifest"])
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
