"""The registered queries of the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import alignment, bpe, fingerprint, media, neardup, packing, pii, quality, sharding, simhash, tokencount, urlfilter, yinyang
from tessera.session import prepare, table

#: Labels that name what is advertised; a host that has one is on the block list, beside those that show less text than markup.
SPAM_LABELS = r"(^|[.-])(ads|bets|casino|loans|pills|track)([.-]|$)"
TOKEN_LIMIT = 2048
QUALITY_LEAST = 0.3
#: The Spark setting that holds the key of the PII surrogates, and a public stand-in for test corpora where it is not set.
PII_SETTING, PII_KEY = "spark.tessera.pii.key", b"replace-this-key-in-production"


def pii_key(spark: SparkSession) -> bytes:
    """The session's own secret. Without one the stand-in, from which surrogates can be recomputed: for test corpora only."""
    held = spark.conf.get(PII_SETTING, None)
    if not held:
        warnings.warn(f"{PII_SETTING} is not set: surrogates are made with a public key", stacklevel=2)
    return held.encode() if held else PII_KEY


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. A null text is empty; an empty table gives an empty result."""
    found = fingerprint.fingerprint_edits(_documents(spark, sf_dir))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.text_of(F.col("fp")).alias("fingerprint"), fingerprint.text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fingerprint.likeness(F.col("fp"), F.col("next.fp")).alias("near_next"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per row of documents, learned from the labels outside fold 0; null and empty texts are scored, equal ids each."""
    scored = quality.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (quality.fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates for its entities, and their kinds; null and empty texts stay as they are."""
    return pii.pseudonymise(_documents(spark, sf_dir), pii_key(spark)).select("doc_id", "text", "replaced")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text; a null text is empty and has none."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(_documents(spark, sf_dir), ranks, pattern)
    return bpe.decode(encoded, ranks, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict per row of pages; a null url has an empty host and path."""
    prepare(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    listed = urlfilter.listed_hosts(pages, SPAM_LABELS)
    return urlfilter.judge(pages.select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = f"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
listed AS (
  SELECT host AS key FROM parts GROUP BY host HAVING regexp_matches(host, '{SPAM_LABELS}')
    OR coalesce(2 * sum(length(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', '', 'g'))) < sum(length(html)), false)),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a WAV file, read back; a null text is empty and has 64 silent samples."""
    read = media.read_wav(media.store_wav(_documents(spark, sf_dir)))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("peaks"), F.sha2(F.array_join("peaks", ","), 256)).alias("feature"),
    )


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of bytes and tokens of every text; a null text is empty and has none."""
    counted = tokencount.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text's ids and the end id, in sequences; a null text has the end id alone."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, by the law rows; a null text has no bytes."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = _documents(spark, sf_dir).select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.shard(rows, order=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document; a null text has no shingles and is linked with nothing."""
    found = neardup.classes(_documents(spark, sf_dir), width=4)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens for every text; a null text has none."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    return alignment.link_statistics(_documents(spark, sf_dir), a, b, of_groups=digest).withColumnRenamed("groups", "groups_sha256")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 finite components; others are not clustered."""
    prepare(spark)
    return yinyang.cluster(table(spark, sf_dir, "embeddings"), k=16, components=64, scale=64, rounds=3, salt="1")


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    parts = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS p FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT r, any_value(v) AS v, min(CAST(list_sum(list_transform(list_zip(v, p), lambda e: (e[1] - e[2]) * (e[1] - e[2]))) AS BIGINT) * {k} + c) AS m FROM kept, c{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, pos, CAST(sum(x) AS BIGINT) AS x, count(*) AS n FROM (SELECT m % {k} AS c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY c, pos)")
            parts.append(f"m{i} AS (SELECT c, list((x - ((x % n) + n) % n) // n ORDER BY pos) AS p FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.p, c{i}.p) AS p FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
       CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c = m % {k}"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text; one without words has the fingerprint zero."""
    found = simhash.classes(_documents(spark, sf_dir), width=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op1_fingerprints": op1_fingerprints, "op2_quality": op2_quality, "op3_pii": op3_pii, "op4_bpe": op4_bpe, "op5_urls": op5_urls, "op6_media": op6_media, "op7_tokens": op7_tokens, "op8_packing": op8_packing, "op9_sharding": op9_sharding, "op10_neardup": op10_neardup, "op11_alignment": op11_alignment, "op12_clusters": op12_clusters, "op13_simhash": op13_simhash}
ORACLES = {"op5_urls": OP5_SQL, "op12_clusters": _op12_sql()}
