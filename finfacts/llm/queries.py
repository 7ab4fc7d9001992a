"""The registered queries of this package: name -> function of (spark, sf_dir); and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown_lm, exact_dedup, media, mixing, neardup, pii, secrets, toxicity, url_filter, variants, warc, whitening
from ._shared import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(documents(spark, sf_dir)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The file of ranks; a parameter of the deployment.
RANKS = "byte_bpe_multi_50k.tiktoken"


def token_digests(docs: DataFrame) -> DataFrame:
    return bpe.digests(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


#: The mixture wanted: shares of tokens by domain, that is by what the labels say of quality and toxicity.
TARGETS = {"good": 0.90, "good_toxic": 0.01, "poor": 0.08, "poor_toxic": 0.01}


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of domains."""
    domain = F.concat(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "_toxic").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null and toxic is not null").select("doc_id", domain.alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), domains(spark, sf_dir), TARGETS)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(documents(spark, sf_dir))


#: Host and path rules; a parameter of the deployment.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url ends in the id of the document it shows; the outcome is what that document's label says."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null or toxic is not null")
    outcomes = labels.select(F.col("doc_id").alias("id"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("bad"))
    subject = F.expr(r"try_cast(nullif(regexp_extract(path, r'^/[a-z]{2}/([0-9]{1,18})(?![0-9])', 1), '') AS bigint)")
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes, spark.createDataFrame(RULES, "host string, path string, verdict string"), subject)
    return judged.withColumnRenamed("id", "page_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_media": op5_media,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_brown_lm": op7_brown_lm,
    "op8_secrets": op8_secrets,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
    "op11_variants": op11_variants,
    "op12_url_filter": op12_url_filter,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, first(doc_id ORDER BY len DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
    """,
    "op12_url_filter": r"""
        WITH parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        told AS (SELECT p.host, count(*) AS n, sum(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) AS k FROM parsed p JOIN labels l
            ON l.doc_id = TRY_CAST(nullif(regexp_extract(p.path, '^/[a-z]{2}/([0-9]{1,18})([^0-9]|$)', 1), '') AS BIGINT) WHERE l.quality IS NOT NULL OR l.toxic IS NOT NULL GROUP BY 1),
        hosts AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, regexp_replace(regexp_replace(split_part(host, '@', -1), ':[0-9]*$', ''), '\.+$', '') AS name FROM (SELECT DISTINCT host FROM parsed) LEFT JOIN told USING (host)),
        parts AS (SELECT *, string_split(name, '.') AS w FROM hosts),
        ends AS (SELECT *, array_to_string(w[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.nz', 'co.za', 'co.in', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'com.tw') AS two FROM parts),
        named AS (SELECT *, CASE WHEN regexp_matches(name, '^[0-9.]+$|[\[\]]') THEN name WHEN two THEN array_to_string(w[-3:], '.') ELSE array_to_string(w[-2:], '.') END AS domain, CASE WHEN two THEN array_to_string(w[-2:], '.') ELSE w[-1] END AS suffix FROM ends),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, sum(n * n)::DOUBLE AS q, coalesce(sum(k * k / n::DOUBLE) FILTER (WHERE n > 0), 0) AS x, count(*) FILTER (WHERE n > 0) AS g FROM named GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, sum(n * n)::DOUBLE AS q, coalesce(sum(k * k / n::DOUBLE) FILTER (WHERE n > 0), 0) AS x, count(*) FILTER (WHERE n > 0) AS g FROM domains GROUP BY ALL),
        tops AS (SELECT sum(n) AS n, sum(k) AS k, sum(n * n)::DOUBLE AS q, coalesce(sum(k * k / n::DOUBLE) FILTER (WHERE n > 0), 0) AS x, count(*) FILTER (WHERE n > 0) AS g FROM suffixes),
        sums AS (SELECT 0 AS lev, n, k, q, x, g FROM domains UNION ALL SELECT 1, n, k, q, x, g FROM suffixes UNION ALL SELECT 2, n, k, q, x, g FROM tops),
        rates AS (SELECT *, k / n::DOUBLE AS r FROM sums WHERE n > 0),
        spreads AS (SELECT lev, sum(x - k * k / n::DOUBLE - r * (1 - r) * (g - 1)) AS a, sum(r * (1 - r) * (n - q / n - (g - 1))) AS b FROM rates GROUP BY 1),
        rhos AS (SELECT v.lev, coalesce(CASE WHEN b > 0 THEN least(greatest(a / b, 0.001), 0.5) END, 0.001) AS rho FROM (VALUES (0), (1), (2)) v(lev) LEFT JOIN spreads s ON s.lev = v.lev),
        m AS (SELECT max(rho) FILTER (WHERE lev = 0) AS rh, max(rho) FILTER (WHERE lev = 1) AS rd, max(rho) FILTER (WHERE lev = 2) AS rs FROM rhos),
        ps AS (SELECT s.suffix, s.n AS pn, s.k AS pk, (t.k - s.k + 0.5) / (t.n - s.n + 1) AS pm, 1 / least(m.rs + 1 / (t.n - s.n + 2), 0.9) - 1 AS pw FROM suffixes s, tops t, m),
        pd AS (SELECT d.domain, d.n AS pn, d.k AS pk, (ps.pk - d.k + ps.pm * ps.pw) / (ps.pn - d.n + ps.pw) AS pm, 1 / least(m.rd + 1 / (ps.pn - d.n + ps.pw + 1), 0.9) - 1 AS pw FROM domains d JOIN ps USING (suffix), m),
        ph AS (SELECT h.host, h.n, h.k, (pk - h.k + pm * pw) / (pn - h.n + pw) AS hm, 1 / least(m.rh + 1 / (pn - h.n + pw + 1), 0.9) - 1 AS hw FROM named h JOIN pd USING (domain), m),
        ab AS (SELECT host, n, k, hw, (k + hm * hw) / (n + hw) AS mean FROM ph),
        rep AS (SELECT host, n, k, mean - 2 * sqrt(mean * (1 - mean) / (n + hw + 1)) AS bound FROM ab),
        rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (SELECT page_id, first(rhost || rpath ORDER BY length(rhost || rpath) DESC) AS rule, first(rverdict ORDER BY length(rhost || rpath) DESC) AS rverdict FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, CASE WHEN r.bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, CAST(r.n AS BIGINT) AS host_outcomes, CAST(r.k AS BIGINT) AS host_bad, round(r.bound, 6) AS bound
        FROM parsed p JOIN rep r USING (host) LEFT JOIN fits f USING (page_id)
    """,
}
