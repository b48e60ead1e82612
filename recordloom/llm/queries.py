"""One query for each operator, over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, jaccard_join, license_scan, quality, secret_scan, sharding, topk_search, toxicity, url_filter
from .common import prepared, spread, table

#: Rules of op2: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_files() -> tuple[str, str]:
    """Path and split pattern of the tokenizer that op10 is asked for."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(prepared(spark), sf_dir, "embeddings")
    return topk_search.top_k(v, v.where("vec_id % 50 = 0"), k=5, scale=256)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = prepared(spark).createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(prepared(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(spread(docs), quality.train(docs, labels), threshold=0.5)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(spread(table(prepared(spark), sf_dir, "documents"))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(spread(table(prepared(spark), sf_dir, "documents"))))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(prepared(spark), sf_dir, "documents"), shards=8)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(prepared(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(spread(docs), toxicity.train(docs, labels), threshold=0.7)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.scan(spread(table(prepared(spark), sf_dir, "documents")), table(spark, sf_dir, "benchmark"), window=10))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(jaccard_join.join(spread(table(prepared(spark), sf_dir, "documents"))))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_files()
    return bpe.digest(bpe.round_trip(spread(table(prepared(spark), sf_dir, "documents")), path, pattern))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, len(embedding) AS d FROM embeddings
                       WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
                       FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND q.d = v.d),
                 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
            SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
        "op2_url_filter": rf"""
            WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                              coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
                 r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
            SELECT page_id, host, path, (SELECT max_by(h || p, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) AS rule,
                   coalesce((SELECT max_by(verdict, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)), 'allow') AS verdict
            FROM p""",
        "op8_decontamination": rf"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
                 i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
                 win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
                         FROM i, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(k) WHERE len(w) > 0),
                 sizes AS (SELECT DISTINCT n FROM win),
                 g AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(k) WHERE len(w) >= n),
                 hit AS (SELECT r, g.n, k, item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
                 pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(k, k + n - 1)) AS t(p) GROUP BY r),
                 ids AS (SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)""",
        "op9_jaccard_join": rf"""
            WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
                 s AS (SELECT DISTINCT r, array_to_string(w[k : k + 4], ' ') AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) AS t(k) WHERE len(w) > 0),
                 n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
                 pair AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
                 link AS (SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
                 reach(r, other) AS (SELECT r, r FROM d UNION SELECT reach.r, b FROM reach JOIN link ON a = other),
                 l AS (SELECT a, count(*) AS n FROM link GROUP BY a)
            SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(any_value(l.n), 0) AS n_links, min(o.doc_id) AS component_id
            FROM d JOIN reach ON d.r = reach.r JOIN d o ON o.r = reach.other LEFT JOIN n ON n.r = d.r LEFT JOIN l ON l.a = d.r GROUP BY d.r, d.doc_id""",
    }
