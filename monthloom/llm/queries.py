"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hamming, licenses, lm, media, minhash, mixing, packing, tokens, toxicity, urls
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary()).withColumn("over_limit", F.col("n_tokens") > 512)


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search(table(spark, sf_dir, "embeddings"), k=10, bits=64, query_every=100)


def op3_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), minhash.Rule(words=3, percent=85))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels pages, so a page's outcome is bad where its html names a trade of urls.VICES."""
    return urls.judge(table(spark, sf_dir, "pages"), bad=urls.names_a_vice(F.col("html")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_media(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.trained_and_scored(table(spark, sf_dir, "documents"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), details=True)


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (op1_token_counts, op2_hamming_topk, op3_minhash_groups, op4_url_reputation, op5_toxicity, op6_media_chunks, op7_kneser_ney, op8_poisson_mix, op9_hilbert_packing, op10_license_scan)
    return {f.__name__: f for f in own}


OP2_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings
  WHERE len(embedding) = 64 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
), p AS (
  SELECT q.id AS query_id, r.id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM c q JOIN c r ON q.id <> r.id WHERE q.id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 10
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
  FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM sh),
df AS (SELECT g, count(*) AS n FROM e GROUP BY g HAVING count(*) > 1),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM (SELECT * FROM e SEMI JOIN df USING (g)) a JOIN (SELECT * FROM e SEMI JOIN df USING (g)) b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), l AS (
  SELECT c.a, c.b FROM c JOIN sh x ON x.doc_id = c.a JOIN sh y ON y.doc_id = c.b
  WHERE 100 * c.i >= 85 * (len(x.s) + len(y.s) - c.i)
), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(id, to_id) AS (
  SELECT doc_id, doc_id FROM sh
  UNION
  SELECT r.id, t.b FROM reach r JOIN both_ways t ON t.a = r.to_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sh s JOIN (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id) m ON m.id = s.doc_id
"""


def _level(children: str, rate: str) -> str:
    """Prior strength from the spread of children about their parents' rate."""
    p = f"least(greatest({rate}, 1e-6), 1 - 1e-6)"
    rho = f"""least(greatest(coalesce((sum(n * pow(bad / n - {p}, 2) / ({p} * (1 - {p}))) - count(*)) / nullif(sum(n) - count(*), 0), 0), 0.001), 0.999)"""
    return f"(SELECT (1 - {rho}) / {rho} FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad, {rate} FROM {children} WHERE n > 0))"


OP4_SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         CAST(regexp_matches(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({"|".join(urls.VICES)})($|[^a-z0-9])') AS INTEGER) AS bad
  FROM pages
), a AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, bad
  FROM r
), b AS (
  SELECT *, string_split(host, '.') AS ls,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)}) THEN 2 ELSE 1 END AS k,
         regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') OR starts_with(host, '[') AS address
  FROM a
), placed AS (
  SELECT page_id, host, path, bad,
         CASE WHEN address OR len(ls) <= k THEN host ELSE array_to_string(ls[-k:], '.') END AS suffix,
         CASE WHEN address OR len(ls) <= k + 1 THEN host ELSE array_to_string(ls[-(k + 1):], '.') END AS domain
  FROM b
), hosts AS (
  SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM placed GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s0 AS (SELECT *, (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(n), 0), 0) FROM suffixes) AS p0 FROM suffixes),
l1 AS (SELECT suffix, (bad + s * p0) / (n + s) AS p1 FROM (SELECT *, {_level("s0", "p0")} AS s FROM s0)),
d0 AS (SELECT domains.*, p1 FROM domains JOIN l1 USING (suffix)),
l2 AS (SELECT domain, suffix, (bad + s * p1) / (n + s) AS p2 FROM (SELECT *, {_level("d0", "p1")} AS s FROM d0)),
h0 AS (SELECT hosts.*, p2 FROM hosts JOIN l2 USING (domain, suffix)),
l3 AS (SELECT host, (bad + s * p2) / (n + s) AS bad_rate, n + s AS m FROM (SELECT *, {_level("h0", "p2")} AS s FROM h0)),
j AS (
  SELECT page_id, placed.host, path, bad_rate,
         CASE WHEN (placed.host = 'example.net' OR ends_with(placed.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (placed.host = 'example.com' OR ends_with(placed.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (placed.host = 'org' OR ends_with(placed.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (placed.host = 'net' OR ends_with(placed.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
         bad_rate - 1.645 * sqrt(bad_rate * (1 - bad_rate) / (m + 1)) AS lower_bound
  FROM placed JOIN l3 USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
            WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(bad_rate, 6) AS bad_rate
FROM j
"""

OP8_SQL = """
WITH s AS (
  SELECT source, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY source
), r AS (
  SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE CAST(1 AS DOUBLE) / (SELECT count(*) FROM s WHERE chars > 0) * (SELECT sum(chars) FROM s) / chars END AS rate FROM s
), t AS (
  SELECT source, rate, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(CAST(k AS DOUBLE)) END) OVER (PARTITION BY source ORDER BY k) AS log_p
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM r)
), p AS (
  SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t
), st AS (SELECT source, list(cdf ORDER BY k) AS steps FROM p GROUP BY source),
n AS (
  SELECT d.*, r.rate, len(list_filter(st.steps, lambda c: c <= CAST(('0x' || substr(md5('mix:n:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS copies
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN st ON d.source IS NOT DISTINCT FROM st.source
), x AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, CAST(copies AS INTEGER) AS copies, round(rate, 6) AS rate,
       md5('mix:o:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)) AS position_key
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_hamming_topk": OP2_SQL, "op3_minhash_groups": OP3_SQL, "op4_url_reputation": OP4_SQL, "op8_poisson_mix": OP8_SQL}
