"""The registered queries: each operator with production parameters over its whole table, and the SQL where it can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary the packing contract names."""
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.packing import pack

    return pack(table(spark, folder, "documents"), tokenizer_path())


# Verdict and host/path of the rules the url contract names (fixed values).
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query("op10_redirect_equivalence", r"""
    WITH RECURSIVE p AS (
        SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
    tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p
             WHERE contains(url, '://')),
    targets AS (
        SELECT url AS source, replace(nullif(CASE
            WHEN regexp_matches(tag, '(?i)^<link\b') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?\s*canonical\b')
            THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
            WHEN regexp_matches(tag, '(?i)^<meta\b') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
            THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, ''), '&amp;', '&') AS t FROM tags),
    links AS (
        SELECT source, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
            WHEN t LIKE '//%' THEN regexp_extract(source, '^(.*?)://', 1, 's') || ':' || t
            WHEN t LIKE '/%' THEN regexp_extract(source, '^(.*?://[^/?#]*)', 1, 's') || t END AS target FROM targets),
    edges AS (SELECT source AS a, target AS b FROM links WHERE target IS NOT NULL
              UNION SELECT target, source FROM links WHERE target IS NOT NULL),
    reach AS (SELECT a AS url, a AS alias FROM edges UNION SELECT reach.url, edges.b FROM reach JOIN edges ON reach.alias = edges.a),
    rules(kind, rhost, rpath, rule) AS (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'),
        ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')),
    urls AS (
        SELECT DISTINCT url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
        FROM (SELECT url FROM p UNION SELECT alias FROM reach) WHERE url IS NOT NULL),
    own AS (
        SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS kind FROM urls
        JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url),
    far AS (SELECT reach.url, min(own.kind) AS kind FROM reach JOIN own ON own.url = reach.alias GROUP BY reach.url)
    SELECT page_id, host, path, own.rule, coalesce(own.kind, far.kind, 'allow') AS verdict
    FROM p LEFT JOIN own USING (url) LEFT JOIN far USING (url)""")
def redirect_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.url_filter import filter_urls

    return filter_urls(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


TOXIC_AT, QUALITY_AT = 0.7, 0.3


def _judged(scores: DataFrame, modulus: int, remainder: int, at: float) -> DataFrame:
    from veldspar.llm.tables import learnable

    return scores.select("doc_id", learnable("doc_id", modulus, remainder)[0].alias("held_out"), "score",
                         (F.col("score") >= at).cast("int").alias("predicted"))


@query("op3_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm import toxicity as op
    from veldspar.llm.tables import learnable

    docs = table(spark, folder, "documents")
    machine = op.fit(docs, table(spark, folder, "labels"), learnable("doc_id", 3, 1)[1])
    return _judged(op.score(docs, machine), 3, 1, TOXIC_AT)


@query("op5_factorisation_machine")
def factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm import quality as op
    from veldspar.llm.tables import learnable

    docs = table(spark, folder, "documents")
    machine = op.fit(docs, table(spark, folder, "labels"), learnable("doc_id", 5, 0)[1])
    return _judged(op.score(docs, machine), 5, 0, QUALITY_AT)


@query("op9_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm import language_id as op
    from veldspar.llm.tables import learnable

    docs = table(spark, folder, "documents")
    held_out, learn_from = learnable("doc_id", 4, 2)
    model = op.learn(docs.filter(learn_from))
    return op.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_pivot_top_k", """
    WITH v AS (
        SELECT row_number() OVER () AS key, vec_id,
               list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.key, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND len(q.vec) = len(c.vec) AND q.key <> c.key),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.topk import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


@query("op2_decontamination", r"""
    WITH d AS (
        SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
        SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + 9], ' ') AS needle
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT m FROM bw),
    dw AS (
        SELECT key, m, s, array_to_string(w[s:s + m - 1], ' ') AS needle
        FROM (SELECT key, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d JOIN sizes ON len(w) >= m)),
    h AS (SELECT key, item_id, m, s FROM dw JOIN bw USING (m, needle)),
    words AS (SELECT key, count(DISTINCT i) AS n_hit FROM (SELECT key, unnest(generate_series(s, s + m - 1)) AS i FROM h) GROUP BY key),
    items AS (SELECT key, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM h GROUP BY key)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (key) LEFT JOIN items USING (key)""")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.ngram_join import jaccard_groups

    return jaccard_groups(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@query("op8_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.line_dedup import PER_EDIT, line_classes

    found = line_classes(table(spark, folder, "documents"), per_edit=PER_EDIT, short=True)
    return found.select("doc_id", "n_lines", F.size("repeats").alias("n_removed"), "n_links", "repeats")


@query("op7_repeated_passages")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, folder, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# The given pages mark their article, so SQL can say what the labeller has to find there.
@query("op11_recurrent_labeller", r"""
    WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)(?:</article>|$)', 1, 's') AS x FROM pages),
    b AS (SELECT page_id, url, regexp_split_to_array(coalesce(x, ''), '</?(?:p|h1)>') AS parts FROM a),
    t AS (SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
              p, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b),
    j AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda p: p <> ''), chr(10)), '') AS text FROM t)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j""")
def recurrent_labeller(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.html_extract import extract, fit

    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op12_threshold_negatives", """
    WITH v AS (
        SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.key, a.vec_id AS anchor_id, c.key AS c_key, c.vec_id, a.label = c.label AS same,
               CAST(list_sum(list_transform(list_zip(a.vec, c.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id % 100 = 0 AND len(a.vec) = len(c.vec) AND a.key <> c.key),
    p AS (SELECT key, anchor_id, c_key AS p_key, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id NULLS LAST, c_key) <= 5),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.key, p.p_key ORDER BY s.score DESC, s.vec_id NULLS LAST, s.c_key) AS rank
          FROM p JOIN s ON p.key = s.key AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def threshold_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.hard_negatives import hard_negatives

    vectors = table(spark, folder, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("id") % 100 == 0)


def _rounds_sql(rounds: int) -> str:
    """Centroids and assignments of each round as one chain of tables."""
    out = []
    for n in range(rounds + 1):
        out.append(f"""d{n} AS (SELECT v.key, c.cluster, CAST(list_sum(list_transform(list_zip(v.vec, c.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
            FROM v, c{n} c),
        a{n} AS (SELECT key, min(cluster) AS cluster, distance FROM d{n} WHERE (key, distance) IN (SELECT key, min(distance) FROM d{n} GROUP BY key) GROUP BY key, distance)""")
        if n < rounds:
            out.append(f"""s{n} AS (SELECT cluster, i, sum(x) AS total, count(*) AS n FROM (
                SELECT a.cluster, unnest(v.vec) AS x, unnest(range(64)) AS i FROM a{n} a JOIN v USING (key)) GROUP BY cluster, i),
            m{n} AS (SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS vec FROM s{n} GROUP BY cluster),
            c{n + 1} AS (SELECT c.cluster, coalesce(m.vec, c.vec) AS vec FROM c{n} c LEFT JOIN m{n} m USING (cluster))""")
    return ",\n".join(out)


@query("op13_orchard_clusters", f"""
    WITH v AS (
        SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec) - 1 AS cluster, vec FROM v
           QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec) <= 16),
    {_rounds_sql(3)},
    t AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY cluster)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM t) AS BIGINT) AS inertia,
           sha256(array_to_string(c.vec, ',')) AS centroid_sha256
    FROM a3 JOIN v USING (key) JOIN t USING (cluster) JOIN c3 c USING (cluster)""")
def orchard_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from veldspar.llm.clustering import cluster

    return cluster(table(spark, folder, "embeddings"))[0]
