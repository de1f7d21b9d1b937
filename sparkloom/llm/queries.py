"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from . import centroids, decontamination, jaccard_join, language_id, pii, prefix_trie, quality_gam, quality_rules, repeats, toxicity, url_filter
from .byte_bpe import round_trip
from .common import table
from .token_counts import count_tokens


def op1_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op5_decontamination(spark, sf_dir):
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_quality_gam(spark, sf_dir):
    return quality_gam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark, sf_dir):
    nodes = prefix_trie.nodes(table(spark, sf_dir, "conversations"))
    return nodes.withColumn("ends_sha256", F.lower(F.hex("ends"))).drop("ends")


def op12_centroid_clustering(spark, sf_dir):
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_suffix_dedup(spark, sf_dir):
    cut = repeats.cut(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return cut.select("doc_id", "n_bytes", removed, F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_token_counts, op3_pii, op4_language_id, op5_decontamination, op6_url_filter, op7_toxicity, op8_ngram_jaccard_join, op9_quality_gam, op10_quality_rules, op11_prefix_trie, op12_centroid_clustering, op13_suffix_dedup, pipeline)
}

def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    """Chained rounds of assignments and means, in integers."""
    apart = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    nearest = f"SELECT v.row, arg_min(c.j, {apart} * {k} + c.j) AS j, min({apart}) AS d FROM v, c{{n}} c GROUP BY v.row"
    good = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {good})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('1:', CAST(vec_id AS STRING)))) - 1 AS j, q FROM v ORDER BY j LIMIT {k})",
    ]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({nearest.format(n=n)})")
        parts.append(f"m{n} AS (SELECT j, list(x ORDER BY i) AS q FROM (SELECT j, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a.j, generate_subscripts(v.q, 1) AS i, unnest(v.q) AS x FROM a{n} a JOIN v ON v.row = a.row) GROUP BY j, i) GROUP BY j)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m ON m.j = c.j)")
    parts.append(f"f AS ({nearest.format(n=rounds)})")
    return f"""WITH {", ".join(parts)} SELECT v.vec_id, CAST(f.j AS INTEGER) AS cluster, f.d AS distance, CAST(sum(f.d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM f JOIN v ON v.row = f.row JOIN c{rounds} c ON c.j = f.j"""


ORACLE_SQL: dict[str, str] = {"op12_centroid_clustering": _op12_sql()}
