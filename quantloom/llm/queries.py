"""The registered queries of this subpackage, by operator number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import ann_tree, bpe, centroids, filter_audit, importance, improbable, langid, lattice, mixing, simhash, substring_dedup, suffix_dedup, toxicity
from quantloom.llm.common import documents
from pyspark.sql import functions as F


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return importance.resample(documents(spark, sf_dir), labels)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return langid.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op5_lattice_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.classify(documents(spark, sf_dir), labels)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable.compare_next(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 3.0::DOUBLE AS most, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source IS NULL, encode(source)) AS n FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(most) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
         sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM f
), t AS (
  SELECT source, source_size, least(most, weight * coalesce((SELECT arg_min((total - before) / rest, most / weight) FROM l WHERE (total - before) / rest <= most / weight), 0.0)) AS target FROM l
), q AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, p.pass, (p.pass * source_size + upto)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS pass) p WHERE size > 0
), k AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS line FROM c
), n AS (
  SELECT doc_id, source, count(*) AS copies FROM k WHERE line <= (SELECT sum(size) FROM d) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n.copies, 0))::BIGINT AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.source IS NOT DISTINCT FROM n.source
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(words) - 11)) AS i)
), r AS (
  SELECT doc_id, i FROM w JOIN (SELECT h, min(doc_id) AS least FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)) m USING (h) WHERE doc_id > least
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r
), g AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT t.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, {
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS m
  FROM t LEFT JOIN l USING (doc_id)
), d AS (
  SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [m.A, m.B, m.C, m.D, m.E]) AS fails, m.A::INT + m.B::INT + m.C::INT + m.D::INT + m.E::INT AS n_fails FROM f
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(x),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(x)
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o
), g AS (
  SELECT part, good, toxic, fails, n_fails, count(*) AS n FROM d GROUP BY ALL
), c AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, n_fails, fails[filter_order[step]] AS now,
         len(list_filter(range(1, step), lambda k: fails[filter_order[k]])) > 0 AS earlier
  FROM g, s
), r AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (NOT now AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (now AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (now AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (now AND NOT earlier AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (now AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
  FROM c GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""


def clustering_sql(rounds: int) -> str:
    """The clustering with a row a component, each round from the one before."""
    text = """
WITH e AS (
  SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT id, unnest(range(1, 65)) AS j, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e
), i AS (
  SELECT id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e QUALIFY c < 8
), c0 AS MATERIALIZED (
  SELECT c::INT AS c, j, x FROM v JOIN i USING (id)
)"""
    for k in range(rounds + 1):
        text += f""", a{k} AS MATERIALIZED (
  SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} c USING (j) GROUP BY ALL) GROUP BY id
)"""
        if k < rounds:
            text += f""", c{k + 1} AS MATERIALIZED (
  SELECT c.c, c.j, coalesce(m.x, c.x) AS x
  FROM c{k} c LEFT JOIN (SELECT c, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM v JOIN a{k} USING (id) GROUP BY ALL) m USING (c, j)
)"""
    return text + f"""
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} a JOIN e USING (id) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c) h ON h.c = a.c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_tree_search": op4_tree_search,
    "op5_lattice_groups": op5_lattice_groups,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_source_mix": op8_source_mix,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_improbable_features": op13_improbable_features,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {"op8_source_mix": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_centroid_clusters": clustering_sql(10)}
