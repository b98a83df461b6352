"""The registered query of every operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_hits

    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85).withColumnRenamed("id", "doc_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_held_out

    return identify_held_out(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated_lines

    return deduplicated_lines(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    records = archive_pages(table(spark, sf_dir, "pages"), least_bytes=0, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import fit_licences, plain_paragraphs, scan_licences

    docs = table(spark, sf_dir, "documents")
    return scan_licences(docs, fit_licences(plain_paragraphs(docs, documents=300)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_chain, label_categories, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_chain(docs, table(spark, sf_dir, "labels"), label_categories(), "toxic"))


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import store_documents

    return store_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kmeans import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, salt="2:")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import fit, personal_data
    from .pii_table import labelled_lines

    return personal_data(table(spark, sf_dir, "documents"), fit(labelled_lines(rows=900)))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import cross_tokenizer_alignment

    return cross_tokenizer_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), links="ends")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_licence_scan": op8_licence_scan,
    "op9_toxicity": op9_toxicity,
    "op10_token_id_output": op10_token_id_output,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_pii": op12_pii,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

def _kmeans_sql(k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """Plain rounds: every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), e) - 1 AS j, e FROM v QUALIFY j < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v.e) AS e, min({{'d': list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'j': j}}) AS m FROM v, c{i} c GROUP BY r)")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT m.j AS j, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{i}),
f{i} AS (SELECT j, p, sum(x) AS s, count(*) AS n FROM s{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS e FROM f{i} GROUP BY j) n ON n.j = c.j)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.j)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.m.j"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(c) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.vec_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept FROM r LEFT JOIN k ON k.a = r.vec_id GROUP BY r.vec_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f""",
    "op11_centroid_clustering": _kmeans_sql(),
}
