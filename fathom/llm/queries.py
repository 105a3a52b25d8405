"""Queries opN_<name> over the whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import centroids, jaccard, linededup, merkle
from fathom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), seq_len=4096, end_id=2, with_ids=False).drop("doc_ids")


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.tokenio import export_tokens, read_documents

    folder, manifest = export_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_documents(spark, folder, manifest)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.substrings import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.mtree import every, top_k

    return top_k(table(spark, sf_dir, "embeddings"), every(100), k=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.linededup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.hnsw import nearest
    from fathom.llm.mtree import every

    return nearest(table(spark, sf_dir, "embeddings"), every(100), k=10)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.verified(merkle.manifest(docs, merkle.tampered(docs)))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.pii import counted, find

    return counted(find(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_exact_topk, op4_toxicity, op5_line_dedup, op6_ngram_jaccard, op7_hnsw, op8_token_binary, op9_token_counts, op10_mixing, op11_merkle, op12_centroids, op13_pii)}
ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": linededup.ORACLE_SQL,
    "op6_ngram_jaccard": jaccard.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_centroids": centroids.ORACLE_SQL,
    "op3_exact_topk": """
        WITH ok AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM ok q JOIN ok c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10""",
}
