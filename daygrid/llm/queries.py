"""The registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from daygrid.llm import balance, centroids, decontaminate, forest, jaccard, personal, pieces, quality, secret_scan, simhash, tokens, whitening, wrappers
from daygrid.llm.common import table

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_shard_balance(spark, sf_dir):
    return balance.shard_documents(table(spark, sf_dir, "documents"))


def op2_wrapper_extraction(spark, sf_dir):
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_hash_prefix_forest(spark, sf_dir):
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op9_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op10_personal_data(spark, sf_dir):
    return personal.digest(personal.find_personal(table(spark, sf_dir, "documents")))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_simhash_components(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_shard_balance,
        op2_wrapper_extraction,
        op3_decontamination,
        op4_hash_prefix_forest,
        op5_jaccard_join,
        op6_secret_scan,
        op7_quality_classifier,
        op8_sentencepiece,
        op9_token_counts,
        op10_personal_data,
        op11_embedding_whitening,
        op12_simhash_components,
        op13_centroid_clusters,
    )
}
LLM_QUERIES["pipeline"] = corpus_pipeline.run
LLM_ORACLES = {
    "op3_decontamination": decontaminate.contaminated_sql(),
    "op5_jaccard_join": jaccard.components_sql(),
    "op13_centroid_clusters": centroids.cluster_sql(),
}
