"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.llm import decontamination, jaccard_join, language_id, lm_scoring, mixing, quality_classifier, quality_rules, sharding, substring_dedup, token_counts
from stratum.llm.common import table


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, quality_classifier.grades(table(spark, sf_dir, "labels")), 3)
    return quality_classifier.score(docs, model)


def op3_substring_dedup(spark, sf_dir):
    out = substring_dedup.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"), words=3, least=90)


def op5_quality_rules(spark, sf_dir):
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_classifier, op3_substring_dedup, op4_jaccard_join, op5_quality_rules, op6_lm_scoring, op7_language_id, op8_sharding, op9_decontamination, op10_mixing)}
ORACLE_SQL = {"op3_substring_dedup": substring_dedup.SQL, "op4_jaccard_join": jaccard_join.SQL, "op9_decontamination": decontamination.SQL}
