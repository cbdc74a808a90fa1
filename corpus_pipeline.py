"""From raw documents to training tokens: each stage's rows are the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadloom.llm import queries as ops
from dyadloom.llm.common import settle, table

STAGES = [
    ("toxicity", ops.keep_clean),
    ("near duplicates", ops.keep_one_of_each),
    ("personal data", ops.without_personal_data),
    ("source mix", ops.to_weights),
    ("tokens", ops.tokens),
]

#: Training, keyed surrogates and a tokenizer are beyond SQL; tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of what is left of ``documents`` after all stages, each of whose results is
    written and read again: (doc_id, ids, n_tokens, ids_sha256, decoded_sha256).

    Null ids and texts, empty texts and repeated rows pass, each as its stage says; an
    empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
