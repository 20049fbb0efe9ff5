"""From raw documents to token ids: toxicity, language, near duplicates, benchmark passages, byte-level BPE.

Every stage takes all that the one before kept and returns the columns of ``documents``; only the last
returns ids. Each result is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import bpe, langid, prefix_tree, tiling, toxicity
from sentrylake.llm.common import pick, table
from sentrylake.session import materialize


def _where(docs: DataFrame, keep) -> DataFrame:
    """Rows for which ``keep`` of the text column holds; extra columns may have any names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.where(keep(F.col(f"c{docs.columns.index('text')}"))).toDF(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; null and empty texts stay."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return _where(docs, lambda text: toxicity.score(model, text) < toxicity.REJECT)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of a language; null texts and those without a letter go."""
    known = pick(docs, doc_id="doc_id", text="text", lang="lang").where(~toxicity.held_out(F.col("doc_id"), 4, 2))
    model = langid.fit(known)
    return _where(docs, lambda text: ~langid.predict(model, text)["rejected"])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their word n-grams the one with the smallest id."""
    return prefix_tree.one_of_each(docs, materialize(prefix_tree.alike_documents(docs), "alike"))


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which tiles cover no benchmark item."""
    return tiling.without_contaminated(docs, materialize(tiling.contaminated(docs, table(spark, sf_dir, "benchmark")), "contaminated"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return back.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", not_toxic),
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", not_contaminated),
    ("byte_bpe", token_ids),
]

#: Models, tilings and token ids can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
