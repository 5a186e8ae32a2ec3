"""The registered queries of this package, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueline.llm.chat import CHAT_SQL, chat_digest
from cueline.llm.decontamination import contaminations
from cueline.llm.divergence import DIVERGENCE_SQL, divergence
from cueline.llm.exact import EXACT_SQL, exact_groups
from cueline.llm.katz import katz_scores
from cueline.llm.mixing import mix_documents
from cueline.llm.prefixes import PREFIX_SQL, conversation_prefixes
from cueline.llm.quality import quality
from cueline.llm.repeats import repeated_passages
from cueline.llm.sharding import shard_documents
from cueline.llm.simhash import simhash_components
from cueline.llm.tokens import document_tokens
from cueline.llm.toxicity import toxicity


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": _over(toxicity, "documents", "labels"),
    "op2_decontamination": _over(contaminations, "documents", "benchmark"),
    "op3_mixing": _over(mix_documents, "documents"),
    "op4_repeated_passages": _over(repeated_passages, "documents"),
    "op5_exact_dedup": _over(exact_groups, "documents"),
    "op6_chat_format": _over(chat_digest, "conversations"),
    "op7_sharding": _over(shard_documents, "documents"),
    "op8_simhash": _over(simhash_components, "documents"),
    "op9_katz_scores": _over(katz_scores, "documents"),
    "op10_token_counts": _over(document_tokens, "documents"),
    "op11_source_divergence": _over(divergence, "documents"),
    "op12_quality": _over(quality, "documents", "labels"),
    "op13_conversation_prefixes": _over(conversation_prefixes, "conversations"),
}

ORACLE: dict[str, str] = {"op5_exact_dedup": EXACT_SQL, "op6_chat_format": CHAT_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op13_conversation_prefixes": PREFIX_SQL}
