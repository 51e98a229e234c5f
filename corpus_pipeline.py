"""Training corpus pipeline: toxic documents out, one of each near-duplicate group, no benchmark items, sources mixed, token ids.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from logweave.llm.common import stored
from logweave.llm.decontaminate import without_leaks
from logweave.llm.mixing import repeat_documents
from logweave.llm.queries import byte_bpe_50k
from logweave.llm.registry import table
from logweave.llm.simhash import keep_one
from logweave.llm.token_files import token_output
from logweave.llm.toxicity import keep_clean


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on their labels, does not reject."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document with the smallest doc_id."""
    return keep_one(docs, shingle=3, distance=3)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other numbers, units and names."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target asks for."""
    return repeat_documents(docs, weights=(5, 2, 1), share=1.5, seed=7)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32 per document."""
    return token_output(docs, byte_bpe_50k(), end_id=2)


STAGES = [
    ("toxicity", clean),
    ("near_dedup", distinct),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", tokens),
]

# The model, the fingerprints and the tokenizer have no SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
