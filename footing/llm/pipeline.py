"""From raw documents to packed training sequences, in stages that each read their predecessor's table.

Every stage but the last returns the columns of ``documents``; its decisions take effect by
leaving rows out.  Rows with null texts or ids, empty texts and repeated rows go through as
each operator's own text says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footing.llm import decontamination, jaccard, packing, quality, toxicity
from footing.llm.common import durable, release, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or repeats itself too much."""
    return quality.measure_quality(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the scorer, learned from the labelled rows still here, takes for toxic."""
    scorer = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, scorer, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what holds a benchmark item, up to the allowed edits."""
    return decontamination.without_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all that is left in sequences of at most 2048 tokens."""
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_filter),
    ("packing", pack),
]

#: The stages rest on suffix arrays, a trained scorer and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's own tables are deleted once its result is written, and its input with them."""
    docs = table(spark, sf_dir, "documents")
    first = written()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        release(first, written() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
