"""The corpus pipeline: classify, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All
but the last return the columns of ``documents``.

Edge cases: a null text is an empty one to the classifier, links with nothing, holds no passage and no
secret and is packed as one closing id, and stays null until then; an empty text likewise; very
long texts are read whole by every stage; rows without an id stay if their text does; of rows that
repeat an id, the classifier, the decontamination and the secret scan judge each by its own text,
the Jaccard join keeps or drops all of them, and each is packed; of near copies with the same
smallest id all its rows stay; an empty table, or one that a stage empties, gives an empty result;
other columns, whatever their names, are carried along to the last stage, which leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import Workspace, table
from strandline.llm.decontaminate import clean_of
from strandline.llm.jaccard_join import deduplicated
from strandline.llm.packing import pack
from strandline.llm.quality import keep_good
from strandline.llm.queries import tokenizer_path
from strandline.llm.secrets import redact_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return clean_of(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten; every document stays."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with the sequences that they are packed into."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the classifier nor the tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), name)
        if k:
            space.drop(STAGES[k - 1][0])
    return docs
