"""The training corpus: from documents to token files, one written table per stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.llm.decontamination import uncontaminated
from harrier.llm.jaccard_join import jaccard_components
from harrier.llm.mixing import mix_sources
from harrier.llm.quality import keep_good, train_quality
from harrier.llm.shared import Scratch
from harrier.llm.token_files import read_tokens, write_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects. Every row is judged by its own text, also one without an id or
    with another's; a null or empty text goes. It learns from the labels of documents that are still there."""
    model, scale = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs.select(COLUMNS), model, scale)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keep the document of least id. Rows of one id are one document: its row of least
    text stays. A document without id is in no group and stays, and so does one without words."""
    first = jaccard_components(spark, docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = docs.select(COLUMNS).join(first, "doc_id")
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(F.col("_rows") > 1, F.col("text")).asc_nulls_first()))
    kept = kept.withColumn("_row", row).where("_row = 1").select(COLUMNS)
    return kept.unionByName(docs.where("doc_id IS NULL").select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, or nearly. Every row is judged by its own text; one without text holds
    nothing and stays."""
    return uncontaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources, each source once at least and none more than twice. A null source is a source;
    documents without id or text are read as others are."""
    return mix_sources(spark, docs, keep=("text", "lang", "n_chars")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files in ascending id order, documents without id first; return what they hold, by document."""
    path = f"{Scratch(spark, 'corpus').path}/tokens"
    write_tokens(spark, docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: The classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)  # a stage's table is read by the next one only
        scratch.free()
    return STAGES[-1][1](spark, docs, sf_dir)
