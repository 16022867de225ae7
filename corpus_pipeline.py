"""From raw documents to token ids: rules, line dedup, near-dedup, mixing, encoding.

Each stage reads the table that the one before wrote and gives back the columns of documents (others are
dropped, for documents has no others); the last gives a row for each document of the mixture with its token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import bpe, line_dedup, mixing, near_copies, quality
from tonearm.llm.common import WORD, remove_folder, scope, written
from tonearm.llm.queries import BYTE_BPE, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What stages that were called by hand have left in the shared folder: by sf_dir, each path with its stage's place.
_LEFT: dict[str, list[tuple[int, str]]] = {}


def stage(place: int) -> Callable:
    """A stage that first removes what earlier stages of the same sf_dir left in the shared folder.

    Stages that are called in turn are one chain: when a later one starts, the results of those before are written, so
    nothing reads what they left. Where docs still does, for it wasn't written, all of it stays. A stage removes nothing of its own kind, so it may be called
    for several documents at once. run() has its own folders and doesn't come here.
    """

    def of(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(work)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            left = _LEFT.setdefault(sf_dir, [])
            read = docs.inputFiles() if left else []
            lazy = any(path.rsplit("/", 1)[-1] in f for _, path in left for f in read)  # docs wasn't written
            for entry in [] if lazy else [x for x in left if x[0] < place]:
                remove_folder(entry[1])
                left.remove(entry)
            with scope() as own:
                out = work(spark, docs, sf_dir)
            left += [(place, path) for path in own]
            return out

        return run_stage

    return of


@stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the outlier test reject. Equal rows are judged alike."""
    return quality.kept_documents(docs.select(*COLUMNS))


@stage(1)
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops blocks of lines that an earlier document has; a document of which no word is left goes."""
    kept = line_dedup.drop_shared_lines(docs.select(*COLUMNS)).where(F.col("text").rlike(WORD) | (F.col("n_removed") == 0))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


@stage(2)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: 5-word shingles, Jaccard similarity of 0.8 or more.

    It is the row with the least doc_id, null ids last; rows with that id are told apart by text hash, then by
    their other columns, and of equal rows one stays. Rows without ids are compared like all others.
    """
    return near_copies.one_of_each(docs.select(*COLUMNS), "lang", "source", "n_chars")


@stage(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents as often, and as much of the last one, as their source's target says."""
    mixed = mixing.mixed_texts(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


@stage(4)
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document."""
    return bpe.encode_texts(docs.select("doc_id", "text", "lang", "source"), tokenizer(BYTE_BPE)).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe encoding", encode),
]

#: Robust estimates, fingerprints and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next.

    What a stage left there besides its result is removed when the result is written.
    """
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        with scope() as own:
            docs = stage.__wrapped__(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = written(docs, "stage")
        if k + 1 < len(STAGES):
            for path in [*own[:-1], *held]:  # the last one is the stage's table, held the one that it read
                remove_folder(path)
            held = own[-1:]
    return docs
