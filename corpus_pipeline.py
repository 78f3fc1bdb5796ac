"""Preparation of a training corpus: five stages, each on all that the one before kept.

Every stage but the last returns the columns of its input. Rows are dropped by
their own text or by doc_id; a row without a doc_id is never dropped for being
near another, and of rows that are alike in doc_id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.decontamination import without_leaks
from tarn.llm.exact_dedup import WHITE, exact_dedup
from tarn.llm.jaccard_join import jaccard_components
from tarn.llm.language_id import learn, recognised
from tarn.llm.queries import documents, vocabulary
from tarn.llm.sentencepiece_codec import encode
from tarn.llm.shared import Scratch

#: Ids (8 bytes each) that are broadcast at most.
BROADCAST_IDS = 4_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or without text (null or empty), go, as do all where nothing can be learned.

    Repeated rows are judged each; a very long text is judged whole; an empty table gives none.
    """
    return recognised(docs, learn(docs))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose doc_id isn't in ``gone`` (one column of ids, no nulls). Up to BROADCAST_IDS ids are sent to the documents; more are joined by a shuffle."""
    name = fresh(docs, "gone_id")
    gone = scratch.table(gone.distinct().toDF(name), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id.

    Null texts are equal to empty ones; of rows alike in doc_id and text one stays; rows that share a doc_id, or have none, are told apart by their texts; an empty table gives none.
    """
    scratch = Scratch(spark, "equal")
    rows = scratch.table(exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "rows")
    by_id = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept"))
    several = by_id.where("n > 1 OR doc_id IS NULL").select("doc_id")
    gone = by_id.where("n = 1 AND NOT kept AND doc_id IS NOT NULL").select("doc_id")
    if not several.limit(1).count():
        return without(docs, gone, scratch)
    # ids that stand for several rows, or none: these rows are told apart by their texts
    clear = without(docs, gone.unionByName(several.where("doc_id IS NOT NULL")), scratch).where("doc_id IS NOT NULL")
    id_, sha, own = (fresh(docs, x) for x in ("kept_id", "kept_sha", "own_sha"))
    kept = rows.where("kept").join(several, "doc_id", "left_semi").unionByName(rows.where("kept AND doc_id IS NULL")).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    bare = F.sha2(F.translate(F.coalesce("text", F.lit("")), WHITE, ""), 256)
    same = F.col(own).eqNullSafe(F.col(sha)) & F.col("doc_id").eqNullSafe(F.col(id_))
    longest = Window.partitionBy("doc_id", own).orderBy(F.desc(F.char_length("text")), "text")
    place = fresh(docs, "place")
    unclear = docs.withColumn(own, bare).join(kept, same, "left_semi").withColumn(place, F.row_number().over(longest)).where(F.col(place) == 1).drop(own, place)
    return clear.unionByName(unclear)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the smallest doc_id.

    Texts without words (null ones too) are near nothing; rows without a doc_id stay; a very long text is one set of shingles; an empty table gives none.
    """
    return without(docs, jaccard_components(docs).where("doc_id != component_id").select("doc_id"), Scratch(spark, "near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Null texts hold none and null items are no passage; repeated rows are judged each; very long texts are searched whole; an empty table gives none, an empty benchmark leaves all.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded and ids of every document.

    Null texts count as empty: no ids. Repeated rows are encoded each; giant texts in chunks; an empty table gives none.
    """
    return encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language identification and the model's encoding have no SQL form (tested against a plain version of all five stages).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written and read again."""
    scratch = Scratch(spark, "corpus")
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
