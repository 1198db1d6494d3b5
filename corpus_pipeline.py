"""A training corpus from raw documents, in five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The first four return
documents' columns; the last adds what the mix takes of each document.

Operators decide about rows, by a key that a stage gives to each (ROW): ids may be null or repeated. A null id
comes after all others where the smallest one stays. The copy that holds the keys is deleted when a later stage
makes its own, so a stage's result is to be written before a stage is called on another table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, exact_dedup, langid, mixing, ngram_join
from weft.llm.common import delete, materialize, release, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "row_key"

#: Folders of the keyed copies that stages have made and not yet deleted.
_copies: set[str] = set()


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def _forget(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the keyed copies of earlier stages, but for those that docs still reads."""
    unread = _copies - _folders(docs) if _copies else set()
    for path in unread:
        delete(spark, path)
    _copies.difference_update(unread)
    release(spark)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of their own for each row, saved, as a recomputation could change it."""
    _forget(docs.sparkSession, docs)
    copy = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), "keyed")
    _copies.update(_folders(copy))
    return copy


def _firsts(docs: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Of each group the row with the smallest id; of equal ids that with the first text, of equal rows one."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.sha2("text", 256).alias("digest"), ROW)
    return docs.select(ROW, order.alias("place")).join(groups.select(ROW, group), ROW).groupBy(group).agg(F.min("place").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))


def _one_of_each(docs: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """The rows of _firsts, joined when the operator's own shuffles are gone. Both sides grow with the input: no broadcast."""
    firsts = materialize(_firsts(docs, groups, group), "firsts")
    release(docs.sparkSession)
    return docs.join(firsts.hint("merge"), ROW, "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language: null texts and texts without letters.

    The model learns from the labelled rows outside of the held-out fold; what it predicts is not a reason to
    drop a document, as every language it knows is wanted.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model).where(f"lang_pred <> '{langid.UNDETERMINED}'").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the smallest id; of repeated rows one."""
    docs = _keyed(docs)
    groups = exact_dedup.exact_dedup(docs, row_id=ROW)
    return _one_of_each(docs, groups, "keep_id")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 keep the one with the smallest id."""
    docs = _keyed(docs)
    groups = ngram_join.jaccard_components(docs, row_id=ROW, n=5, percent=80)
    return _one_of_each(docs, groups, "component_id")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    docs = _keyed(docs)
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), row_id=ROW).select(ROW).distinct()
    return docs.join(hits, ROW, "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with their words, the words taken and the epochs; those that it doesn't take go.

    The order is by MD5 of the id, as in mixing.mix; rows of equal id go by words and then by text.
    """
    docs = _keyed(docs)
    words = F.lpad(mixing.word_count("text").cast("string"), 12, "0")
    order = F.concat(F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), words, F.sha2(F.coalesce("text", F.lit("")), 256))
    taken = mixing.mix(docs, row_id=ROW, key=order).where("taken > 0").select(ROW, "size", "source_size", "target", "taken", "epochs")
    return docs.join(taken, ROW).select(*COLUMNS, "size", "source_size", "target", "taken", "epochs")


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminated), ("mix", mixed)]

#: SQL can't express the language model, nor the alignment; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        _forget(spark, docs)
    return docs
