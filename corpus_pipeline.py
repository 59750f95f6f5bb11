"""From raw documents to training sequences: five stages, each over all that the one before it kept.

Quality classifier, MinHash near-dedup, substring dedup, benchmark decontamination, packing. All stages but the last
return the columns of documents, whatever their names; run() gives the pieces of packed sequences. Repeated ids and null
ids are rows of their own, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline import ship
from fathomline.llm import decontamination, minhash, packing, quality, substrings
from fathomline.llm.common import numbered, saved, sized, table


def _rows(docs: DataFrame) -> DataFrame:
    """docs with `own_` before the names of its columns, and a column `row` that tells rows apart whatever their ids."""
    return numbered(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns}), "own_doc_id")[0]


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), F.col("own_text").cast("string").alias("text"))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"`own_{c}`").alias(c) for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, as they are, columns with the classifier's own names included."""
    ship(spark)
    aside = {c: f"own_{c}" for c in docs.columns if c in quality.NAMES}
    kept = quality.classify(docs.withColumnsRenamed(aside)).where("quality_keep").drop(*quality.NAMES)
    return kept.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies: five words a shingle, similarity 0.8 or more.

    Rows with one id or none are documents of their own; texts without words are copies of nothing and stay.
    """
    ship(spark)
    rows = _rows(docs)
    gone = saved(minhash.near_duplicates(_texts(rows), shingle=5, num=80, den=100).where("not kept").select(F.col("doc_id").alias("row")))
    return _back(rows.join(sized(gone), "row", "left_anti"), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that windows of 35 repeated words cover; a document that keeps none of its words goes.

    A text that loses nothing stays as it is (null and empty ones too); of others the words left are joined by one space.
    """
    ship(spark)
    rows = _rows(docs)
    left = substrings.kept_by_row(_texts(rows).withColumnRenamed("doc_id", "row")).where("n_removed > 0").select("row", F.col("kept").alias("left_text"))
    changed = F.col("left_text").isNotNull()
    new = {"own_text": F.col("left_text"), "own_n_chars": F.length("left_text").cast("long")}
    out = rows.join(left, "row", "left").where(~changed | (F.col("left_text") != ""))
    return _back(out.withColumns({c: F.when(changed, new[c]).otherwise(F.col(c)) for c in new if c in rows.columns}), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item; rows with one id or none are judged each by its own text."""
    ship(spark)
    rows = _rows(docs)
    found = saved(decontamination.contaminated(_texts(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct())
    return _back(rows.join(sized(found), "row", "left_anti"), docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences that the documents are packed into; a null text is an empty document."""
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("substrings", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", into_sequences),
]

#: SQL cannot express training, minima of hashes or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
