"""A training-data pipeline over documents: toxicity, line dedup, near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents. Rows are known by all their values, so
null or repeated ids are no trouble; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aidlake.llm import common, line_dedup, mixing, pieces, simhash, toxicity

#: Near-dedup: words of a shingle, differing bits of two 64-bit fingerprints that make candidates, and the Jaccard similarity that links.
SHINGLE, DISTANCE, SIMILARITY = 5, 8, 0.8


def folded(docs: DataFrame, *also: str) -> DataFrame:
    """docs as row (a struct of the other columns), text and copies of `also`: so no name of a stage meets one of docs."""
    rest = [common.by_name(c).alias(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), "text", *[common.by_name(c).alias(c) for c in also])


def unfolded(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on `labels`, scores at 0.5 or more go.

    Null and empty texts score as a window without words, repeated rows alike; whole texts are scored, however long.
    An empty table stays empty; a column called score is not touched.
    """
    net = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unfolded(toxicity.score(folded(docs), net).where("score < 0.5"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays, and n_chars follows its text.

    Null texts stay null, empty ones empty; rows with equal doc_id and text fare alike; a null doc_id comes after all
    others. Long texts cost as much as their length. Columns n_lines and n_dropped of docs stay as they were.
    """
    out = line_dedup.line_dedup(folded(docs, "doc_id"))
    back = unfolded(out, docs.columns)
    return back.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else common.by_name(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard 0.8 or more) stays: the one with the smallest id.

    Null doc_ids come last; of equal ids the smaller text hash stays, of rows that agree in both the one whose digest
    of all columns is least, so the result does not depend on the rows' order. Texts without words are copies of each
    other. An empty table stays empty; texts are compared whole.
    """
    groups = simhash.near_groups(docs.select("doc_id", "text"), "doc_id", "text", SHINGLE, DISTANCE, SIMILARITY)
    stay = common.written(groups.where("kept").select("doc_id", "text_hash").distinct(), "stay")
    rows = folded(docs, "doc_id").withColumn("text_hash", F.xxhash64("text"))
    found = rows.join(stay, rows["doc_id"].eqNullSafe(stay["doc_id"]) & (rows["text_hash"] == stay["text_hash"]), "left_semi")
    once = Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64("row"), "row")
    return unfolded(found.withColumn("place", F.row_number().over(once)).where("place = 1"), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times or not at all.

    Rows that are equal in all columns get the copies of all of them together. Texts that are null or have no words
    add none to a source; they stay by their source's ratio alone. A null source is one of its own; long texts are one
    document each; an empty table stays empty.
    """
    rows = folded(docs, "doc_id", "source").withColumn("key", F.xxhash64("row", "text"))
    slim = mixing.with_size(rows).select("doc_id", "key", "source", "size")
    copies = mixing.mix(slim).groupBy("doc_id", "key").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    copies = common.written(copies, "copies")
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("key"))).where("place = 1")
    taken = first.join(copies, first["doc_id"].eqNullSafe(copies["doc_id"]) & (first["key"] == copies["key"])).select("row", "text", "copies")
    return unfolded(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids (piece ids) and n_tokens for each document, its text decoded from them again.

    A null text has null ids and 0 tokens, an empty one none; repeats get equal ids; texts are taken whole. Columns of
    docs called ids or n_tokens are replaced. An empty table stays empty.
    """
    coded = pieces.round_trip(folded(docs), back_col="text")
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    back = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept]
    return coded.select(*back, F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash", near), ("mixing", mixed), ("pieces", tokens)]

#: A network's scores, hash-based rounding and a piece vocabulary are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else common.written(out, f"stage-{name}")
    return docs
