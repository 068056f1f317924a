"""Texts: TF-IDF, and help requests with places from a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHONE = r"(\+?\d[\d -]{6,}\d)"
PEOPLE = r"(\d+) (?:people|persons|children|adults)"
NEEDS = ("water", "food", "shelter", "medicine", "rescue", "blankets")


def tfidf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, weight): term count times ln(documents / documents with the term)."""
    terms = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(F.split(F.lower(text_col), r"\s+"), lambda t: t != "")).alias("term"))
    tf = terms.groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return tf.join(df, "term").join(F.broadcast(n)).select("id", "term", (F.col("tf") * F.ln(F.col("n") / F.col("df"))).alias("weight"))  # n: one row


def help_requests(posts: DataFrame, places: DataFrame, text_col: str = "text") -> DataFrame:
    """posts with phones, people, needs, and the place and position found in the text (longest name wins).

    Words of a post are matched with place names by an equi-join on the name's first word, then by the whole name.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(\w+)"), 1))
    out = posts.select(
        "*", F.regexp_extract_all(text_col, F.lit(PHONE), 1).alias("phones"), F.transform(F.regexp_extract_all(text_col, F.lit(PEOPLE), 1), lambda x: x.cast("int")).alias("people"),
        F.array_intersect(words, F.array(*map(F.lit, NEEDS))).alias("needs"),
    )
    named = posts.select("post_id", F.lower(text_col).alias("_text"), F.explode(words).alias("_first"))
    known = places.select("place", "lat", "lon", F.lower("place").alias("_name")).withColumn("_first", F.split("_name", " ")[0])
    hit = named.join(known, "_first").where(F.expr("contains(concat(' ', regexp_replace(_text, '\\\\W+', ' '), ' '), concat(' ', _name, ' '))"))
    best = hit.groupBy("post_id").agg(F.max_by(F.struct("place", "lat", "lon"), F.struct(F.length("_name"), "_name")).alias("where"))
    return out.join(best, "post_id", "left").select(*out.columns, "where.place", "where.lat", "where.lon")
