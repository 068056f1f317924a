"""Misspelt place names in texts, found through an index of what is left when letters are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import table

#: Most edits that are looked for, and the lengths from which a name may have one and two.
EDITS, ONE, TWO = 2, 5, 8


def less_one(s: Column) -> Column:
    """The strings that are s without one character, none of an empty one."""
    at = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))


def deletions(s: Column) -> Column:
    """What is left of s without up to EDITS characters. Strings within EDITS edits of each other share one of these.

    Each edit is undone by deleting the character it touched on either side, so both come to the same rest.
    """
    out = level = F.array(s)
    for _ in range(EDITS):
        level = F.array_distinct(F.flatten(F.transform(level, less_one)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def allowed(name: Column) -> Column:
    return F.when(F.length(name) >= TWO, 2).when(F.length(name) >= ONE, 1).otherwise(0)


def windows(text: Column, most: int) -> Column:
    """The distinct runs of 1 to `most` words of a text in lower case, one space apart."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[runs(n) for n in range(1, most + 1)]))


def matches(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, name, distance) of mentions(mention) and names(name) that are near enough, both distinct.

    Names of up to four letters must be met exactly, of up to seven with one edit, longer ones with two. Pairs meet by
    equality of what deletions leave, by its hash, and are then verified: no pair is passed over, none is compared but
    those that share a rest.
    """
    side = lambda df, c, n: df.select(c, F.explode(F.transform(deletions(F.col(c)), lambda v: F.xxhash64(v))).alias(n))
    met = side(mentions, "mention", "rest").join(side(names, "name", "rest"), "rest").select("mention", "name").distinct()
    return met.select("*", F.levenshtein("mention", "name").alias("distance")).where(F.col("distance") <= allowed(F.col("name")))


def located(posts: DataFrame, places: DataFrame, id_col: str, text_col: str, most: int = 2) -> DataFrame:
    """posts with place, lat, lon and distance: the one of places(place, lat, lon) that a post's words come nearest to.

    Fewest edits win, then the longer name, then the lesser name, latitude and longitude; without any match these are
    null. Names are compared in lower case. Rows of equal id are one post, whose first match counts for all; null texts
    have no words, and posts with a null id no place. What travels are distinct runs of words, not texts; runs that are
    longer or shorter than any name are left aside.
    """
    known = table(places.where("place is not null").select("place", "lat", "lon", F.lower("place").alias("name")).where("name <> ''"), "places")
    sizes = known.agg(F.min(F.length("name")).alias("least"), F.max(F.length("name")).alias("longest"))
    said = posts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(windows(F.col(text_col), most)).alias("mention"))
    said = said.join(F.broadcast(sizes), F.length("mention").between(F.col("least") - EDITS, F.col("longest") + EDITS)).select("id", "mention")  # sizes: one row
    said = table(said.distinct(), "mentions")
    hits = table(matches(said.select("mention").distinct(), known.select("name").distinct()), "matches")
    near = hits.join(known, "name").groupBy("mention").agg(F.min(F.struct("distance", (-F.length("name")).alias("size"), "name", "lat", "lon", "place")).alias("m"))
    best = said.join(near, "mention").groupBy("id").agg(F.min("m").alias("m"))
    return posts.join(best, posts[id_col] == best["id"], "left").select(*[posts[c] for c in posts.columns], "m.place", "m.lat", "m.lon", "m.distance")
