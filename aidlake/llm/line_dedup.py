"""Line dedup by a fixed-depth log-template tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_name, written

#: A token that holds a digit is a variable field: numbers, dates, addresses, identifiers. Looked for from a token's start
#: alone and without going back, so that a long token costs its length.
VARIABLE = r"(?<!\S)[^\s\d]*+\d\S*+"
FIELD = "<*>"
#: Documents that make a line recur, and the shortest line looked at: any line that two documents share goes.
MIN_DOCS, MIN_TOKENS = 2, 1
#: Lines of fewer tokens that are all variable are compared as they are: a page number is no template of another.
SHORT = 4


def tokenized(line: Column) -> Column:
    """A line's tokens, variable fields masked, but not in a short line that has no other token."""
    for space in "\t\v\f\r":
        line = F.replace(line, F.lit(space), F.lit(" "))
    split = lambda c: F.array_remove(F.split(c, " "), "")
    masked = split(F.when(line.rlike(r"\d"), F.regexp_replace(line, VARIABLE, FIELD)).otherwise(line))
    return F.when((F.size(masked) < SHORT) & (F.size(F.array_remove(masked, FIELD)) == 0), split(line)).otherwise(masked)


def parsed(df: DataFrame, depth: int) -> DataFrame:
    """Lines of df(id, th, text): (id, th, line_no, n_tokens, leaf, key)."""
    return (
        df.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("id", "th", "line_no", tokenized(F.col("line")).alias("tokens"))
        .withColumn("n_tokens", F.size("tokens"))
        .withColumn("leaf", F.xxhash64("n_tokens", F.slice("tokens", 1, depth)))
        .select("id", "th", "line_no", "n_tokens", "leaf", F.xxhash64("tokens").alias("key"))
    )


def bands(lines: DataFrame, depth: int) -> DataFrame:
    """(bucket, leaf, key): lines(leaf, key, n_tokens, fields, tokens) of a leaf that agree in a band of positions.

    Lines that differ in `fields` places at most agree in one of fields + 1 bands of places, whatever the bands are.
    They are taken as stretches and as every so many-th place; where one place may differ, as all places but one.
    A band is known by the exclusive or of hashes of (place, token), so the work grows with the lines' length.
    """
    at = lines.select("leaf", "key", "n_tokens", "fields", F.posexplode("tokens").alias("pos", "token"))
    at = at.where(F.col("pos") >= depth).select("leaf", "key", "fields", (F.col("n_tokens") - depth).alias("m"), (F.col("pos") - depth).alias("p"), F.xxhash64("pos", "token").alias("h"))
    n_bands = F.col("fields") + 1
    one = at.where("fields = 1")
    whole = one.groupBy("leaf", "key").agg(F.bit_xor("h").alias("all"))
    but_one = one.join(whole, ["leaf", "key"]).select("leaf", "key", F.lit(2).alias("kind"), F.col("p").alias("band"), F.col("all").bitwiseXOR(F.col("h")).alias("x"))
    stretch, comb = F.floor(F.col("p") * n_bands / F.col("m")).cast("int"), F.pmod(F.col("p"), n_bands)
    some = at.where("fields > 1").select("leaf", "key", "h", F.explode(F.array(F.struct(F.lit(0).alias("kind"), stretch.alias("band")), F.struct(F.lit(1).alias("kind"), comb.alias("band")))).alias("b"))
    some = some.groupBy("leaf", "key", "b.kind", "b.band").agg(F.bit_xor("h").alias("x"))
    return but_one.unionByName(some).select(F.xxhash64("leaf", "kind", "band", "x").alias("bucket"), "leaf", "key")


def templates(lines: DataFrame, depth: int, trace: list | None = None) -> DataFrame:
    """(leaf, key, seed): the templates of each leaf, named by their seed line, with the lines that belong to them.

    Each bucket of lines that agree in a band has three seeds: the line most often there and two by a hash. A line
    that differs from a seed in `fields` places at most is of its template; those places are its variable fields. Lines
    of a bucket that are of no seed's template there give the next seeds, twice as many a round, which are held against
    the whole bucket too, until each line of a bucket is a seed or of a seed's template. So of two lines that agree, each is
    in a template. trace, if given, gets the number of (bucket, line) without a template after each round.
    """
    members = written(bands(lines, depth).join(lines.select("leaf", "key", "n"), ["leaf", "key"]), "bands")
    by = lambda k: F.min_by("key", F.xxhash64(F.lit(k), "bucket", "key"))
    seeds = members.groupBy("bucket").agg(F.count("*").alias("size"), F.max(F.struct("n", "key"))["key"].alias("a"), by(1).alias("b"), by(2).alias("c")).where("size > 1")
    seeds = seeds.withColumn("seed", F.array_distinct(F.array("a", "b", "c")))
    seeds = written(seeds.select("bucket", (F.col("size") > F.size("seed")).alias("more"), F.explode("seed").alias("seed")), "seeds")
    side = lines.select("leaf", F.col("key").alias("seed"), F.col("tokens").alias("other"))
    differ = F.size(F.filter(F.zip_with("tokens", "other", lambda a, b: a != b), lambda x: x))

    def alike(of: DataFrame, seeds: DataFrame) -> DataFrame:
        pairs = written(of.join(seeds, "bucket").where("key <> seed").select("leaf", "key", "seed").distinct(), "seed-pairs")
        both = pairs.join(lines.select("leaf", "key", "fields", "tokens"), ["leaf", "key"]).join(side, ["leaf", "seed"])
        return written(both.where(differ <= F.col("fields")).select("leaf", "key", "seed"), "members")

    found = new = alike(members, seeds)
    wide = left = written(members.join(seeds.where("more").select("bucket").distinct(), "bucket", "left_semi").select("bucket", "leaf", "key"), "wide")
    many = 3
    while True:
        met = left.join(seeds.select("bucket", "seed"), "bucket")
        of_one = met.where("key = seed").select("bucket", "key").unionByName(met.join(new, ["leaf", "key", "seed"], "left_semi").select("bucket", "key"))
        left = written(left.join(of_one.distinct(), ["bucket", "key"], "left_anti"), "left")
        n = left.count()
        if trace is not None:
            trace.append(n)
        if not n:
            break
        many *= 2
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("bucket", "key"), "key"))
        seeds = written(left.withColumn("place", place).where(F.col("place") <= many).select("bucket", F.col("key").alias("seed")), "seeds")
        new = alike(wide, seeds)
        found = found.unionByName(new)
    found = found.distinct() if many > 3 else found
    return found.unionByName(found.select("leaf", F.col("seed").alias("key"), "seed").distinct())


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_docs: int = MIN_DOCS, similarity: float = 0.8, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """df with the lines of recurring templates dropped, and n_lines, n_dropped (long).

    The tree: a line goes to a leaf by its token count, then by its first depth tokens, tokens with a digit read as
    one variable field. A leaf has a list of log templates: lines that agree in `similarity` of their tokens with one
    of its seed lines (see templates()), the other places being variable fields; besides, every line is a template of
    its own. A template found in min_docs documents or more is dropped from all of them but the first (smallest id,
    null last, then text hash), so that no content leaves the corpus for good; of a line in several such templates
    the first document of all counts. Lines under min_tokens tokens stay.

    Null texts stay null with 0 lines, empty texts stay empty with 1. Rows with equal id and text count as one
    document and fare alike; a null id comes after all others. An empty table gives none. Other columns are passed on,
    whatever their names (n_lines and n_dropped are replaced). Lines, not texts, are what is grouped, by hashes of 64
    bits; very long texts and lines cost as much as their length. Joins on a common line or template are left to
    Spark's own splitting of skewed partitions, so both their sides are plain tables.
    """
    extra = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    others = [by_name(c).alias(c) for c in extra if c != text_col] or [F.lit(0).alias("none")]
    docs = df.select(F.struct(*others).alias("row"), by_name(id_col).alias("id"), F.xxhash64(by_name(text_col)).alias("th"), by_name(text_col).alias("text"))
    texts = docs.where("text is not null").select("id", "th", "text")
    # Chosen from the table: a filter on the way there would take every line's tokens once more.
    keys = written(parsed(texts, depth), "lines").where(F.col("n_tokens") >= max(1, min_tokens))
    doc = F.struct(F.col("id").isNull().alias("none"), "id", "th")

    here = keys.groupBy("leaf", "key", "n_tokens", "id", "th").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    known = here.groupBy("leaf", "key", "n_tokens").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.min(F.struct(doc.alias("doc"), "line_no")).alias("at"))
    known = written(known.withColumn("fields", F.floor((1 - similarity) * F.col("n_tokens") + 1e-9).cast("int")), "keys")
    alone = known.where(F.col("n_docs") >= min_docs).select("leaf", "key", F.col("at.doc").alias("first"))

    # Only a leaf with different lines, in enough documents, and long enough to have fields has other templates.
    leaves = known.where("fields > 0").groupBy("leaf").agg(F.count("*").alias("n_keys"), F.sum("n_docs").alias("n_docs"))
    leaves = written(leaves.where((F.col("n_keys") > 1) & (F.col("n_docs") >= min_docs)).select("leaf"), "leaves")
    picked = known.where("fields > 0").join(leaves, "leaf", "left_semi").select("leaf", "key", "n", "n_tokens", "fields", "at.doc.id", "at.doc.th", "at.line_no")
    wanted = written(picked.groupBy("id", "th").agg(F.collect_list(F.struct("line_no", "leaf", "key", "n", "n_tokens", "fields")).alias("lines")), "wanted")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    once = texts.alias("t").join(wanted.alias("w"), same(texts, wanted)).select("w.lines", F.split("t.text", "\n").alias("split")).select(F.explode("lines").alias("l"), F.element_at("split", F.col("l.line_no") + 1).alias("line"))
    lines = written(once.select("l.leaf", "l.key", "l.n", "l.n_tokens", "l.fields", tokenized(F.col("line")).alias("tokens")).dropDuplicates(["leaf", "key"]), "leaf-lines")
    member = written(templates(lines, depth), "templates")
    where = keys.join(member, ["leaf", "key"]).groupBy("leaf", "seed", "id", "th").agg(F.lit(1).alias("one"))
    again = where.groupBy("leaf", "seed").agg(F.count("*").alias("n_docs"), F.min(doc).alias("first")).where(F.col("n_docs") >= min_docs)
    again = written(again.select("leaf", "seed", "first"), "recurring")
    firsts = member.join(again, ["leaf", "seed"]).select("leaf", "key", "first").unionByName(alone)
    firsts = written(firsts.groupBy("leaf", "key").agg(F.min("first").alias("first")), "firsts")

    dropped = keys.join(firsts, ["leaf", "key"]).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))))
    per_doc = written(dropped.groupBy("id", "th").agg(F.collect_set("line_no").alias("gone")), "gone")
    docs = docs.select("row", "id", "th", F.split("text", "\n").alias("lines"))
    out = docs.join(per_doc, same(docs, per_doc), "left").select("row", "lines", "gone")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n")
    return out.select(
        *[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in extra],
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")
