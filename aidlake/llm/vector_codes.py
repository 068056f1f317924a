"""Codes of vectors: product quantisation by Lloyd's rounds in integers, with Yinyang bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_name, drop, written

#: A component x is floor(SCALE * x); parts of a vector, entries of a part's codebook, rounds of Lloyd.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries of a group that shares a lower bound, on average.
GROUP = 4
#: Largest integer component, so that the squared distances of 512 components a part fit 64 bits.
LARGEST = 1 << 26
#: Integers of vectors held at once in a task, besides a batch.
HELD = 1 << 21
#: Shares of the rows of a label when its sum is handed out.
SALTS = 32
FAR = np.iinfo(np.int64).max


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> DataFrame:
    """df's (id, label, vec) with a vector of finite components that can be cut."""
    rows = df.select(by_name(id_col).alias("id"), by_name(label_col).alias("label"), by_name(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("vec") > 0) & (F.size("vec") % parts == 0) & finite)


def integers(x: np.ndarray) -> np.ndarray:
    y = np.floor(x * SCALE)
    if len(y) and np.abs(y).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / SCALE:.0f}")
    return y.astype(np.int64)


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each codebook entry: a few rounds of clustering the entries themselves."""
    k = len(entries)
    centres = entries[:: max(1, GROUP)][: -(-k // GROUP)].astype(float)
    for _ in range(5):
        at = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([entries[at == g].mean(0) if (at == g).any() else c for g, c in enumerate(centres)])
    return np.unique(at, return_inverse=True)[1]


def assigned(x: np.ndarray, entries: np.ndarray, group: np.ndarray, at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance, lower bounds, distances computed) of each row of x.

    at: the entry so far; low[:, g]: no entry of group g but that one is nearer than this. Only groups whose bound is not
    above the distance to the entry so far are scanned; distances are exact integers, and ties go to the lower entry.
    """
    n, k = len(x), len(entries)
    own = ((x - entries[at]) ** 2).sum(1)
    ask = low <= np.sqrt(own.astype(float))[:, None] * (1 + 1e-9)
    all_d, best, least, computed = np.full((n, k), FAR), at.copy(), own.copy(), n
    for g in range(low.shape[1]):
        rows, members = np.flatnonzero(ask[:, g]), np.flatnonzero(group == g)
        if not len(rows):
            continue
        d = np.stack([((x[rows] - entries[e]) ** 2).sum(1) for e in members], 1)
        computed += d.size
        all_d[rows[:, None], members] = d
        j = d.argmin(1)
        near, who = d[np.arange(len(rows)), j], members[j]
        better = (near < least[rows]) | ((near == least[rows]) & (who < best[rows]))
        best[rows[better]], least[rows[better]] = who[better], near[better]
    all_d[np.arange(n), best] = FAR
    new = low.copy()
    for g in range(low.shape[1]):
        rows = np.flatnonzero(ask[:, g])
        d = all_d[rows][:, group == g].min(1) if len(rows) else np.empty(0, np.int64)
        new[rows, g] = np.where(d == FAR, np.inf, np.sqrt(d.astype(float)))
    # The entry that was left counts again in its group; where that was not scanned, its bound has to know.
    left = np.flatnonzero((best != at) & ~ask[np.arange(n), group[at]])
    new[left, group[at[left]]] = np.minimum(new[left, group[at[left]]], np.sqrt(own[left].astype(float)))
    return best, least, new, computed


def down(low: np.ndarray) -> np.ndarray:
    """As 32-bit numbers that are not larger."""
    return np.nextafter((low * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def fields(df: DataFrame) -> list[T.StructField]:
    return [T.StructField("id", df.schema["id"].dataType), T.StructField("label", df.schema["label"].dataType)]


def assign(state: DataFrame, books: np.ndarray, before: np.ndarray | None, groups: list[np.ndarray], last: bool) -> DataFrame:
    """One round over state(id, label, x, at, low): the same with new entries and bounds, and the sums that moved.

    before: the codebooks of the round before (none in the first). A row with part set has, of one task, the count and the
    sums of the vectors that an entry gained less what it lost; part -1 has the distances computed. last gives
    (id, label, code, error) instead.
    """
    parts, k, d = books.shape
    most = max(g.max() for g in groups) + 1
    drift = np.zeros((parts, most))
    if before is not None:
        moved = np.sqrt(((books - before) ** 2).sum(2).astype(float)) * (1 + 1e-9)
        for p in range(parts):
            np.maximum.at(drift[p], groups[p], moved[p])
    head = fields(state)
    plain = lambda b, c, t: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(t).reshape(b.num_rows, -1)
    lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), t))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, count, computed = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64), 0
        step = max(1, HELD // (parts * d))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                n, first = b.num_rows, before is None
                x = integers(plain(b, "vec", float)) if first else plain(b, "x", np.int64)
                at = np.zeros((n, parts), np.int64) if first else plain(b, "at", np.int64)
                low = np.full((n, parts, most), -1.0) if first else plain(b, "low", float).reshape(n, parts, most) - drift
                new, error = at.copy(), np.zeros(n, np.int64)
                for p in range(parts):
                    xp = x[:, p * d : (p + 1) * d]
                    m = groups[p].max() + 1
                    new[:, p], dist, low[:, p, :m], c = assigned(xp, books[p], groups[p], at[:, p], low[:, p, :m])
                    error, computed = error + dist, computed + c
                    other = np.arange(n) if first else np.flatnonzero(new[:, p] != at[:, p])
                    np.add.at(gain[p], new[other, p], xp[other])
                    count[p] += np.bincount(new[other, p], minlength=k)
                    if not first:
                        np.subtract.at(gain[p], at[other, p], xp[other])
                        count[p] -= np.bincount(at[other, p], minlength=k)
                keep = [b.column("id"), b.column("label")]
                if last:
                    code = [bytes(r).hex() for r in new.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(code, pa.string()), pa.array(error)], ["id", "label", "code", "error"])
                else:
                    none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*keep, lists(x, pa.int32()), lists(new, pa.int16()), lists(down(low).reshape(n, -1), pa.float32()), *none], ["id", "label", "x", "at", "low", "part", "entry", "sums"])
        if not last and computed:
            p, e = np.nonzero(count.astype(bool) | gain.any(2))
            sums = [[computed], *np.column_stack([count[p, e], gain[p, e]]).tolist()]
            n, kinds = len(sums), {f.name: f.type for f in whole.schema}
            none = [pa.nulls(n, t) for t in (kinds["id"], kinds["label"], pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array([-1, *p.tolist()], pa.int32()), pa.array([0, *e.tolist()], pa.int32()), pa.array(sums, pa.list_(pa.int64()))], ["id", "label", "x", "at", "low", "part", "entry", "sums"])

    if last:
        return state.mapInArrow(work, T.StructType([*head, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    more = [("x", T.ArrayType(T.IntegerType())), ("at", T.ArrayType(T.ShortType())), ("low", T.ArrayType(T.FloatType())), ("part", T.IntegerType()), ("entry", T.IntegerType()), ("sums", T.ArrayType(T.LongType()))]
    return state.mapInArrow(work, T.StructType([*head, *[T.StructField(n, t) for n, t in more]]))


def trained(rows: DataFrame, first: np.ndarray, rounds: int, trace: list | None) -> tuple[DataFrame, np.ndarray, np.ndarray | None, list[np.ndarray]]:
    """(state, final codebooks, those of the round before, groups) after the rounds.

    A round reads the state once and writes it once to the shared folder; the driver gets one row an entry and component.
    """
    parts, k, d = first.shape
    books, before, groups, state = first, None, [grouped(b) for b in first], rows
    totals, counts = np.zeros((parts, k, d), object), np.zeros((parts, k), object)
    for _ in range(rounds):
        old, table = state, written(assign(state, books, before, groups, last=False), "codes-state")
        sums = table.where("part is not null").select("part", "entry", F.posexplode("sums").alias("i", "v")).groupBy("part", "entry", "i").agg(F.sum("v").alias("v")).collect()
        for r in sums:
            if r.part < 0:
                trace is not None and trace.append(r.v)
            elif r.i == 0:
                counts[r.part, r.entry] += r.v
            else:
                totals[r.part, r.entry, r.i - 1] += r.v
        if old is not rows:
            drop(old)
        state = table.where("part is null")
        before, books = books, books.copy()
        for p, e in zip(*np.nonzero(counts), strict=True):
            books[p, e] = [t // counts[p, e] for t in totals[p, e]]
    return state, books, before, groups


def with_label_sums(codes: DataFrame) -> DataFrame:
    """codes(id, label, code, error) and label_error, the errors of equal labels summed; a large label's sum is met in SALTS tasks."""
    rows = codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))
    sums = rows.groupBy("label", "salt").agg(F.sum("error").alias("s")).groupBy("label").agg(F.sum("s").alias("label_error"), F.bit_or(one).alias("salts"))
    has = lambda i: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), has)).alias("of_salt"))
    return rows.join(sums, rows["label"].eqNullSafe(sums["of"]) & (rows["salt"] == sums["of_salt"])).drop("of", "of_salt", "salt")


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, trace: list | None = None) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): each vector as an entry's number in each part's codebook.

    Components become floor(4096 * x); a part's codebook begins as that part of the vectors with the smallest ids (ties by
    the vectors themselves, null ids last; fewer entries where there are fewer vectors). A round gives every part its
    nearest entry and replaces each entry by the floor of its parts' mean; entries without parts stay. Bounds of Yinyang
    k-means (Ding et al., 2015) tell which groups of entries need no look; what they leave is compared in integers, so
    codes are those of plain Lloyd. trace, if given, gets the distances computed in each round.

    Rows whose vector is null or empty, has null or non-finite components or no multiple of parts as its length are left
    out, as are those of another length than the vector with the smallest id. Repeated rows are rows of their own; null
    labels are one label. An empty table gives none. Components beyond 16,384 are refused, as their squared distances
    would pass 64 bits. Long vectors are taken in slices of bounded size; other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    spark, rows = df.sparkSession, usable(df, id_col, vec_col, label_col, parts)
    least = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries)
    first = least.select("vec").collect()
    size = len(first[0].vec) if first else parts
    rows = rows.where(F.size("vec") == size)
    if any(len(r.vec) != size for r in first):
        first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    out = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    if not first:
        return spark.createDataFrame([], out)
    start = integers(np.array([r.vec for r in first], float)).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    state, books, before, groups = trained(rows, start, rounds, trace)
    codes = written(assign(state, books, before, groups, last=True), "codes")
    if rounds:
        drop(state)
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return with_label_sums(codes).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql() -> str:
    """The same by plain Lloyd in SQL: each round is a step of its own."""
    steps = [
        f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x, len(embedding) // {PARTS} AS d FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, q, x[q * d + 1 : q * d + d] AS x FROM v, unnest(range({PARTS})) AS t(q))",
        f"c0 AS MATERIALIZED (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    near = lambda i: f"""a{i} AS MATERIALIZED (SELECT vec_id, label, q, x, n.e AS e, n.s AS s FROM (SELECT p.*, min({{'s': list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': c.e}}) AS n
            FROM p JOIN c{i} c ON c.q = p.q GROUP BY ALL) y)"""  # noqa: E731
    for i in range(ROUNDS):
        steps.append(near(i))
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.q, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT q, e, list(f ORDER BY i) AS x FROM
            (SELECT q, e, i, ((sum(x[i]) - (((sum(x[i]) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS f FROM a{i}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY q, e, i) z GROUP BY q, e) m ON m.q = c.q AND m.e = c.e)""")
    steps.append(near(ROUNDS))
    steps.append(f"r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY q) AS code, sum(s)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    return f"""WITH {", ".join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY q, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM r"""
