"""Sources: SQLite tables, CSV with declared columns, ESRI ASCII grids, GeoJSON features, labelled images, made-up gauges and pictures."""

from __future__ import annotations

import os
import shutil
import sqlite3
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, WriterCommitMessage,
)
from pyspark.sql.types import StructType

GEOJSON = "type string, features array<struct<type string, properties map<string,string>, geometry struct<type string, coordinates string>>>"


KINDS = {"INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}
STORED = {"byte": "INTEGER", "short": "INTEGER", "integer": "INTEGER", "long": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}


class SqliteSource(DataSource):
    """A table of a SQLite file: spark.read.format("sqlite").option("path", file).option("table", name).schema(ddl).load().

    A table is split by ranges of its rowid, or of its primary key's first column where it has no rowid; a view is read by one
    task. With option pushdown, which needs spark.sql.python.filterPushdown.enabled, filters that SQLite judges
    as Spark does are judged there; sqlite() sets it. Writing appends or overwrites: each task writes a file of its own beside
    the target, and the commit moves their rows into the table in one transaction, so that readers see all or none; a
    file has one writer by its nature. NaN is stored as null, as SQLite has none. The path is one that all machines share.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{n.replace('`', '``')}` {_kind(k)}" for n, k, _ in _columns(self.options["path"], self.options["table"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushes else SqliteReader)(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(self.options["path"], self.options["table"], schema, overwrite)


def sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table or view of a SQLite file; filters go to SQLite where the session allows it."""
    spark.dataSource.register(SqliteSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sqlite").option("path", path).option("table", table).option("pushdown", pushes).load()


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _columns(path: str, table: str) -> list[tuple[str, str, int]]:
    """(name, declared type, place in the primary key or 0) of a table's columns."""
    with closing(_opened(path)) as c:
        return [(n, k or "", key) for _, n, k, _, _, key in c.execute(f"PRAGMA table_info({_quoted(table)})")]


def _kind(declared: str) -> str:
    return KINDS.get(declared.upper(), "string")


class Rows(InputPartition):
    """The rows from low, and under high, by a column; None is no bound."""

    def __init__(self, low, high):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.table, self.names, self.parts = options["path"], options["table"], names, int(options.get("partitions", 4))
        columns = _columns(self.path, self.table)
        self.kinds = {n: k.upper() for n, k, _ in columns}
        with closing(_opened(self.path)) as c:
            view = c.execute("SELECT 1 FROM sqlite_master WHERE name = ? COLLATE NOCASE AND type = 'view'", (self.table,)).fetchone()
            try:
                c.execute(f"SELECT rowid FROM {_quoted(self.table)} LIMIT 0")
                self.by = "rowid"
            except sqlite3.OperationalError:  # WITHOUT ROWID
                self.by = _quoted(next(n for n, _, key in columns if key == 1)) if not view else None
        if view:
            self.by = None
        self.where, self.values = [], []

    def partitions(self) -> list[InputPartition]:
        if self.by is None:
            return [Rows(None, None)]
        with closing(_opened(self.path)) as c:
            if self.by == "rowid":
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                step = 0 if low is None else -(-(high - low + 1) // self.parts)
                cuts = [] if low is None else list(range(low + step, high + 1, step))
            else:
                n = c.execute(f"SELECT count(*) FROM {_quoted(self.table)}").fetchone()[0]
                found = [c.execute(f"SELECT {self.by} FROM {_quoted(self.table)} ORDER BY {self.by} LIMIT 1 OFFSET ?", (n * i // self.parts,)).fetchone() for i in range(1, self.parts)]
                cuts = list(dict.fromkeys(f[0] for f in found if f))  # in order, each once
        return [Rows(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def statement(self, partition: Rows) -> tuple[str, list]:
        """What a task asks SQLite."""
        where, values = list(self.where), list(self.values)
        for bound, sign in ((partition.low, ">="), (partition.high, "<")):
            if bound is not None:
                where.append(f"{self.by} {sign} ?")
                values.append(bound)
        cols = ", ".join(map(_quoted, self.names))
        return f"SELECT {cols} FROM {_quoted(self.table)}" + (" WHERE " + " AND ".join(where) if where else ""), values

    def read(self, partition: Rows):
        with closing(_opened(self.path)) as c:
            yield from c.execute(*self.statement(partition))


class PushingReader(SqliteReader):
    """A reader whose filters are SQLite's; those that it could judge unlike Spark stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            got = self.condition(f)
            if got is None:
                yield f
            else:
                self.where.append(got[0])
                self.values += got[1]

    def condition(self, f: Filter) -> tuple[str, list] | None:
        if isinstance(f, Not):
            inner = self.condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        if len(f.attribute) != 1 or f.attribute[0] not in self.kinds:
            return None
        name = f.attribute[0]
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{_quoted(name)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
        signs = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        if not (type(f) in signs or isinstance(f, In)) or not values or not all(self.alike(name, v) for v in values):
            return None
        column = _quoted(name) + (" COLLATE BINARY" if isinstance(values[0], str) else "")
        return (f"{column} IN ({', '.join('?' * len(values))})" if isinstance(f, In) else f"{column} {signs[type(f)]} ?"), values

    def alike(self, name: str, value) -> bool:
        """Whether SQLite compares the column with the value as Spark does: of one kind, and no NaN."""
        declared = self.kinds[name]
        if isinstance(value, str):
            return any(t in declared for t in ("CHAR", "CLOB", "TEXT"))
        if isinstance(value, float):
            return _kind(declared) == "double" and value == value
        wanted = {int: "bigint", bytes: "binary"}.get(type(value))
        return wanted is not None and _kind(declared) == wanted


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class SqliteWriter(DataSourceWriter):
    def __init__(self, path: str, table: str, schema: StructType, overwrite: bool):
        for f in schema.fields:
            if f.dataType.typeName() not in STORED:
                raise ValueError(f"SQLite has no type for column {f.name}: cast its {f.dataType.simpleString()}")
        self.path, self.table, self.names, self.overwrite = path, table, schema.names, overwrite
        self.columns = ", ".join(f"{_quoted(f.name)} {STORED[f.dataType.typeName()]}" for f in schema.fields)
        self.parts = f"{path}-{uuid.uuid4().hex}"
        os.makedirs(self.parts)  # by the driver alone, so that a late task of an aborted job does not bring it back

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        path = f"{self.parts}/{uuid.uuid4().hex}.db"
        marks = ", ".join("?" * len(self.names))
        with closing(sqlite3.connect(path)) as c, c:
            c.execute(f"CREATE TABLE part ({self.columns})")
            c.executemany(f"INSERT INTO part VALUES ({marks})", (tuple(bytes(v) if isinstance(v, bytearray) else v for v in row) for row in iterator))
        return Written(path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        names, target = ", ".join(map(_quoted, self.names)), _quoted(self.table)
        try:
            with closing(sqlite3.connect(self.path, isolation_level=None)) as c:
                c.execute("BEGIN IMMEDIATE")
                if self.overwrite:
                    c.execute(f"DROP TABLE IF EXISTS {target}")
                c.execute(f"CREATE TABLE IF NOT EXISTS {target} ({self.columns})")
                for m in messages:
                    if m is not None:
                        with closing(sqlite3.connect(m.path)) as part:
                            c.executemany(f"INSERT INTO {target} ({names}) VALUES ({', '.join('?' * len(self.names))})", part.execute(f"SELECT {names} FROM part"))
                c.execute("COMMIT")
        finally:
            self.clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """Removes the parts, also where a task that is being stopped still adds one."""
        for _ in range(20):
            shutil.rmtree(self.parts, ignore_errors=True)
            if not os.path.exists(self.parts):
                break
            time.sleep(0.1)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


#: Columns of a road table and of a water-level table; bad holds a line that does not fit them.
ROADS = "src long, dst long, length double, risk double, bad string"
LEVELS = "station string, ts timestamp_ntz, level double, bad string"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file or folder with a header and declared columns; a malformed line has nulls and itself in bad."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad", enforceSchema=False)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, kind, geometry): one row for each feature; coordinates stay JSON, as kinds nest differently."""
    whole = spark.read.option("multiLine", True).schema(GEOJSON).json(path)
    f = whole.select(F.explode("features").alias("f"))
    return f.select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def point(coordinates: Column) -> tuple[Column, Column]:
    """(lon, lat) of a Point's coordinates."""
    return F.get_json_object(coordinates, "$[0]").cast("double"), F.get_json_object(coordinates, "$[1]").cast("double")


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value) of ESRI ASCII grids with a line a row; cells without data are left out.

    Files are read by ranges of lines, a large one by several tasks. A first pass counts each range's lines, by which the
    second one knows its rows.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    none = F.regexp_extract(F.lower("line"), r"^nodata_value (\S+)", 1)
    kept = text.select("path", "block", "line", none.alias("none"), F.col("line").rlike(r"^[-+.\d]").alias("body")).where("body or none <> ''")
    kept = kept.withColumn("id", F.monotonically_increasing_id())  # within a range the lines of cells follow each other
    ranges = kept.groupBy("path", "block").agg(F.min(F.when(F.col("body"), F.col("id"))).alias("first"), F.count_if("body").alias("n"), F.max(F.when(~F.col("body"), F.col("none").cast("double"))).alias("none"))
    file = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("path", "block", (before - F.col("first")).alias("shift"), F.max("none").over(file).alias("none"))
    lines = kept.where("body").drop("none").join(ranges, ["path", "block"]).select("path", "none", (F.col("id") + F.col("shift")).cast("int").alias("row"), "line")
    cells = lines.select("path", "none", "row", F.posexplode(F.split("line", " ")).alias("col", "v"))
    value = F.col("v").cast("double")
    return cells.where(F.col("none").isNull() | (value != F.col("none"))).select("path", "row", "col", value.alias("value"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, height, width, channels, data): pictures in one folder for each class; bytes are in BGR order."""
    df = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    label = F.element_at(F.split("image.origin", "/"), -2).alias("label")
    return df.select(F.col("image.origin").alias("path"), label, "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def gauges(spark: SparkSession, stations: int, hours: int, seed: int = 0, readings: DataFrame | None = None) -> DataFrame:
    """(gauge, ts, rain_mm, fault): hourly rain with known faults, made up or from readings(g int, h int, v double).

    missing: no reading; range: an impossible one; stuck: one reading for a whole day; scaled: twice the rain and more,
    which no rule on single readings can tell from a shower.
    """
    base = readings or spark.range(stations * hours).select((F.col("id") / hours).cast("int").alias("g"), (F.col("id") % hours).cast("int").alias("h"))
    r = lambda k, *c: F.pmod(F.xxhash64(F.lit(seed + k), *c), F.lit(10_000)) / 10_000.0
    day = F.floor(F.col("h") / 24)
    one = r(1, "g", "h")
    fault = F.when(one < 0.02, "missing").when(one < 0.03, "range").when(r(5, F.col("g"), day) < 0.04, "stuck").when(one < 0.05, "scaled").otherwise("none")
    at = base.withColumn("fault", fault).withColumn("at", F.when(F.col("fault") == "stuck", day * 24 + 4).otherwise(F.col("h")))
    dry = F.round(F.greatest(F.lit(0.0), 6 * F.sin(F.col("at") / 9.0) + 2 * r(3, "g", "at")), 2)
    if readings is not None:
        dry = F.when(F.col("fault") == "stuck", F.round(6 * r(3, F.col("g"), day), 2)).otherwise(F.round("v", 2))
    kind = F.col("fault")
    rain = F.when(kind == "missing", None).when(kind == "range", 900 + 100 * r(2, "g", "h")).when(kind == "scaled", 2 * dry + 12).otherwise(dry)
    return at.select(F.format_string("g%03d", "g").alias("gauge"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600)).alias("ts"), rain.alias("rain_mm"), "fault")


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A picture in PNG from rows of 8-bit RGB."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: Pictures that a task makes up.
PICTURES = 2_000


def made_pictures(spark: SparkSession, folder: str, of: int | DataFrame, size: int = 16, seed: int = 0) -> DataFrame:
    """Made-up pictures of fire and no fire, written to a shared folder by the tasks and read as labelled images.

    `of` is a number of them, or rows (id long, fire int, noise double): a picture each, as noisy as its row says.
    """
    if isinstance(of, int):
        of = spark.range(of).select("id", (F.col("id") % 2 == 0).cast("int").alias("fire"), F.lit(None).cast("double").alias("noise"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for i, fire, noise in zip(*(b.column(c).to_pylist() for c in ("id", "fire", "noise")), strict=True):
                r, label = np.random.default_rng([seed, i]), ("no_fire", "fire")[fire]
                base = r.uniform((130, 20, 0), (255, 120, 60)) if label == "fire" else r.uniform((0, 60, 60), (130, 180, 200))
                pixels = np.clip(base + r.normal(0, r.uniform(5, 50) if noise is None else noise, (size, size, 3)), 0, 255).astype(np.uint8)
                fs.create_dir(f"{path}/{label}", recursive=True)
                with fs.open_output_stream(f"{path}/{label}/{i}.png") as f:
                    f.write(png(size, size, pixels.tobytes()))
            yield b.select(["id"])

    of = of.select("id", "fire", "noise")
    of.repartition(max(1, -(-of.count() // PICTURES)), "id").mapInArrow(work, "id long").count()
    return images(spark, folder)
