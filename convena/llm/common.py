"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that a broadcast may hold: 2**20 longs take about 32 MB as a hashed relation.
BROADCAST_KEYS = 1 << 20

#: Most rows that a broadcast with other columns beside the keys may hold, and tasks that a key's rows are dealt over otherwise.
SMALL_KEYS, SALTS = 1 << 14, 8
#: Bits of a row's place within its file; the file's number stands above them.
PLACE_BITS = 36
#: Nodes of a plan that keep rows as the scan has them.
KEEPING = {"Project", "Filter", "SubqueryAlias"}
#: Tables that this process has written to the shared folder and not removed.
WRITTEN: list[str] = []
#: Folders made for local applications that name none.
OWN_FOLDERS: dict[str, str] = {}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's checkpoint folder; one of our own only where the session names none and is local, as in tests: elsewhere executors would not share it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in OWN_FOLDERS:
            OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="convena-")
        found = OWN_FOLDERS[context.applicationId]
    return found.rstrip("/")


def new_table(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder for a table that ``remove`` or the end of the process removes."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again, so that a lost executor costs no recomputation."""
    path = new_table(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(paths: list[str]) -> None:
    """Remove tables of this process that nothing needs any more. Results are lazy, so a caller removes an operator's tables (those of ``WRITTEN`` since the call) once the result is written."""
    context = SparkContext._active_spark_context
    for path in paths:
        if context is not None and context._jsc is not None:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        elif path.startswith(("/", "file:")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        if path in WRITTEN:
            WRITTEN.remove(path)


@atexit.register
def remove_written() -> None:
    """Remove the tables of this process when it ends: a result may need them until then, as it is lazy."""
    remove(list(WRITTEN))


def scans_files(df: DataFrame) -> bool:
    """Whether each row is one row of a Parquet file, at most projected and filtered."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in KEEPING:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().split("\n")[0]


def wrapped(docs: DataFrame) -> DataFrame:
    """The whole row as ``doc``, so that no column of it can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def stored(df: DataFrame) -> DataFrame:
    """``df``, written once unless its rows come straight from Parquet files: so that rows can be told apart by their place in a file."""
    return df if scans_files(df) and "_metadata" not in {c.lower() for c in df.columns} else materialise(df, "rows")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` (written first if need be, see ``stored``) with a number for each row that stays the same however often, and in whatever cuts, it is read: the place of its file among the sorted files, and its place in the file.

    A scan has under 2**27 files of under 2**PLACE_BITS rows; the numbers of up to ``BROADCAST_KEYS`` files are sent to all tasks.
    """
    df = stored(df)
    files = sorted(r[0] for r in df.select(F.col("_metadata.file_path").alias("f")).distinct().collect())
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    number = F.lit(0).cast("long")
    if len(files) > 1:
        numbers = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, number long")
        placed = placed.join(F.broadcast(numbers) if len(files) <= BROADCAST_KEYS else numbers, "file")
        number = F.col("number")
    return placed.select("row.*", (F.shiftleft(number, PLACE_BITS) + F.col("place")).alias(name))


def bounded(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` (a materialised, narrow table) marked for broadcast if it is proven small; otherwise as it is, for a shuffle join."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], salt: str, most: int = SMALL_KEYS) -> DataFrame:
    """``left`` joined to ``right`` (materialised, unique by ``on``) where one key may have much of ``left``: by broadcast if ``right`` has ``most`` rows at most, else each key's rows are dealt out by ``salt`` over SALTS tasks, to each of which goes its row of ``right``."""
    small = bounded(right, most)
    if small is not right:
        return left.join(small, on)
    dealt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS).cast("long"))).join(dealt, [*on, "_salt"]).drop("_salt")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(_node, _root): the least node that each node of the undirected edges (_a, _b) reaches; large and small stars by turns until nothing changes."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Each node passes its least neighbour (itself included) to its larger neighbours, or to itself and its smaller ones."""
        both = pairs.select("_a", "_b").unionByName(pairs.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))) if large else pairs.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b"))
        least = both.groupBy("_a").agg(F.min("_b").alias("_m")).select("_a", F.least("_a", "_m").alias("_m"))
        met = both.join(least, "_a")
        new = met.filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")) if large else met.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).unionByName(least.select("_a", F.col("_m").alias("_b")))
        return new.filter("_a <> _b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first())

    now = materialise(edges.select("_a", "_b").filter("_a <> _b").distinct(), tag)
    before, after = None, state(now)
    while before != after:
        last = WRITTEN[-1]
        now = materialise(star(star(now, True), False), tag)
        remove([last])
        before, after = after, state(now)
    return now.select(F.col("_a").alias("_node"), F.col("_b").alias("_root")).unionByName(now.select(F.col("_b").alias("_node"), F.col("_b").alias("_root")).distinct())
