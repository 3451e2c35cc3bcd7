"""What the corpus operators share: tables, scratch tables, bounded broadcasts, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a two-column side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows and bytes of a batch of texts on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold whole texts of at most BATCH_ROWS rows and about BATCH_BYTES.

    Both ends of the pipe to a Python worker hold a batch outside the heap. The bound is a
    setting of the session, as plans that are returned run later; results don't depend on
    it, and a smaller number of rows that the session names stays.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a temporary one in local mode; on a cluster that's an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs one stage, not the job.

    ``drop`` removes a table that no later step reads; the rest go when the driver exits.
    """

    _left: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
        if not Scratch._left:
            atexit.register(Scratch._clean)
        Scratch._left.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._scratch_path)

    @classmethod
    def _clean(cls) -> None:
        for spark, path in cls._left:
            try:
                if spark.sparkContext._jsc is not None:
                    _delete(spark, path)
            except Exception:  # the JVM may be gone already; the folder is the cluster's scratch space
                return


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` (narrow) rows, else as it is.

    Beyond the limit the join shuffles both sides; the callers' small sides have
    unique keys, so adaptive execution can split a hot key of the other side.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _number_of_files(docs: DataFrame) -> DataFrame | None:
    """(path, file number) of the Parquet files that ``docs`` reads; None if ``docs`` is more than columns and rows of one such table."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        paths = docs.select(meta["file_path"].alias("path"), meta["row_index"].alias("at")).groupBy("path").agg(F.count("at").alias("rows"))
    except AnalysisException:
        return None
    return paths.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("number"))  # a row a file


def numbered(docs: DataFrame, scratch: Scratch, name: str = "row") -> DataFrame:
    """``docs`` and a long column ``name`` that numbers its rows, the same in every job that reads the result.

    A row's number is its file's (of the sorted paths) and its place in the file, so it
    doesn't depend on how the files are split into tasks, on the number of cores or on lost
    executors. What isn't a plain read of Parquet files is written once, and that is read.
    """
    files = _number_of_files(docs)
    if files is None:
        docs = scratch.write(docs, "rows")
        files = _number_of_files(docs)
    files = scratch.write(files, "files")
    path, at = fresh(docs.columns, "path"), fresh(docs.columns, "at")
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], meta["file_path"].alias(path), meta["row_index"].alias(at))
    number = fresh([*rows.columns, name], "number")
    rows = rows.join(small_side(files.select(F.col("path").alias(path), F.col("number").alias(number))), path)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft(F.col(number), 36) + F.col(at)).alias(name))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v only, and no v is a u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b: long): component is the smallest id reachable.

    Alternating large and small stars until only stars are left: each round is a
    few aggregations and joins, the number of rounds grows with the logarithm of
    the longest path. Groups are reduced by min() before they are shuffled. The minima
    are tables with a row a key, so both sides of their joins are plain shuffles and
    adaptive execution can split a centre with very many links.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.write(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"), "large")
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(now)
        scratch.drop(large)
        now = then
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def with_component(ids: DataFrame, comps: DataFrame, name: str, to: str) -> DataFrame:
    """``ids`` with the component of the ids in column ``name`` as column ``to``; what ``comps`` lacks is its own."""
    found = comps.select(F.col("id").alias(name), F.col("component").alias("_component"))
    return ids.join(found, name, "left").withColumn(to, F.coalesce("_component", name)).drop("_component")


def more_components(comps: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """What components() gives for the edges of ``comps`` and ``edges`` together: only the components that ``edges`` unite are labelled anew."""
    for side in "ab":
        edges = with_component(edges, comps, side, f"c_{side}")
    between = edges.where("c_a != c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    new = scratch.write(components(between, scratch), "united")
    every = comps.unionByName(new.select("id", F.col("id").alias("component"))).distinct()
    moved = new.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return every.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
