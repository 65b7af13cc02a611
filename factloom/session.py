"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: str | int = "*", app: str = "factloom", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark share."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can read.

    Where it is unset and the master is one process, as in tests, a new local folder takes its place. On a cluster that
    would be another folder on every machine, so there it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark, "_factloom_scratch", None)
        if root is None:
            root = spark._factloom_scratch = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker, or are decoded from Parquet, at once. Texts can be long: with Spark's 10,000 and 4,096 a
#: batch of them may not fit.
BATCH_ROWS = 512
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, no more than so many rows are in a batch of Arrow or Parquet."""
    old = {name: spark.conf.get(name) for name in _BATCHES}
    for name, value in old.items():
        spark.conf.set(name, str(min(rows, int(value)) if int(value) > 0 else rows))
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def python_tasks(spark: SparkSession) -> int:
    """Partitions for rows that Python works on: several for a core. Few bytes can be much work there, so neither the size of a
    file's parts nor that of a shuffle says how many tasks it needs."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df over python_tasks() partitions by its key; a number that is given isn't lowered by adaptive execution."""
    return df.repartition(python_tasks(df.sparkSession), *key)


#: Rows of a batch that goes back from Python.
_BACK_ROWS = 4_096


def map_groups(df: DataFrame, key: str, order: list[str], solve: Callable[[dict], Callable[[object, Iterator[tuple]], Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows that a function of (key, rows) makes of every group of df, its rows as tuples without the key, in order.

    ``solve`` makes that function in each task, from an empty dictionary of the task's own. Groups are dealt over
    python_tasks() partitions and stream through them: a task holds a batch and what the function keeps, and a group costs no frame of its own.
    """
    columns, arrow = [c for c in df.columns if c != key], to_arrow_schema(StructType.fromDDL(schema))

    def back(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out = solve({}), []
        flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, group in itertools.groupby(flat, lambda r: r[0]):
            for row in one(name, (r[1:] for r in group)):
                out.append(row)
                if len(out) == _BACK_ROWS:
                    yield back(out)
                    out = []
        if out:
            yield back(out)

    return dealt(df.select(key, *columns), key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def materialize(df: DataFrame, name: str, *, count: bool = False, narrow: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    With ``count`` the rows are counted while they are written (see rows()). ``narrow`` rows hold no texts of documents, so that
    batches of the usual size fit.
    """
    path, seen = scratch_path(df.sparkSession, name), Observation()
    with contextlib.nullcontext() if narrow else small_batches(df.sparkSession):
        (df.observe(seen, F.count(F.lit(1)).alias("n")) if count else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    if count:
        out._factloom_rows = seen.get.get("n", 0)
    return out


def rows(df: DataFrame) -> int:
    """Rows of a written table, as counted while it was written: no fewer than it has (a task that ran twice may count twice),
    and none if it has none."""
    found = getattr(df, "_factloom_rows", None)
    return df.count() if found is None else found


def once(df: DataFrame, name: str, *, count: bool = False) -> DataFrame:
    """df as a written table, for loops that read it in every round; what is one already stays as it is."""
    return df if hasattr(df, "_factloom_path") else materialize(df, name, count=count)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_factloom_path", None):
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
