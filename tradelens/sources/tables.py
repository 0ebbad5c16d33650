"""Captured tables: Parquet by name. A source that no table was captured for is unconfigured, which is not the same as empty."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextvars import ContextVar
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The captured table; a missing one raises (see source() for sources that may be missing)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source(spark: SparkSession, folder: str, name: str, schema: str) -> tuple[DataFrame, str]:
    """The table with its state: captured, or unconfigured with no rows where nothing was captured under this name."""
    try:
        return table(spark, folder, name), "captured"
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema), "unconfigured"


def configured(spark: SparkSession, folder: str, names: list[str], schema: str) -> list[tuple[str, DataFrame]]:
    """The sources that were captured, in the order given; the others are left out."""
    found = [(n, *source(spark, folder, n, schema)) for n in names]
    return [(n, df) for n, df, state in found if state == "captured"]


#: Rows of a spread table in a task, and rows that a task sorts to join them: a shuffle to more than 200 tasks
#: (spark.shuffle.sort.bypassMergeThreshold) holds a file's share in memory, or spills it, so they are no more than need be.
SPREAD = 10_000
SORTED = 1_500_000


def tasks_for(df: DataFrame, rows: int = SPREAD) -> int:
    """How many tasks of about so many rows df makes, at least as many as run at once."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int = SPREAD) -> DataFrame:
    """df dealt to tasks of about so many rows, for rows that much follows from: a small file is one task else, however many
    rows and pages its keys stand for."""
    return df.repartition(tasks_for(df, rows))


def synthesised(spark: SparkSession, folder: str, sql: str, names: tuple[str, ...], dealt: bool = False, by: dict[str, str] | None = None) -> DataFrame:
    """A SELECT over tables named in braces; dealt: of tables that are spread over tasks. by: the key that each is joined by,
    the largest table first; they are dealt by it to tasks that sort about SORTED of its rows, so that memory holds them
    however large the tables are."""
    from_file = {n: table(spark, folder, n) for n in names}
    if by:
        tasks = tasks_for(from_file[next(iter(by))], SORTED)
        return spark.sql(sql, **{n: df.repartition(tasks, by[n]) for n, df in from_file.items()})
    return spark.sql(sql, **{n: spread(df) if dealt else df for n, df in from_file.items()})


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and comments (#) go."""
    lines = spark.read.text(path)
    return lines.selectExpr("trim(value) as url").where("url <> '' and not url like '#%'")


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """suffix, kind (rule, wildcard, exception) from a file of public suffixes: one rule a line, comments (//) go."""
    rule = F.regexp_extract("value", r"^\s*(\S+)", 1)
    lines = spark.read.text(path).select(F.lower(rule).alias("r")).where("r <> '' and not startswith(r, '//')")
    kind = F.when(F.col("r").startswith("!"), "exception").when(F.col("r").startswith("*."), "wildcard").otherwise("rule")
    return lines.select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind")).distinct()


#: Folders that the verb at work has written; those outside of any verb are results and go when the process ends.
_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)
_results: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_results() -> None:
    for spark, path in _results:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001, PERF203 - the session may be gone by now
            return


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names and all executors share. One without a scheme is of Hadoop's
    default filesystem. What a verb (see scoped) puts there goes when it is done."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tradelens-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{tag}-{uuid.uuid4().hex}"
    if (own := _scope.get()) is not None:
        own.append(path)
    else:
        if not _results:
            atexit.register(_remove_results)
        _results.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: df as a table below the shared folder."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scoped(verb):
    """A verb over DataFrames whose result is a table; the tables it wrote on its way are deleted."""

    @wraps(verb)
    def run(*args, **options) -> DataFrame:
        own: list[str] = []
        mark = _scope.set(own)
        spark = next(a for a in (*args, *options.values()) if isinstance(a, DataFrame)).sparkSession
        try:
            out = verb(*args, **options)
            _scope.reset(mark)
            mark = None
            return written(out, verb.__name__)
        finally:
            if mark is not None:
                _scope.reset(mark)
            for path in own:
                remove(spark, path)

    return run
