"""JSON documents, line logs and folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_corrupt_record"


def _folder(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    system, own = _folder(spark, path)
    return system.exists(own)


def _schema(spark: SparkSession, schema: str | T.StructType) -> T.StructType:
    return spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType, many_lines: bool = True) -> DataFrame:
    """JSON objects, one a file (or arrays of them) or one a line, under a pinned schema, plus ``_corrupt_record``.

    A document that can't be read has its text there and nulls elsewhere. A path that isn't there
    is an empty table.
    """
    own = _schema(spark, schema)
    whole = T.StructType([*own.fields, T.StructField(BROKEN, T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("multiLine", many_lines).option("recursiveFileLookup", True).json(path)


def good(documents: DataFrame) -> DataFrame:
    """The documents that could be read."""
    return documents.where(F.col(BROKEN).isNull()).drop(BROKEN)


def broken(documents: DataFrame) -> DataFrame:
    """(file, text) of the documents that could not be read."""
    # a query must ask for a field besides the broken text, or the fields aren't parsed
    parsed = F.length(F.coalesce(F.col(documents.columns[0]).cast("string"), F.lit(""))) >= 0
    return documents.where(F.col(BROKEN).isNotNull() & parsed).select(F.col("_metadata.file_path").alias("file"), F.col(BROKEN).alias("text"))


def write_documents(df: DataFrame, path: str) -> None:
    """Replaces what is at the path."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def tail_log(spark: SparkSession, path: str, schema: str | T.StructType, order: str, n: int = 50) -> DataFrame:
    """The n newest rows of a log; without a log none."""
    return good(read_documents(spark, path, schema, many_lines=False)).orderBy(F.col(order).desc()).limit(n)


def rotate_log(spark: SparkSession, path: str, day: str) -> str | None:
    """Moves a log aside under a day's name and returns where to; nothing where there is none. Rows of a further rotation on one day join the first's."""
    system, own = _folder(spark, path)
    if not system.exists(own):
        return None
    aside = f"{path.rstrip('/')}-{day}.bak"
    _, to = _folder(spark, aside)
    if not system.exists(to):
        system.rename(own, to)
        return aside
    for status in system.listStatus(own):
        if not status.getPath().getName().startswith(("_", ".")):
            _, one = _folder(spark, f"{aside}/{status.getPath().getName()}")
            system.rename(status.getPath(), one)
    system.delete(own, True)
    return aside


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, size, modified) of the files below a folder whose name fits a glob; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def grep_files(spark: SparkSession, path: str, pattern: str, glob: str = "*", most: int = 50) -> DataFrame:
    """(file) of up to ``most`` files, in order of their names, with a line that has the pattern (a regular expression)."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    hits = lines.where(F.col("value").rlike(pattern)).select(F.col("_metadata.file_path").alias("file"))
    return hits.distinct().orderBy("file").limit(most)


def valid_or(column: Column, allowed: list[str]) -> Column:
    """The value if it is allowed, else null."""
    return F.when(column.isin(*allowed), column)
