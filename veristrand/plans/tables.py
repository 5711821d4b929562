"""Parquet folders under one root."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def read(self, *parts: str, schema: str | StructType | None = None, base: tuple[str, ...] = ()) -> DataFrame:
        """An empty frame of ``schema`` stands in for a table nobody wrote yet.

        ``base`` is the table's folder where ``parts`` names some of its partitions by a pattern.
        """
        try:
            reader = self.spark.read.option("basePath", self.path(*base)) if base else self.spark.read
            return (reader.schema(schema) if schema else reader).parquet(self.path(*parts))
        except AnalysisException as error:
            if schema and error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def write(self, frame: DataFrame, *parts: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
        writer = frame.write.mode(mode)
        (writer.partitionBy(*by) if by else writer).parquet(self.path(*parts))

    def remove(self, *parts: str) -> None:
        """Delete an intermediate folder of this store."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(*parts))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def claim(self, text: str, *parts: str) -> bool:
        """Create a file with that text unless there is one of its name; of several writers one succeeds.

        The text is written aside first and then gets its name in one step that fails if the name is
        taken, so nobody reads half a file: a hard link on a local disk, elsewhere a rename without overwriting.
        """
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        target = path(self.path(*parts))
        aside = path(self.path(*parts[:-1], f"_{uuid.uuid4().hex}"))
        system = target.getFileSystem(conf)
        out = system.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if system.getScheme() == "file":
                os.link(*(path.getPathWithoutSchemeAndAuthority(p).toString() for p in (aside, target)))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, none)
            return True
        except (FileExistsError, Py4JJavaError):
            if not system.exists(target):
                raise
            return False
        finally:
            system.delete(aside, False)

    def lines(self, *parts: str, schema: str) -> DataFrame:
        """The JSON lines of a folder of claimed files; empty before the first."""
        try:
            return self.spark.read.schema(schema).json(self.path(*parts))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def append_row(self, row: dict, schema: str, *parts: str) -> None:
        self.write(self.spark.createDataFrame([row], schema).coalesce(1), *parts, mode="append")

    def write_sequenced(self, frame: DataFrame, order: list[Column], start: int, *parts: str) -> None:
        """Write rows with dense ``sequence`` numbers in ``order``, starting after ``start``.

        The rows are first written in sorted files. A row's number is then its
        place in its file plus the rows of the files before it, so one count per
        file is all that meets in one place.
        """
        staged = self.path("staged", *parts)
        frame.orderBy(*order).write.mode("overwrite").parquet(staged)
        rows = self.spark.read.schema(frame.schema).parquet(staged).select(
            "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
            "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        numbered = rows.join(starts, "_file").select(
            (F.lit(start) + F.col("_before") + F.col("_row") + 1).cast("bigint").alias("sequence"), *frame.columns)
        self.write(numbered, *parts, mode="overwrite")
        self.remove("staged", *parts)
