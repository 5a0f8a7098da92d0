"""Tables that outlast a session, found again by what they were made from.

A table's folder is named after its content: the step, its parameters, the plans of the
tables it starts from, and every input file with its size and time of change. So a
second session finds what the first one wrote, and a changed input has another name.
A table counts once its marker is there, which is written last and holds the schema;
a folder without one is a build that did not end, and is built again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Changes when a step computes something else than before from the same input.
VERSION = "1"
_MARKER = "_stockloom.json"
_FIELDS = "spark.sql.debug.maxToStringFields"


def _plan(df: DataFrame) -> str:
    """The analyzed plan in full, without the numbers that a session gives its columns."""
    conf = df.sparkSession.conf
    before = conf.get(_FIELDS)
    conf.set(_FIELDS, 100_000)
    try:
        return re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    finally:
        conf.set(_FIELDS, before)


def _files(df: DataFrame) -> str | None:
    """A digest of all input files: path, size and time of change; None if there are none.

    The files are listed by Spark and not opened. The digest does not depend on their order.
    """
    files = df.inputFiles()
    if not files:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    found = listed.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(k), *listed.columns).cast("decimal(38,0)")).alias(f"sum{k}") for k in range(2)]
    ).first()
    return f"{found.n} {found.sum0} {found.sum1}"


class Store:
    """A shared folder of such tables. Nothing in it is deleted by ``release``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def name_of(self, step: str, sources: list[DataFrame], parameters: dict) -> str | None:
        """The folder of a table; None if a source has no files, so that no change could be seen."""
        files = [_files(df) for df in sources]
        if None in files:
            return None
        about = [VERSION, self.spark.version, step, sorted(parameters.items()), [_plan(df) for df in sources], files]
        return f"{self.folder}/{step}-{hashlib.sha256(json.dumps(about).encode()).hexdigest()}"

    def table(self, path: str | None, build: Callable[[], DataFrame], kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The table at ``path``, built and written if it is not there; without a path ``kept``."""
        if path is None:
            return kept(build())
        marker = self.read(f"{path}/{_MARKER}")
        if marker is None:
            df = build()
            df.write.mode("overwrite").parquet(path)
            self.write(f"{path}/{_MARKER}", df.schema.json())
            schema = df.schema
        else:
            schema = StructType.fromJson(json.loads(marker))
        return self.spark.read.schema(schema).parquet(path)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        at, system = self._at(path)
        return system.exists(at)

    def read(self, path: str) -> str | None:
        """A small text file, if it is there."""
        at, system = self._at(path)
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A small text file that is there as a whole or not at all; one that is there is replaced."""
        at, system = self._at(path)
        beside, _ = self._at(f"{path}.{hashlib.sha256(text.encode()).hexdigest()[:8]}.new")
        stream = system.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # A rename does not replace a file. Between the two the file is missing, which is safe.
        system.delete(at, False)
        if not system.rename(beside, at):
            raise OSError(f"could not write {path}")
