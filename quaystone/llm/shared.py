"""Where jobs keep intermediate tables, and reading the given ones."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (driver and executor are one process)
    gets a temporary folder as its own setting; a cluster has no folder to
    guess, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc(column) -> F.Column:
    """crc32 of a column's text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def applied(docs: DataFrame, keep: list[str], function, fields: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns of ``docs``, then ``fields`` (as in a schema), which ``function`` gives for ``text``.

    ``function`` turns an iterator of Arrow string arrays into one of lists of
    arrays, one array a field.  Only the text goes to Python and only the
    fields come back; all other columns stay with Spark.  A kept column named
    like a field gives way to it.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for columns in function(texts):
            yield pa.StructArray.from_arrays(columns, names=names)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kept = [c for c in keep if c not in names]
    result = max(docs.columns, key=len, default="") + "_result"
    made = docs.select(*[F.col(quoted(c)) for c in kept], F.arrow_udf(run, fields)(F.col(quoted(text))).alias(result))
    return made.select(*[F.col(quoted(c)) for c in kept], *[F.col(quoted(result))[n].alias(n) for n in names])


def released() -> None:
    """Give memory that Python no longer uses back to the system, for the executor's other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
