"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_serial = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact spelling and position.

    Other columns may have any names, even ones that differ from these only in
    case or that an operator uses inside; the first column of a name counts.
    """
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


def documents_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with a null text read as an empty one, and an id that is no number as a null one."""
    out = pick(df, key, text)
    return out.select(F.col(key).try_cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Views of the batches of at most so many rows, so that only few texts are copied at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str | T.StructType, rows: int = 512) -> DataFrame:
    """Run fn over Arrow batches of at most so many rows: a dict of Python lists in, a dict of lists or arrays out."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where that is unset and Spark runs on this machine alone, as in tests, a
    folder under the warehouse is set in its place; a cluster must name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return sc._jsc.sc().getCheckpointDir().get()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it's sorted and merged, never gathered in the driver to be broadcast."""
    return df.hint("merge")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: df's rows, written once to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df's rows as a Parquet table in the shared folder: columnar, so later reads can prune."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{next(_serial)}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table from stored() that is no longer needed."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
