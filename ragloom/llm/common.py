"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.common import checkpoint  # noqa: F401 - general helper, re-exported
from ragloom.session import checkpoint_base


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table exactly as stored: no repartitioning, so column pruning and file splits are Spark's own."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back: columns can be read one by one, and a
    lost executor costs no recomputation. The folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


HOT_SHARE = 1000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], n_col: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to one row per class (``n_col``: how many rows the class has, dropped). Classes with over a
    thousandth of all rows are at most a thousand: these are broadcast, so a class with a third of the rows isn't
    dealt to one task; the rest is an ordinary equi-join."""
    total = classes.agg(F.sum(n_col)).first()[0] or 0
    is_hot = F.col(n_col) > max(total // HOT_SHARE, 1)
    hot, rest = classes.filter(is_hot).drop(n_col), classes.filter(~is_hot).drop(n_col)
    hot_keys = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(hot_keys, keys, "left_anti").join(rest, keys, how))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable, so that a long array
    expression used several times (also inside nested lambdas) isn't computed anew for every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
