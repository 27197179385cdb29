"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import apply_defaults, checkpoint_dir

#: A word is a run of characters other than space, tab, \n, \v, \f and \r.
SPACES = "[\\x20\\x09-\\x0D]+"


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults; once per application: name the checkpoint folder and send this package to the Python workers."""
    apply_defaults(spark)
    checkpoint_dir(spark)
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="sitelens-py-"), "sitelens_pkg.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words of a non-null text, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    prepare(spark)
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage with a copy that every executor can read again.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(big: DataFrame, small: DataFrame, on: Iterable[str], spread: Column,
                how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join whose hot keys are split into ``salts`` parts.

    ``spread`` is any well mixed column of ``big``; ``small`` (one row per key)
    is repeated once per salt.
    """
    a = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "__salt"], how).drop("__salt")
