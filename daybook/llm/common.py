"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.session import checkpointed, shared_folder

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="daybook-package-")  # the driver serves the file from here
    name = os.path.basename(package)
    shutil.copytree(package, f"{folder}/copy/{name}", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", f"{folder}/copy", name))
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; a folder of our own only in local tests without one."""
    shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: the lineage ends there and a lost executor loses nothing."""
    return checkpointed(df)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count proves the bound; beyond it the planner joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str | Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as the empty string."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % m


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: A key is hot when it holds more than this share of the rows; fewer keys than this can be hot.
HOT_SHARE = 4096


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``many`` to ``one``, whose keys are unique, with no task holding a hot key.

    Keys with more than 1 in ``HOT_SHARE`` of the rows of ``many`` number fewer than ``HOT_SHARE``, so
    their rows of ``one`` are broadcast under that bound and their rows of ``many`` stay where they are; all other
    keys meet in a shuffle join, where none is large.  Keys are not null; ``how`` is "inner", "left" or
    "left_anti".  ``many`` is read more than once, so it should be checkpointed or stored.
    """
    total = many.count()
    hot = cut(many.groupBy(*keys).count().where(F.col("count") * HOT_SHARE > total).select(*keys))
    few = F.broadcast(one.join(F.broadcast(hot), keys, "left_semi"))
    there = many.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how)
    return there.unionByName(many.join(F.broadcast(hot), keys, "left_anti").join(one, keys, how))
