import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from cinderlode.core import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"
TABLES = ["apps", "arguments", "arguments_raw", "commands_vec", "apps_snap", "arguments_snap", "documents", "eval_items", "mix_targets", "piece_limits"]


def variant(spark, folder, change):
    """The small test tables with a change made to each, as a folder of tables."""
    for name in TABLES:
        change(name, spark.read.parquet(f"{SF}/{name}.parquet")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return variant(spark, tmp_path_factory.mktemp("empty"), lambda n, df: df.limit(0))


#: Names that operators use inside, as further columns of another type.
CLASHING = ["key", "text_a", "h", "id", "n", "k", "t", "s", "e", "part", "chunk", "snap", "digest", "sim", "rank", "state", "tokens", "u", "v", "w", "grp", "field", "record", "value", "tier", "code", "slice", "band", "word_", "cells", "size", "reason", "cut", "share", "begin", "passes", "at", "posterior"]


@pytest.fixture(scope="session")
def clashing(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    return variant(spark, tmp_path_factory.mktemp("clash"), lambda n, df: df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in df.columns)))


@pytest.fixture(scope="session")
def repeated(spark, tmp_path_factory):
    """Every row twice, and rows that are null in every column."""
    from pyspark.sql import functions as F

    def change(name, df):
        if name in ("mix_targets", "piece_limits", "eval_items"):
            return df
        nulls = df.limit(3).select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
        return df.unionByName(df).unionByName(nulls)

    return variant(spark, tmp_path_factory.mktemp("repeated"), change)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)
