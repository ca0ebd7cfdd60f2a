"""Encoders and intake."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from cinderlode.functions import encode as N
from cinderlode.operators import intake as I


def test_word_pieces(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(["[PAD]"] * 100 + ["[UNK]", "[CLS]", "[SEP]", "list", "##s", "file", ",", "a"]))
    df = spark.createDataFrame([("Lists, FILE zzz",), (None,), ("a " * 600,)], "t string")
    got = [r[0] for r in df.select(N.word_pieces(F.col("t"), str(path))).collect()]
    assert got[0] == [101, 103, 104, 106, 105, 100, 102] and got[1] == [101, 102] and len(got[2]) == 512 and got[2][-1] == 107


def test_pooling_and_encoder(spark):
    x = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]])
    assert np.allclose(N.pooled(x, np.array([[1, 1, 0]])), [[0.6, 0.8]])
    df = spark.createDataFrame([("a", "list files"), ("b", "files list"), ("c", None)], "k string, t string")
    got = {r["key"]: r["embedding"] for r in N.embedded(df, "k", "t", N.hashing_encoder(32), 32).collect()}
    assert got["a"] == got["b"] and abs(sum(v * v for v in got["a"]) - 1) < 1e-5 and not any(got["c"])
    assert rows(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(N.unit(F.col("v"))))[1][0] == pytest.approx([0.6, 0.8])


def test_intake(spark):
    have = spark.createDataFrame([("a", "x"), ("b", "y")], "cmd_path string, description string")
    apps = spark.createDataFrame([("p", " "), ("q", "{}")], "app_id string, install_instructions string")
    both, filled = I.probe_imported(have, apps, spark.createDataFrame([("a", "other"), ("c", "z")], "cmd_path string, description string"), spark.createDataFrame([("p", "new"), ("q", "new")], "app_id string, install_instructions string"))
    assert rows(both) == [("a", "x"), ("b", "y"), ("c", "z")] and rows(filled) == [("p", "new"), ("q", "{}")] and I.lookup(have, "b").count() == 1
    bad = spark.createDataFrame([("1", 5, 5), ("2", 6, 7)], "version string, full_time int, delta_time int")
    assert rows(I.release_index(spark.createDataFrame([("1", 5, 5)], bad.schema))) == [("1", 5)]
    with pytest.raises(Exception, match="release times differ"):
        I.release_index(bad).collect()
    assert [r["blocked"] for r in I.gated(spark.createDataFrame([("Dangerous ",), ("safe",)], "risk_level string")).collect()] == [True, False]
