import pytest
from pyspark.sql import functions as F

from tracklake.functions import sound, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, out",
    [("Café Tacvba — Súper Éxitos! 🔥", "cafe tacvba super exitos"), ("R&B & soul", "r and b and soul"), ("", ""), ("ＦＵＬＬ　ｗｉｄｔｈ", "full width"), ("🔥", ""), ("don't", "don't"), (None, None)],
)
def test_normalize(spark, raw, out):
    assert one(spark, text.normalize(F.col("s")), s=raw) == out


@pytest.mark.parametrize("raw, out", [("90s hits", ["1990s"]), ("the 00s", ["2000s"]), ("70s/80s and more 70s", ["1970s", "1980s"]), ("2016 jams", ["2010s"]), ("30s", []), ("1980's", ["1980s"]), ("1949 2030", [])])
def test_decades(spark, raw, out):
    assert one(spark, text.decade_tags(F.col("s")), s=raw) == out


def test_tokens(spark):
    assert one(spark, text.tokenize(F.col("s")), s="My Rainy Day study mix 2015") == ["2010s", "rainy", "day", "study", "my rainy", "rainy day", "day study", "study mix", "mix 2015"]
    assert one(spark, text.tokenize(F.col("s")), s="the of 12 34") == ["of 12"]
    assert one(spark, text.tokenize(F.col("s")), s="") == [] and one(spark, text.title_tokens(F.col("s")), s=None) == []


@pytest.mark.parametrize("key, mode, label", [(0, 1, "8B"), (9, 0, "8A"), (7, 1, "9B"), (4, 1, "12B"), (11, 1, "1B"), (99, 1, None), (None, 1, None), (3, None, None)])
def test_wheel(spark, key, mode, label):
    df = spark.createDataFrame([(key, mode)], "k int, m int")
    assert df.select(sound.wheel_label(F.col("k"), F.col("m"))).first()[0] == label


def test_distances(spark):
    df = spark.createDataFrame([(0, 1, 9, 0, 120.0, 60.0), (0, 1, 0, 1, 120.0, None), (0, 1, 7, 1, 100.0, 140.0), (0, 1, 6, 1, 100.0, 150.0), (0, 1, 2, 1, 0.0, 400.0), (None, 1, 2, 1, 1.0, 1.0)], "a int, b int, c int, d int, x double, y double")
    got = [tuple(r) for r in df.select(sound.key_distance(*map(F.col, "abcd")), sound.tempo_distance(F.col("x"), F.col("y"))).collect()]
    assert got == [(0.15, 0.0), (0.0, 0.3), (0.2, 1.0), (1.0, 1.25), (0.55, 1.5), (0.35, 0.0)]


@pytest.mark.parametrize("curve, want", [("build", [0.25, 0.375, 0.5, 0.625, 0.75]), ("wind_down", [0.75, 0.625, 0.5, 0.375, 0.25]), ("peak_mid", [0.25, 0.5, 0.75, 0.5, 0.25]), ("steady", [0.5] * 5)])
def test_curves(spark, curve, want):
    df = spark.createDataFrame([(i / 4,) for i in range(5)], "t double")
    assert [r[0] for r in df.select(sound.curve_target(F.lit(curve), F.col("t"), F.lit(0.5), 0.25)).collect()] == pytest.approx(want)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(sound.unit(F.col("v"))).collect()] == [[0.6, 0.8], None, None]
    hot = spark.createDataFrame([(2,), (None,), (12,)], "k int").select(sound.one_hot_key(F.col("k"))).collect()
    assert [sum(r[0]) for r in hot] == [1, 0, 0] and hot[0][0][2] == 1
