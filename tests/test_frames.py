import pandas as pd
import pytest
from conftest import random_bars
from pyspark.sql import functions as F

from tickweave.operators.frames import block_of, dense_index, in_frames, index_bars, running


def test_positions_across_slices_and_series(spark):
    pdf = pd.concat([random_bars(137, 1, "A"), random_bars(53, 2, "B")])
    pdf = pdf[~pdf["ts"].dt.hour.isin([3, 4])]
    got = index_bars(spark.createDataFrame(pdf.drop(columns="ix").sample(frac=1, random_state=1)), slice_rows=10).toPandas()
    for _, g in got.groupby("symbol"):
        g = g.sort_values("ts")
        assert list(g["ix"]) == list(range(len(g)))


@pytest.mark.parametrize("rows", [7, 16, 1000])
def test_bounded_windows_do_not_depend_on_the_block_size(spark, rows):
    pdf = random_bars(100)

    def build(df, w):
        return df.withColumns({
            "back": F.sum("close").over(w.rowsBetween(-5, 0)), "ahead": F.lead("close", 3).over(w), "lagged": F.lag("close", 6).over(w),
        })

    got = in_frames(spark.createDataFrame(pdf), build, before=6, after=3, rows=rows).toPandas().sort_values("ix").reset_index(drop=True)
    assert len(got) == 100
    pd.testing.assert_series_equal(got["back"], pdf["close"].rolling(6, min_periods=1).sum(), check_names=False)
    pd.testing.assert_series_equal(got["ahead"], pdf["close"].shift(-3), check_names=False)
    pd.testing.assert_series_equal(got["lagged"], pdf["close"].shift(6), check_names=False)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_values_carry_over_blocks(spark, reverse, exclusive):
    pdf = random_bars(60)
    pdf["mark"] = pdf["close"].where(pdf["ix"] % 17 == 3)
    specs = {"total": ("sum", F.col("close")), "top": ("max", F.col("close")), "low_": ("min", F.col("close")), "seen": ("last", F.col("mark"))}
    src = spark.createDataFrame(pdf).withColumn("mark", F.when(~F.isnan("mark"), F.col("mark")))
    got = running(src, specs, ["ix"], block_of(rows=8), reverse=reverse, exclusive=exclusive)
    got = got.toPandas().sort_values("ix").reset_index(drop=True)
    ref = pdf.iloc[::-1] if reverse else pdf
    want = pd.DataFrame({
        "total": ref["close"].cumsum(), "top": ref["close"].cummax(), "low_": ref["close"].cummin(), "seen": ref["mark"].ffill(),
    })
    want = (want.shift(1) if exclusive else want).sort_index()
    pd.testing.assert_frame_equal(got[list(want)], want, check_names=False)


def test_dense_index_with_string_slices(spark):
    df = spark.createDataFrame([("a", i, i // 4) for i in range(20)], "k string, v int, s int")
    got = dense_index(df, ["k"], ["v"], F.col("s"), out="no").collect()
    assert all(r["no"] == r["v"] for r in got)
