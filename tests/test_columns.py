import random

from pyspark.sql import functions as F

from barflow.functions import columns as N
from barflow.operators import learn
from barflow.sources import tables as A


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_scalars(spark):
    d = lambda x: F.lit(x).cast("double")
    assert [one(spark, N.clamp(d(x))) for x in (-1.0, 0.5, 2.0, None)] == [0.0, 0.5, 1.0, None]
    assert [one(spark, N.finite_positive(d(x))) for x in (1.0, 0.0, float("inf"), float("nan"), None)] == [True, False, False, False, False]
    assert one(spark, N.month_key(F.lit(1_704_067_199_999))) == "2023-12" and one(spark, N.add_months(F.lit("2023-11"), 3)) == "2024-02"
    assert one(spark, N.date_end_ms(F.lit("2024-01-01").cast("date"))) - one(spark, N.date_start_ms(F.lit("2024-01-01").cast("date"))) == 86_400_000
    assert [one(spark, N.is_fill(F.lit(x))) for x in (" EXT_A_fill", "native", None)] == [True, False, False]
    assert [one(spark, N.twelve_digits(d(x))) for x in (0.1, 100.0, 1234567.891, 0.0)] == ["0.1", "100", "1234567.891", "0"]
    assert str(one(spark, N.parse_utc(F.lit("2024-01-01T00:00:00")))) == str(one(spark, N.parse_utc(F.lit("2024-01-01T01:00:00+01:00"))))
    assert one(spark, N.parse_utc(F.lit("no time"))) is None


def test_tick_csv_scan_and_report(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1.5,10,2\nbad,x\n2.25,NaN,1\n3\n4.0,5,1\n")
    rows = A.tick_csv_scan(spark, str(tmp_path / "t.csv"), start_ms=0, end_ms=4000).collect()
    assert [(r.ts_ms, r.price) for r in rows] == [(1500, 10.0)]
    A.write_report(spark.createDataFrame([(1, "a")], "v int, k string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().k == "a"


def test_refit_skips_short_symbols(spark):
    r = random.Random(1)
    rows = [(s, float(y), y, 1.0) for s, n in (("A", 60), ("B", 5)) for _ in range(n) for y in (r.randrange(2),)]
    df = spark.createDataFrame(rows, "symbol string, x double, y int, w double")
    models = learn.refit(df, ["x"], weight="w", trees=2, min_rows=20, symbols=["A", "B"])
    assert set(models) == {None, "A"}
    scored = learn.predict(models["A"], df, ["x"]).collect()
    assert all((s.probability > 0.5) == (s.y == 1) for s in scored)
