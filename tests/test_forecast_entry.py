import os
import tempfile

from pyspark.sql import functions as F

from panelcast.operators import forecast, predict


def test_attach_average_blend_compare(spark):
    tmpl = spark.createDataFrame([("sj", 1990, 18, 0, 0), ("sj", 1990, 19, 0, 1), ("iq", 2000, 26, 0, 2)], "city string, year int, weekofyear int, total_cases int, ord int")
    pred = spark.createDataFrame([("sj", 1990, 18, -1.7), ("iq", 2000, 26, 20.9)], "city string, year int, weekofyear int, y_pred double")
    a = {(r.city, r.weekofyear): r.total_cases for r in forecast.attach(tmpl, pred, ["city", "year", "weekofyear"], order="ord").collect()}
    assert a == {("sj", 18): -1, ("sj", 19): None, ("iq", 26): 20}
    runs = spark.createDataFrame([(0, "sj", 1, 10.0), (1, "sj", 1, 13.0), (2, "sj", 1, 13.5)], "run_id int, city string, wk int, total_cases double")
    avg = forecast.average_runs(runs, ["city", "wk"]).collect()[0]
    assert avg.total_cases == 12 and avg.runs == 3
    x = spark.createDataFrame([("sj", 1, 10.0), ("iq", 1, 4.0)], "city string, wk int, v double")
    y = spark.createDataFrame([("sj", 1, 20.0), ("iq", 1, 8.0)], "city string, wk int, v double")
    w = spark.createDataFrame([("iq", 1.0)], "city string, weight double")
    b = {r.city: r.v for r in forecast.blend(x, y, ["city", "wk"], "v", weights=w, weight_key=["city"]).collect()}
    assert b == {"sj": 15, "iq": 4}
    c = forecast.compare(x, y, ["city", "wk"], "v").filter("city = 'sj'").collect()[0]
    assert c.delta == 10.0


def test_runs_roundtrip_csv(spark):
    d = tempfile.mkdtemp(prefix="runs-", dir=os.environ.get("TMPDIR", "/tmp"))
    runs = spark.createDataFrame([(k, "sj", 1990, 18, 10 + k) for k in range(3)], "run_id int, city string, year int, weekofyear int, total_cases int")
    forecast.write_runs(runs, f"{d}/out")
    back = forecast.read_runs(spark, f"{d}/out", "city string, year int, weekofyear int, total_cases int, run_id int")
    assert sorted(r.run_id for r in back.collect()) == [0, 1, 2]
    assert forecast.average_runs(back, ["city", "year", "weekofyear"]).collect()[0].total_cases == 11
    # SO3: one ordered file
    forecast.write_single(runs.drop("run_id").withColumn("ord", F.lit(3) - F.col("total_cases")), f"{d}/single", ["ord"])
    files = [f for f in os.listdir(f"{d}/single") if f.endswith(".csv")]
    assert len(files) == 1
    lines = open(f"{d}/single/{files[0]}").read().strip().split("\n")
    assert lines[0].startswith("city") and [ln.split(",")[3] for ln in lines[1:]] == ["12", "11", "10"]


def test_ensemble(spark):
    pr = spark.createDataFrame([("a", 1, "m1", 1.0), ("a", 1, "m2", 3.0), ("a", 2, "m1", None), ("a", 2, "m2", 5.0)], "k string, t int, model string, y_pred double")
    e = {r.t: r.y_pred for r in predict.ensemble(pr, ["k", "t"]).filter(F.col("model") == "Ensamble").collect()}
    assert e == {1: 2.0, 2: 5.0}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and {"model", "mae", "r2"} <= set(df.columns)
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
