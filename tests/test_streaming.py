import datetime

from filemason.catalog import views
from filemason.operators import usage
from filemason.plans import rules as R
from filemason.streaming import incremental

SF = "/root/testdata/sf0.001"


def drain(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_rules_on_a_stream(spark, tmp_path):
    files = views.files(spark, SF).drop("text")
    files.write.parquet(str(tmp_path / "in"))
    stream = incremental.stream_table(spark, str(tmp_path / "in"), files.schema)
    rules = R.default_rules(views.as_of())
    got = drain(incremental.classify_stream(stream, rules).select("seq", "target_path"), "classified")
    wanted = R.classify(files, rules).select("seq", "target_path")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_daily_costs_on_a_stream(spark, tmp_path):
    calls = views.usage(spark, SF)
    calls.write.parquet(str(tmp_path / "in"))
    stream = incremental.stream_table(spark, str(tmp_path / "in"), calls.schema)
    got = {r["day"]: round(r["cost_usd"], 8) for r in drain(incremental.daily_costs_stream(stream), "daily", "complete").collect()}
    wanted = usage.daily_costs(usage.with_cost(calls), views.usage_as_of(), 10000).collect()
    assert got == {r["day"]: round(r["cost_usd"], 8) for r in wanted}
    assert datetime.date(2024, 1, 1) in got
