"""Streams over the same order give what the batch operators give."""

import pytest

from fathom.operators import rolling
from fathom.streaming import streaming_transfer_estimates, streaming_volatility


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"E{i % 2}", "C", 1.0 + (i * 37 % 11) / 100) for i in range(60)]
    ticks = spark.createDataFrame(rows, "seq long, exchange string, coin string, price double")
    for k, part in enumerate((ticks.where("seq < 20"), ticks.where("seq BETWEEN 20 AND 44"), ticks.where("seq > 44"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in", mode="append" if k else "overwrite")
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name)

    got = {r.seq: r.volatility for r in run(streaming_volatility(source, 10), "vol").collect()}
    expected = {r.seq: r.volatility for r in rolling.rolling_volatility(ticks, 10).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    times = run(streaming_transfer_estimates(source.withColumnRenamed("price", "actual_time"), window=10, keys=["exchange", "coin"]), "est")
    batch = rolling.transfer_estimates(ticks.withColumnRenamed("price", "actual_time"), window=10, keys=["exchange", "coin"]).collect()
    last = {r.exchange: r.estimated_time for r in times.where("seq >= 58").collect()}
    assert last == {r.exchange: pytest.approx(r.estimated_time) for r in batch}
