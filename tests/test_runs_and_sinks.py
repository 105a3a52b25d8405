"""Time limits, a local venue for fetches and streams, a sink with a failing attempt, nodes as streaming state, live volatility."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from test_market import market

from fathom import cli
from fathom.operators import graph
from fathom.plans import catalog, deadline
from fathom.sources import quotes, sheets
from fathom.streaming import changed_edges, streaming_prices, streaming_volatility

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def venue():
    """Answers in both venues' shapes; ?slow waits, ?many refuses."""
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.time(), self.path))
            if "slow" in self.path:
                time.sleep(2)
            self.send_response(429 if "many" in self.path else 200)
            self.end_headers()
            n = len(asked)
            body = {"error": [], "result": {"P": {"c": [str(1 + n % 7 / 100), "1"]}}} if "kraken" in self.path else {"data": {"rates": {"USD": str(1 + n % 5 / 100)}}}
            self.wfile.write(b"no json" if "broken" in self.path else json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def load(spark, base, path="", **options):
    spark.dataSource.register(quotes.QuoteSource)
    reader = spark.read.format("venue_quotes").option("address.kraken", f"{base}/kraken?{path}={{pair}}").option("address.coinbase", f"{base}/coinbase?{path}={{coin}}").option("pause", "0.05")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_fetch(spark, venue):
    base, asked = venue
    rows = load(spark, base).collect()
    assert {r.status for r in rows} == {quotes.OK} and {r.exchange for r in rows} == {"Kraken", "Coinbase"}
    assert len(quotes.parse_quotes(spark.createDataFrame(rows)).collect()) == len(rows)
    for path, status in (("many", quotes.LIMITED), ("broken", quotes.UNKNOWN)):
        assert {r.status for r in load(spark, base, path).collect()} == {status}
    assert {r.status for r in load(spark, base, "slow", venues="Kraken", timeout="0.2").collect()} == {quotes.TIMEOUT}
    assert {r.status for r in load(spark, "http://127.0.0.1:1").collect()} == {quotes.NETWORK}
    asked.clear()
    load(spark, base, venues="Kraken", pause="0.3").collect()
    times = [t for t, _ in asked]
    assert len(times) > 1 and min(b - a for a, b in zip(times, times[1:])) >= 0.29  # the venue's rate limit


def test_stream_of_polls(spark, venue, tmp_path):
    """Two runs from one checkpoint: poll numbers rise, none comes twice, and the rolling state goes on."""
    base, _ = venue
    spark.dataSource.register(quotes.QuoteSource)

    def run(seconds):
        source = spark.readStream.format("venue_quotes").option("every", "1").option("venues", "Kraken").option("pause", "0").option("address.kraken", f"{base}/kraken?{{pair}}").load()
        query = streaming_volatility(quotes.ticks_of(source), 10).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
        raw = source.writeStream.format("parquet").option("path", f"{tmp_path}/raw").option("checkpointLocation", f"{tmp_path}/at").start()
        del query
        deadline_ = time.time() + seconds
        while time.time() < deadline_:
            time.sleep(0.2)
        raw.stop()
        rows = spark.read.parquet(f"{tmp_path}/raw").collect()
        return Counter((r.poll, r.coin) for r in rows)

    first = run(8)
    second = run(8)
    assert first and set(second) > set(first) and max(second.values()) == 1
    assert {n for n in second if n in first} == set(first)


def test_ticks_of_stream_rows(spark, venue):
    base, _ = venue
    rows = load(spark, base).withColumn("poll", F.lit(7).cast("long"))
    ticks = quotes.ticks_of(rows).collect()
    assert ticks and {t.seq for t in ticks} == {7} and all(t.price > 0 for t in ticks)


def test_sheets(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 5).selectExpr("id", "concat('a,\"', id) AS text", "IF(id % 3 = 0, NULL, id / 2) AS half")
    assert sheets.write_files(spark, str(tmp_path), {"All Rows": rows, "None": rows.where("false")}) == ["All Rows"]
    assert [p.name for p in tmp_path.iterdir()] == ["All_Rows.csv"]
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("id long, text string, half double").csv(f"{tmp_path}/All_Rows.csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert [r.id for r in back.collect()] == list(range(1000))  # partitions in their order
    with pytest.raises(Exception, match="is there"):
        rows.write.format("sheet").option("sheet", "All_Rows").mode("append").save(str(tmp_path))


def test_failed_attempts_leave_nothing(spark, tmp_path):
    """A task that fails after some rows: no file, no part."""
    spark.dataSource.register(sheets.SheetSink)
    bad = spark.range(0, 100, 1, 4).selectExpr("IF(id = 99, raise_error('broken'), id) AS id")
    with pytest.raises(Exception, match="broken"):
        bad.write.format("sheet").option("sheet", "x").mode("overwrite").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    writer = sheets.SheetWriter({"path": str(tmp_path), "sheet": "y"}, ["a"], True)
    (tmp_path / writer.work).mkdir()
    for k, attempt in ((0, 1), (0, 2), (1, 3)):  # the first attempt of task 0 was lost and reported nothing
        (tmp_path / writer.work / f"{k}-{attempt}.csv").write_text(f"{k}{attempt}\n")
    writer.commit([sheets.Part(1, f"{writer.work}/1-3.csv", 1), None, sheets.Part(0, f"{writer.work}/0-2.csv", 1)])
    assert (tmp_path / "y.csv").read_bytes() == b"a\r\n02\n13\n" and len(list(tmp_path.iterdir())) == 1


def test_deadline(spark):
    slow = lambda: spark.range(1 << 50).selectExpr("sum(hash(id)) AS s").where("s > 0")
    limited = lambda: (_ for _ in ()).throw(RuntimeError("HTTP Error 429: too many"))
    runs = {"slow": slow, "good": lambda: spark.range(5), "none": lambda: spark.range(0), "limited": limited, "broken": lambda: spark.sql("SELECT raise_error('x')"), "net": lambda: (_ for _ in ()).throw(ConnectionError("refused"))}
    rows = {r.run: r for r in deadline.run_all(spark, runs, 4.0).collect()}
    assert {n: r.status for n, r in rows.items()} == {"slow": 1, "good": 0, "none": 6, "limited": 4, "broken": 5, "net": 3}
    assert 4 <= rows["slow"].seconds < 30 and rows["good"].rows == 5
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_nodes_as_state(spark, tmp_path):
    """Over the same updates the stream's last rows are the batch's prices; late and unknown ones change nothing."""
    nodes, edges = catalog.graph_of(spark, SF)
    nodes, edges = nodes.cache(), edges.cache()
    new = [(k, r.exchange, r.coin, r.price * f) for r in nodes.where("node_id % 2 = 0").collect() for k, f in ((1, 9.0), (2, 1.5))] + [(9, "nowhere", "X", 1.0)]
    updates = spark.createDataFrame(new, "seq long, exchange string, coin string, price double")
    late = updates.where("seq = 1").withColumn("price", F.lit(77.0))
    for k, part in enumerate((updates, late)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in", mode="append" if k else "overwrite")
    source = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming_prices(source, nodes).writeStream.format("memory").queryName("moved").outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(180)
    moved = spark.table("moved")
    batch = graph.update_prices(nodes, updates)
    want = {r.node_id: r.price for r in batch.collect()}
    before = {r.node_id: r.price for r in nodes.collect()}
    got = {r.node_id: r.price for r in moved.collect()}
    assert got == {n: p for n, p in want.items() if p != before[n]} and moved.count() == len(got) == 13
    touched = changed_edges(moved, edges)
    assert touched.count() == 13 * 24 * 2 and {r.weight for r in touched.select("weight").collect()} <= {r.weight for r in edges.select("weight").collect()}


def test_live_volatility(spark, tmp_path):
    nodes, edges = market(spark, [("A", "X", 1.0), ("B", "X", 1.1)], [(0, 1, -0.2), (1, 0, 0.05)])
    plain, factors = cli.volatility_of(spark, nodes, None)
    assert {r.volatility for r in plain.collect()} == {0.1} and {r.factor for r in factors.collect()} == {0.1}
    for k in range(4):
        told, factors = cli.volatility_of(spark, nodes.withColumn("price", F.col("price") * (1 + 0.1 * (k % 2))), f"{tmp_path}/history")
    steps = [0.1, 1 / 1.1 - 1, 0.1]
    mean = sum(steps) / 3
    want = (sum((s - mean) ** 2 for s in steps) / 3) ** 0.5
    assert all(r.volatility == pytest.approx(want) for r in told.collect())
    assert all(r.factor == pytest.approx(0.1 * want / 0.01) for r in factors.collect()) and factors.count() == 2
