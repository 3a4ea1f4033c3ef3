import io
import json
from urllib.error import HTTPError, URLError

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from __spark_entry__ import queries as registered
from tapeloom import generate_demo_prices, queries
from tapeloom.cli import main
from tapeloom.sources import prices, provider


def csv_of(tmp_path, header, rows):
    path = tmp_path / "p.csv"
    path.write_text("\n".join([header, *rows]) + "\n")
    return path


def good(n=60):
    return [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d},10,12,9,11,{100 + i}" for i in range(n)]


def test_names_without_case(spark, tmp_path):
    frame = prices.load_prices(csv_of(tmp_path, " timestamp ,OPEN,high,Low,close,VOLUME", good()), spark)
    assert frame.columns == list(prices.PRICE_COLUMNS) and frame.count() == 60


def test_checks(spark, tmp_path):
    for row, message in (("2024-06-01,10,9,8,9,1", "High must"), ("2024-06-01,10,12,11,11,1", "Low must"), ("2024-06-01,x,12,9,11,1", "missing or invalid"), ("2024-06-01,0,12,0,11,1", "greater than zero"), ("2024-06-01,10,12,9,11,-1", "negative")):
        with pytest.raises(ValueError, match=message):
            prices.load_prices(csv_of(tmp_path, "Date,Open,High,Low,Close,Volume", [*good(), row]), spark)
    with pytest.raises(ValueError, match="At least 60"):
        prices.load_prices(csv_of(tmp_path, "Date,Open,High,Low,Close,Volume", [*good(59), good(1)[0]]), spark)
    with pytest.raises(ValueError, match="Missing required CSV columns: Volume"):
        prices.load_prices(csv_of(tmp_path, "Date,Open,High,Low,Close", ["2024-01-01,1,1,1,1"]), spark)
    with pytest.raises(FileNotFoundError):
        prices.load_prices(tmp_path / "none.csv", spark)


def test_csv_round_trip(spark, tmp_path):
    made = generate_demo_prices(60)
    saved = prices.save_csv(made, tmp_path / "deep" / "out.csv")
    assert [tuple(r) for r in prices.load_prices(saved, spark).collect()] == [tuple(r) for r in made.collect()]
    assert [p.name for p in saved.parent.iterdir()] == ["out.csv"]


def test_one_file_of_many_parts(spark, tmp_path):
    frame = spark.range(5000).selectExpr("id", "concat('a \"b\", ', id) AS `te,xt`", "CASE WHEN id % 3 > 0 THEN id / 7 END AS x").repartition(7).orderBy("id")
    for target in (tmp_path / "many.csv", f"file://{tmp_path}/uri.csv"):
        assert prices.save_csv(frame, target) == target
    frame.coalesce(1).write.option("header", True).csv(str(tmp_path / "single"))
    (single,) = (tmp_path / "single").glob("part-*.csv")
    assert (tmp_path / "many.csv").read_bytes() == (tmp_path / "uri.csv").read_bytes() == single.read_bytes()
    prices.save_csv(frame.limit(0), tmp_path / "many.csv")  # replaces the file
    assert (tmp_path / "many.csv").read_text() == 'id,"te,xt",x\n'
    assert sorted(p.name for p in tmp_path.iterdir()) == ["many.csv", "single", "uri.csv"]


def test_failed_csv_leaves_the_earlier_file(spark, tmp_path):
    target = tmp_path / "kept.csv"
    target.write_text("earlier\n")
    with pytest.raises(Exception, match="row 77"):
        prices.save_csv(spark.range(0, 100, 1, 4).selectExpr("if(id = 77, raise_error('row 77'), id) AS id"), target)
    assert [p.name for p in tmp_path.iterdir()] == ["kept.csv"] and target.read_text() == "earlier\n"
    (tmp_path / "folder").mkdir()
    with pytest.raises(FileExistsError):
        prices.save_csv(spark.range(1), tmp_path / "folder")


def test_day_pages_are_bounded(spark):
    sf = "/root/testdata/sf0.001"
    ticks = queries.ticks(spark, sf)
    many = queries.day_pages(ticks, page_bars=7, salt_rows=200)
    sizes = [sum(map(len, json.loads(r.payload)["bars"].values())) for r in many.collect()]
    assert max(sizes) <= 7 and sum(sizes) == ticks.count()
    flat = lambda pages: sorted(map(str, provider.flatten_pages(pages).collect()))
    assert flat(many) == flat(queries.day_pages(ticks))


def test_pages_and_flattening(spark):
    first = {"bars": {"AAPL": [{"t": "2026-01-02T05:00:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10, "n": 3, "vw": 1.2}]}, "next_page_token": "p2"}
    second = {"bars": {"msft": [{"t": "2026-01-02T05:00:00Z", "o": 5, "h": 6, "l": 4, "c": 5, "v": 20}]}, "next_page_token": None}

    def get(parameters):
        assert parameters["timeframe"] == "1Day" and parameters["feed"] == "iex" and parameters["limit"] == 10_000
        return second if parameters.get("page_token") == "p2" else first

    rows = provider.MarketDataClient(get=get, spark=spark).fetch_daily_bars([" msft", "AAPL", "aapl"], start="2026-01-01", end="2026-01-03").orderBy("ticker").collect()
    assert [(r.ticker, r.close, r.trade_count) for r in rows] == [("AAPL", 1.5, 3.0), ("MSFT", 5.0, None)]
    with pytest.raises(RuntimeError, match="repeated"):
        list(provider.PageChain({}, lambda p: {"bars": {}, "next_page_token": "x"}))
    for bad in (dict(feed="x"), dict(batch_size=0)):
        with pytest.raises(ValueError):
            provider.MarketDataClient(get=get, spark=spark).fetch_daily_bars(["A"], start="a", end="b", **bad)


def test_a_fetch_can_keep_all_bars_of_one_instant(spark):
    bar = {"t": "2026-01-05T15:00:00Z", "o": 1, "h": 2, "l": 0.5, "v": 10}
    pages = {"": {"bars": {"AAA": [{**bar, "c": 1.25}, {**bar, "c": 1.5}]}, "next_page_token": "p2"}, "p2": {"bars": {"AAA": [{**bar, "c": 1.75}], "BBB": [{**bar, "c": 1}]}}}
    for options, want in (({}, [("AAA", 1.75), ("BBB", 1.0)]), ({"one_per_instant": False}, [("AAA", 1.25), ("AAA", 1.5), ("AAA", 1.75), ("BBB", 1.0)])):
        client = provider.MarketDataClient(get=lambda p: pages[p.get("page_token", "")], spark=spark, **options)
        assert sorted((r.ticker, r.close) for r in client.fetch_minute_bars(["AAA", "BBB"], start="2026-01-05", end="2026-01-06").collect()) == want


@pytest.mark.parametrize("name", ["provider_fetch", "provider_validation"])
def test_provider_queries_count_every_event_of_one_instant(spark, tmp_path, name):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events.withColumn("event_id", F.col("event_id") + 1_000_003)).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as engine:
        engine.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        found = engine.execute(oracle_sql()[name])
        columns, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(tuple(r) for r in registered()[name](spark, str(tmp_path)).select(*columns).collect()) == sorted(want)


def test_retries():
    tries, waits = [], []

    class Answer(io.BytesIO):
        pass

    def opener(request, timeout):
        tries.append(request)
        if len(tries) == 1:
            raise HTTPError("u", 429, "slow", {"Retry-After": "4"}, None)
        if len(tries) == 2:
            raise URLError("gone")
        return Answer(json.dumps({"bars": {}}).encode())

    keys = provider.Credentials("id-secret", "key-secret")
    assert provider.get_json({"a": 1}, keys, opener=opener, sleep=waits.append) == {"bars": {}}
    assert waits == [4.0, 2] and all("secret" not in r.full_url for r in tries) and "secret" not in repr(keys)

    def refused(request, timeout):
        raise HTTPError("u", 403, "no", {}, None)

    with pytest.raises(RuntimeError, match="403"):
        provider.get_json({}, keys, opener=refused, sleep=waits.append)


def test_command_line(spark, tmp_path, capsys):
    assert main(["demo", "--rows", "80", "--output", str(tmp_path / "a.csv")]) == 0
    assert (tmp_path / "a.csv").is_file() and "Final equity" in capsys.readouterr().out
    with pytest.raises(SystemExit) as stop:
        main(["analyze", str(tmp_path / "none.csv")])
    assert stop.value.code == 2


def numbered_pages(calls, broken):
    """A server of four pages a request; while a file `broken` is there, page 2 cannot be had. Each call leaves its time."""

    def get(parameters):
        import time
        import uuid
        from pathlib import Path

        n = int(parameters.get("page_token") or 0)
        (Path(calls) / f"{time.time():.6f}-{parameters['symbols']}-{n}-{uuid.uuid4().hex}").touch()
        if n == 2 and Path(broken).exists():
            raise RuntimeError("the line is cut")
        bar = {"t": f"2026-01-05T15:0{n}:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10}
        return {"bars": {s: [bar] for s in parameters["symbols"].split(",")}, "next_page_token": str(n + 1) if n < 3 else None}

    return get


def asked(calls):
    return sorted(tuple(f.name.split("-")[1:3]) for f in calls.iterdir())


def test_a_fetch_goes_on_after_its_last_saved_page(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    broken.touch()
    client = provider.MarketDataClient(get=numbered_pages(str(calls), str(broken)), spark=spark, saved_pages=str(tmp_path / "saved"))
    fetch = lambda: client.fetch_minute_bars(["AAA", "BBB"], start="2026-01-05", end="2026-01-06", batch_size=1)
    with pytest.raises(Exception, match="the line is cut"):
        fetch().count()
    assert {"0", "1"} <= {n for s, n in asked(calls) if s in ("AAA", "BBB")}
    saved = {(s, n) for s, n in asked(calls) if n in "01"}
    for f in calls.iterdir():
        f.unlink()
    broken.unlink()
    assert fetch().count() == 8
    assert not set(asked(calls)) & {x for x in saved if x[0] == "AAA"} and ("AAA", "2") in asked(calls)  # page k + 1 is the first one asked for
    n = len(asked(calls))
    assert fetch().count() == 8 and len(asked(calls)) == n  # all pages are saved now
    client.forget()
    assert not (tmp_path / "saved").exists() and fetch().count() == 8 and len(asked(calls)) == n + 8


def test_all_tasks_keep_to_one_budget(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    client = provider.MarketDataClient(get=numbered_pages(str(calls), str(tmp_path / "no")), spark=spark, requests_per_minute=600)
    assert client.fetch_minute_bars([f"T{k}" for k in range(6)], start="2026-01-05", end="2026-01-06", batch_size=1).count() == 24
    times = sorted(float(f.name.split("-")[0]) for f in calls.iterdir())
    assert len(times) == 24 and all(sum(t <= x < t + 1 for x in times) <= 10 + 6 for t in times) and times[-1] - times[0] > 1.5
    with pytest.raises(ValueError, match="budget"):
        provider.MarketDataClient(get=lambda p: {}, requests_per_minute=0)
