from datetime import datetime, timedelta

import pytest

from tideline.streaming import twins

START = datetime(2024, 1, 1)


@pytest.fixture()
def feed(spark, tmp_path):
    def write(rows, schema, name):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.readStream.schema(schema).parquet(path)

    return write


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


SCHEMA = "visitorid long, aid long, type string, event_time timestamp, event_order long"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_sessions_close(feed):
    rows = [(1, 5, "clicks", at(0), 1), (1, 6, "carts", at(20), 2), (1, 7, "clicks", at(90), 3), (2, 5, "clicks", at(10_000), 4)]
    got = {(r.visitorid, r.events, r.items) for r in run(twins.sessions(feed(rows, SCHEMA, "s")), "t_sessions")}
    assert got == {(1, 2, 2), (1, 1, 1)}  # the last one is still open


def test_popularity(feed):
    rows = [(1, 5, "clicks", at(0), 1), (2, 5, "orders", at(60), 2), (2, 6, "clicks", at(2000), 3)]
    got = {(r.window_start, r.aid, r.events, r.score) for r in run(twins.popularity(feed(rows, SCHEMA, "p")), "t_pop", "complete")}
    assert (START, 5, 2, 7.0) in got and len(got) == 2


def test_copies(feed):
    rows = [(1, 5, "clicks", at(0), 1), (1, 5, "clicks", at(1), 1), (1, 5, "clicks", at(2), 2)]
    assert len(run(twins.drop_copies(feed(rows, SCHEMA, "d"), ["visitorid", "event_order"]), "t_copies")) == 2


def test_static_state(spark, feed):
    rows = [(1, 5, "clicks", at(0), 1), (1, 6, "clicks", at(1), 2)]
    latest = spark.createDataFrame([(5, 33)], "aid long, categoryid long")
    assert {(r.aid, r.categoryid) for r in run(twins.with_latest_state(feed(rows, SCHEMA, "l"), latest), "t_latest")} == {(5, 33), (6, -1)}


def test_asof_state(feed):
    rows = [(1, 5, "event", 0), (1, 10, "state", 7), (1, 10, "event", 0), (1, 20, "event", 0), (2, 3, "event", 0)]
    got = {(r.aid, r.ts, r.value) for r in run(twins.asof_state(feed(rows, "aid long, ts long, kind string, value long", "a")), "t_asof")}
    assert got == {(1, 5, -1), (1, 10, 7), (1, 20, 7), (2, 3, -1)}
