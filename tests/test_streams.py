"""Ordered sessions with expiry, and results that are followed, over restarts."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.streaming import results, sessions

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
SCHEMA = "session_id string, seq long, user_input string, at timestamp"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def said(history):
    return " ".join(c for r, c in history if r == "user")


class Chat:
    """Batches of messages, one after the other, through one query and its checkpoint."""

    def __init__(self, spark, path, **settings):
        self.spark, self.path, self.n = spark, path, 0
        stream = spark.readStream.schema(SCHEMA).parquet(str(path / "in" / "*"))
        self.out = sessions.answered_in_order(stream, said, late="0 seconds", ttl=60_000, patience=10_000, **settings)

    def send(self, *rows):
        self.n += 1
        made = [(s, seq, text, START + timedelta(seconds=at)) for s, seq, text, at in rows]
        self.spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(str(self.path / "in" / f"{self.n}"))
        q = self.out.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    def rows(self, session):
        found = self.spark.read.schema(sessions.OUTPUT).parquet(str(self.path / "out")).where(F.col("session_id") == session).orderBy("seq").collect()
        assert [r["seq"] for r in found] == list(range(len(found)))  # no number twice, none left out
        return [r["content"] for r in found if r["role"] == "assistant"]


def test_order_gaps_and_expiry(spark, tmp_path):
    (tmp_path / "in" / "0").mkdir(parents=True)
    chat = Chat(spark, tmp_path, system="be brief")
    chat.send(("a", 1, "one", 0), ("a", 3, "three", 2), ("b", 2, "second", 1))
    assert chat.rows("a") == ["one"] and chat.rows("b") == []  # three and second wait
    chat.send(("a", 2, "two", 3), ("a", 1, "again", 3))
    assert chat.rows("a") == ["one", "one two", "one two three"]  # in order; an answered number is not answered again
    chat.send(("c", 1, "other", 20))  # time goes on: b's first message is given up
    assert chat.rows("b") == ["second"]
    chat.send(("b", 1, "first", 21), ("b", 3, "third", 21))
    assert chat.rows("b") == ["second", "second third"]
    state = spark.read.format("statestore").option("stateVarName", "messages").load(str(tmp_path / "state"))
    held = state.where("key.session_id = 'a'").count()
    assert held == 7  # the system's message, three of the user, three answers
    chat.send(("c", 2, "more", 70))  # a is silent for over a minute
    chat.send(("a", 4, "four", 75), ("b", 4, "fourth", 75))
    assert chat.rows("a")[-1] == "four" and chat.rows("b")[-1] == "second third fourth"
    chat.send(("b", 5, sessions.REMOVE, 76), ("b", 6, "new", 77))
    assert chat.rows("b")[-1] == "new" and chat.rows("c") == ["other", "other more"]


def test_a_broken_call_does_not_end_the_stream(spark, tmp_path):
    (tmp_path / "in" / "0").mkdir(parents=True)
    call = '{"name": "generate_exercise",\n "parameters": {"wrong": 1}}'
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    out = sessions.answered_in_order(stream, lambda held: call if held[-1][0] == "user" else held[-1][1], tool=lambda right: "made", late="0 seconds")
    spark.createDataFrame([("a", 1, "make", START)], SCHEMA).write.parquet(str(tmp_path / "in" / "1"))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r["role"] for r in got] == ["user", "assistant", "tool", "assistant"] and got[2]["content"].startswith("error: TypeError")


def line(i, content):
    return json.dumps({"custom_id": f"r{i}", "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_results_once_over_a_crash(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "job1.jsonl").write_text("\n".join([line(1, "one"), line(2, "two"), "", "broken"]) + "\n")
    writer = results.write_once(out, results.raw_lines)

    def run(write):
        q = results.follow(spark, str(source)).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    def crash(batch, number):
        writer(batch, number)
        raise RuntimeError("after writing, before the commit")

    with pytest.raises(Exception, match="before the commit"):
        run(crash)
    run(writer)
    (source / "job1b.jsonl").write_text(line(3, "three") + "\n")
    (source / "job2.jsonl").write_text("\n".join([line(1, "of another job"), line(1, "of another job")]))
    run(writer)
    run(writer)
    values = sorted(r["value"] for r in results.written(spark, out).collect())
    assert values == sorted([line(1, "one"), line(2, "two"), "broken", line(3, "three"), line(1, "of another job")])


def test_contents_and_one_combined_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / "in" / f"job{k}.jsonl").write_text("\n".join([line(k, "text é"), line(k, "text é"), "{", ""]))
    q = results.follow(spark, str(tmp_path / "in"), files=1).writeStream.foreachBatch(results.write_once(str(tmp_path / "out"), results.contents)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.option("lineSep", "\n\n\n").text(str(tmp_path / "out")).select("value").distinct().count() == 1
    from tessera.sources import text

    results.combine(text.read_results(spark, str(tmp_path / "in")), str(tmp_path / "one"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "one")).collect()) == sorted([line(1, "text é"), line(2, "text é"), "{", "{"])
