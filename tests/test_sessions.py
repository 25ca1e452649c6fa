from __future__ import annotations

from tessera.streaming import sessions


def test_history_and_known_sessions(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z"), (None, 1, "n")], "s string, i int, m string")
    got = {r["s"]: r["messages"] for r in sessions.history(df, "s", ["i"], "m").collect()}
    assert got == {"a": ["x", "y"], "b": ["z"], None: ["n"]}
    good, refused = sessions.known(df, spark.createDataFrame([("a",), ("a",)], "s string"), "s")
    assert good.count() == 2 and refused.count() == 2


def test_stream_keeps_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_id string, seq long, user_input string"
    source = tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
    write([("a", 1, "hello"), ("b", 1, "hi")])
    stream = spark.readStream.schema(schema).parquet(str(source))
    out = sessions.answered(stream, lambda held: f"{len(held)} so far", system="be brief")

    def drain():
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    drain()
    write([("a", 2, "more")])
    drain()
    rows = sorted((r["session_id"], r["seq"], r["role"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [
        ("a", 1, "user", "hello"), ("a", 2, "assistant", "2 so far"), ("a", 3, "user", "more"), ("a", 4, "assistant", "4 so far"),
        ("b", 1, "user", "hi"), ("b", 2, "assistant", "2 so far"),
    ]
