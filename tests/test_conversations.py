from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tessera.operators import conversation, requests
from tessera.plans import queries
from tessera.sources import text

GOOD = "{'S': 'Math', 'T': 'Quiz', 'G': 4, 'M': None, 'R': True}"


def test_turns(spark):
    rows = [
        (1, 1, "human", "<U>hi</U>"), (1, 2, "gpt", f"<U>ok</U> <E>{GOOD}</E>"), (1, 3, "human", "<E>the exercise"), (1, 4, "gpt", "<U>here<\\/U>"),
        (2, 1, "human", "no tag"), (3, 1, "gpt", "<U>a</U><E>{'S' None}</E>"), (4, 1, "gpt", f"<U>a</U><E>({GOOD}, {GOOD})</E>"),
        (5, 1, "gpt", "nothing"), (6, 1, "gpt", "<U>a</U><E>{'S': 'x', 'R': False}</E>"), (7, 1, "other", "x"), (8, 1, "gpt", f"<U>ask</U><E>{GOOD.replace('True', 'False')}</E>"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, sender string, message string")
    got = {(r["conv_id"], r["turn"]): r for r in conversation.clean(df).collect()}
    assert {k[0] for k in got} == {1, 4, 7, 8}
    assert got[1, 2]["content"] is None and len(got[1, 2]["params"]) == 1
    assert (got[1, 3]["role"], got[1, 3]["content"]) == ("tool", "the exercise")
    assert got[1, 4]["content"] == "here" and got[8, 1]["content"] == "ask"
    assert got[7, 1]["role"] is None
    assert {r["conv_id"] for r in conversation.clean(df, only="multi").collect()} == {4}
    assert 4 not in {r["conv_id"] for r in conversation.clean(df, only="single").collect()}
    m = conversation.tool_conversations(conversation.clean(df)).where("conv_id = 4").select(F.to_json("messages").alias("j")).first()["j"]
    call = json.loads(m)[0]["tool_calls"][0]["function"]
    assert call["name"] == "generate_exercise" and call["arguments"]["subjects"] == ["Math", "Math"] and call["arguments"]["ready"] is True


def test_queries_take_all_turns(spark, tmp_path):
    rows = [(1, 0, "user", "is 1 < 2?"), (1, 2, "assistant", "<b>yes</b>"), (2, 0, "user", "hi"), (2, 2, "assistant", None), (3, 0, "user", "hi")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: {(r["conv_id"], r["turn"]): r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    parts = run("conv_extract_params")
    assert set(parts) == {(c, n) for c, n, _, _ in rows} and parts[2, 2]["text_md5"] is None
    got = run("conv_clean")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert {k: r["content_md5"] for k, r in got.items()} == {(1, 0): md5("is 1 < 2?"), (1, 2): md5("<b>yes</b>"), (3, 0): md5("hi")}  # a turn without a text rejects its conversation


def test_sinks_and_sources(spark, tmp_path):
    pairs = spark.createDataFrame([("do a", "line\nline"), ("do b", 'q "x"')], "instruction string, response string")
    for kind in ("csv", "json", "txt"):
        text.write_pairs(pairs, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').count() == 2
    assert {r["response"] for r in text.read_jsonl(spark, str(tmp_path / "json")).collect()} == {"line\nline", 'q "x"'}
    assert {r["value"] for r in text.read_records(spark, str(tmp_path / "txt")).collect()} == {"do a\nline\nline", 'do b\nq "x"'}
    (tmp_path / "doc.json").write_text('[{"a": 1}, {"a": 2}]')
    assert text.read_json_document(spark, str(tmp_path / "doc.json")).count() == 2
    text.write_splits(spark.createDataFrame([("x", 0), ("y", 1)], "text string, split int"), str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=1").is_dir()
    text.write_batches(spark.createDataFrame([("x", None, 1)], "a string, b string, batch_id int"), str(tmp_path / "batches"))
    assert spark.read.text(str(tmp_path / "batches")).first()["value"] == '{"a":"x"}'


def test_responses(spark):
    raw = '{"custom_id": "a_0", "response": {"body": {"choices": [{"message": {"content": "x"}}]}}}'
    df = spark.createDataFrame([(raw,), ("{",), (None,)], "raw string")
    assert [r["x"] for r in df.select(requests.response_content(F.col("raw")).alias("x")).collect()] == ["x", None, None]


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    lines = [json.dumps({"conversations": [{"from": "human", "value": f"<U>{i}</U>"}]}) for i in range(40)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:3]))
    read = lambda: {r["conv_id"]: r["conversations"][0]["value"] for r in text.read_conversations(spark, str(tmp_path / "*.jsonl")).collect()}
    whole = read()
    assert whole == {f"a.jsonl#{i + 1}": f"<U>{i}</U>" for i in range(40)} | {f"b.jsonl#{i + 1}": f"<U>{i}</U>" for i in range(3)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        assert read() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_asked_and_given(spark):
    texts = [("two more, please", 2), ("Give me 3 additional ones", 3), ("some more", 0), ("a few other", 0), ("twomore", None), ("no more", None), (None, None), ("Ten  EXTRA", 10)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [r["n"] for r in df.select("i", conversation.asked_more(F.col("t")).alias("n")).orderBy("i").collect()] == [n for _, n in texts]
    two = f"({GOOD}, {GOOD})"
    rows = [(1, 1, "human", "<U>two more</U>"), (1, 2, "gpt", f"<U>a</U><E>{two}</E>"), (1, 3, "human", "<U>three more</U>"), (1, 4, "gpt", f"<U>a</U><E>{two}</E>"), (1, 5, "human", "<U>some more</U>"), (1, 6, "gpt", f"<U>a</U><E>{two}</E>"), (2, 1, "human", "<U>2 more</U>"), (2, 2, "gpt", "<U>no</U>")]
    checked = conversation.more_checked(conversation.clean(spark.createDataFrame(rows, "conv_id int, turn int, sender string, message string"))).collect()
    assert sorted((r["conv_id"], r["turn"], r["asked"], r["given"], r["fits"]) for r in checked) == [(1, 1, 2, 2, True), (1, 3, 3, 2, False), (1, 5, 0, 2, True), (2, 1, 2, 0, False)]


def test_a_call_over_several_lines(spark):
    call = 'Sure:\n{"name": "generate_exercise",\n "parameters": {"subjects": ["Math"],\n "ready": true}}'
    got = spark.createDataFrame([(call,)], "x string").select(conversation.call_parameters(F.col("x")).alias("p")).first()["p"]
    assert got["subjects"] == ["Math"] and got["ready"] is True
