from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import grammar, headers, instruct, markup
from tessera.operators import conversation, labels, layout, requests, segments, split
from tessera.sources import text
from tessera.streaming import sessions


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", make(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_aliases_chain(spark):
    """Label by label: one is kept unless an earlier kept label is near; nearness does not carry over an alias."""
    rng = random.Random(1)
    names = ["topic abcdefgh" + "s" * k for k in range(6)] + [f"topic {''.join(rng.choice('abcd') for _ in range(9))}" for _ in range(40)]
    names = list(dict.fromkeys(names))
    rng.shuffle(names)
    found = spark.createDataFrame([(n, 1, i) for i, n in enumerate(names)], "label string, cnt long, first_pos long")

    def score(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return 200 * row[-1] / (len(a) + len(b))

    kept, want = [], {}
    for n in names:
        near = [(-score(n, k), i, k) for i, k in enumerate(kept) if score(n, k) > 90]
        if near:
            want[n] = min(near)[2]
        else:
            kept.append(n)
    assert {r["alias"]: r["canonical"] for r in labels.aliases(found, "m").collect()} == want and len(want) > 3
    assert labels.aliases(found.where("false"), "m").count() == 0


def test_statistics_of_canonical_labels(spark):
    rows = [(1, "(Science) (Essay) D 4 (With Hints)"), (2, "(Science) (Essays) D 4 (With Hint, With Answers)"), (3, "(Science) (Essay) D 4 M"), (4, "(Science) (Essay) D 4 (With Hint)")]
    got = labels.statistics(headers.parse(spark.createDataFrame(rows, "doc_id long, header string")))
    assert {r["label"]: r["cnt"] for r in got["m"].collect()} == {"With Hints": 3, "With Answers": 1, "M": 1}
    assert {r["combo"]: r["cnt"] for r in got["combo"].collect()} == {"Science|Essay|4|With Hints": 2, "Science|Essay|4|With HintsWith Answers": 1, "Science|Essay|4|M": 1}
    assert {r["kind"]: r["n"] for r in got["unique"].collect()} == {"s": 1, "t": 1, "g": 1, "m": 3, "combo": 3}
    assert {r["kind"]: (r["n"], r["share"]) for r in got["share"].collect()} == {"t": (1, 100.0), "m": (1, 60.0)}


def test_header_with_the_separator(spark):
    rows = [(1, "(Sci\x1fence) (Essay) D 4 M\x1f"), (2, "a\x1fb\x1fc\x1fd\x1fe"), (3, "(a\nb) (Essay) D 4 M\nx")]
    got = {r["i"]: r for r in headers.parse(spark.createDataFrame(rows, "i int, header string")).collect()}
    assert (got[1]["s"], got[1]["trailing"]) == ("Science", False) and got[2]["s"] is None
    assert (got[3]["s"], got[3]["trailing"]) == ("a\nb", True)


def test_narrow_records_and_pairs(spark):
    body = "\n(Science) (Essay) D 4 M\nx\n\n(S) T D 4 M\ny\n  \n(bad) (header)\nz"
    files = spark.createDataFrame([(1, body), (2, "")], "f int, t string")
    narrow = {(r["f"], r["record"]): r["text"] for r in segments.records(segments.lines(files, "t", "f"), "f", narrow=True).collect()}
    assert narrow == {(1, 1): "(Science) (Essay) D 4 M\nx\n\n(S) T D 4 M\ny", (1, 2): "(bad) (header)\nz"}
    good, bad = segments.pairs(segments.lines(files, "t", "f"), "f")
    assert [(r["instruction"], r["response"]) for r in good.orderBy("record").collect()] == [("Give me an essay for a 4th grade student learning science.", "x"), ("Give me an exercise for a 4th grade student.", "y")][: good.count()]
    assert [r["header"] for r in bad.collect()] == ["(bad) (header)"]


def test_sections_anywhere_in_a_line(spark):
    lined = segments.lines(spark.createDataFrame([(1, "pre (Art) a\nb (Maths) c (Art)\n(Art) d")], "f int, t string"), "t", "f")
    got = [(r["subject"], r["text"]) for r in segments.sections(lined, "f", ("Art", "Maths")).orderBy("section").collect()]
    assert got == [("Art", "(Art) a\nb "), ("Maths", "(Maths) c "), ("Art", "(Art)"), ("Art", "(Art) d")]


def test_latex(spark):
    words = column(spark, ["a *b* **c** _d_ e", "a *b-c* d", "x *é* y", "*a* b", None], markup.to_latex_words)
    assert words == ["a \\emph{b} \\textbf{c} \\underline{d} e", "a *b-c* d", "x \\emph{é} y", "*a* b", None]
    got = column(spark, ["(A b) T D 11 M\nx\n \nAnswers\nHints", "(Aa) (Bb) D 4 (With Answers)\n\nAnswers", "only a header line here with more", "(A) T D 4 M"], markup.to_latex)
    assert got[0] == "(A b) T D (11) (With Answer, With Hint)\nx\n\n\\section{Answers}\n\\section{Hints}"
    assert got[1] == "(Aa) (Bb) D 4 (With Answers)\n\n\\section{Answers}" and got[2] == "only a header line here with more" and got[3] == "A T D 4 M"
    assert column(spark, ["aaa", None, ""], lambda x: markup.replaced_all(x, "a", "ab")) == ["ababab", None, ""]
    assert column(spark, ["abc"], lambda x: markup.replaced_all(x, "", "z")) == ["abc"]


def test_tags_in_the_type(spark):
    head = "(A) (With Illustration) D 4 (With Hint)"
    assert column(spark, [head], lambda x: markup.reconciled(x, F.lit("none"))) == ["(A) T D 4 (With Hint)"]
    assert column(spark, [head], lambda x: markup.reconciled(x, F.lit("none"), compat=True)) == ["(A) E D 4 (With Hint)"]
    assert column(spark, [head], lambda x: markup.reconciled(x, F.lit("[STRDGM]"))) == [head]


def test_modifiers_as_substrings(spark):
    """The compatible rule: after a comma a name begins with a blank, and the first name has none before it."""
    m = "With Hint, With Answer"
    assert column(spark, [m], instruct.modifier) == [" It should have a subsection for hints, and answers."]
    assert column(spark, [m], lambda x: instruct.modifier(x, compat=True))[0].startswith(" It should have a subsection for hints. It should be a ")


def test_rarest_label_rules(spark):
    parsed = spark.createDataFrame([(1, "a,b,c"), (2, "a"), (3, "a,c"), (4, "b,a")], "doc_id long, m string")
    counted = labels.counts(parsed, "m")
    assert {r["doc_id"]: (r["label"], r["single"]) for r in labels.rarest(parsed, counted, "m").collect()} == {1: ("c", False), 2: ("a", True), 3: ("c", False), 4: ("b", False)}
    assert {r["doc_id"]: r["label"] for r in labels.rarest(parsed, counted, "m", compat=True).collect()} == {1: "c", 2: "a", 3: "c", 4: "b"}


def test_pack_streams_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0, 3, 7, 25, None])) for i in range(500)]
    got = {r["i"]: r["batch_id"] for r in requests.pack(spark.createDataFrame(rows, "g string, i int, n long").repartition(3), "g", "i", "n", 20).collect()}
    for g in ("a", "b", None):
        batch, total = 1, 0
        for k, (_, i, n) in enumerate(r for r in rows if r[0] == g):
            n = n or 0
            batch, total = (batch + 1, n) if total + n >= 20 and k else (batch, total + n)
            assert got[i] == batch
    assert requests.pack(spark.createDataFrame([], "g string, i int, n long"), "g", "i", "n").count() == 0


def test_tokens_by_a_tokenizer(spark):
    lengths = requests.counted_by(lambda texts: [len(x) for x in texts])
    m = "array<struct<role:string,content:string,name:string>>"
    rows = [([("user", "hello", None)],), ([("system", "a", None), ("user", None, "bob")],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"m {m}")
    assert [r["n"] for r in df.select(requests.message_tokens(F.col("m"), named=True, all_tokens=lengths).alias("n")).collect()][:3] == [3 + 3 + 4 + 5, 3 + 6 + 1 + 6 + 1 + 4 + 3, 3]
    try:
        import public_tokenizers
        import tokenizers
    except ImportError:
        return

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("byte_bpe_50k.json")

    def encode(texts):
        return [len(e.ids) for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]

    got = df.limit(1).select(requests.message_tokens(F.col("m"), all_tokens=requests.counted_by(encode)).alias("n")).first()["n"]
    assert got == 6 + len(library.encode("user").ids) + len(library.encode("hello").ids)


def test_results_and_nested_conversations(spark, tmp_path):
    line = json.dumps({"custom_id": "a_0", "response": {"body": {"choices": [{"message": {"content": "x"}}]}}})
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "job_1.jsonl").write_text(line + "\nbroken\n")
    (tmp_path / "results" / "job_2.jsonl").write_text(line)
    got = requests.results_of(spark.createDataFrame([("job_1",), ("job_1",)], "job_id string"), text.read_results(spark, str(tmp_path / "results"))).collect()
    assert sorted((r["job_id"], r["custom_id"] or "", r["content"] or "") for r in got) == [("job_1", "", ""), ("job_1", "a_0", "x")]

    good = "{'S': 'Math', 'T': 'Quiz', 'G': 4, 'M': None, 'R': True}"
    nested = [{"conversations": [{"from": "human", "value": "<U>hi</U>"}, {"from": "gpt", "value": f"<U>ok</U><E>{good}</E>"}]}, {"conversations": []}, {"conversations": [{"from": "human", "value": "no tag"}]}, {"conversations": [{"from": "gpt", "value": f"<U>a</U><E>({good}, {good})</E>"}]}]
    (tmp_path / "conv.json").write_text(json.dumps(nested))
    read = text.read_conversations(spark, str(tmp_path / "conv.json"))
    turns = conversation.exploded(read.withColumn("file", F.lit(13)))
    assert turns.count() == 4 and turns.columns == ["file", "conv_id", "turn", "sender", "message"]
    found = conversation.corpora(turns, "file", [13], [13])
    assert sorted(r["kind"] for r in found.collect()) == ["multi", "single"]
    text.write_conversations(conversation.mixed(found.select("messages"), seed=3).coalesce(1), str(tmp_path / "out"))
    written = [json.loads(r["value"])["messages"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(len(m) for m in written) == [1, 2]
    single = next(m for m in written if len(m) == 2)
    assert single[0] == {"role": "user", "content": "hi"} and "content" not in single[1]
    assert single[1]["tool_calls"][0]["function"]["arguments"]["ready"] is True


def test_tool_side(spark):
    schema = conversation.tool_schema("makes exercises")["function"]["parameters"]
    assert schema["required"] == ["subjects", "exercise_types", "grade_levels", "modifications", "ready"] and schema["properties"]["ready"] == {"type": "boolean"}
    call = '{"name": "generate_exercise", "parameters": {"subjects": ["Math"], "exercise_types": ["Quiz"], "grade_levels": ["4"], "modifications": ["Hint", "Marks"], "ready": true}}'
    got = column(spark, [f"Sure: {call}", "no call", None, '{"name": "generate_exercise", broken}'], conversation.call_parameters)
    assert got[0]["subjects"] == ["Math"] and got[0]["ready"] is True and got[1] is None and got[2] is None
    assert column(spark, [call, call.replace(', "Marks"', "")], lambda x: conversation.balanced(conversation.call_parameters(x))) == [False, True]
    assert column(spark, [call, "x", None], lambda x: conversation.tool_call_of(x).isNotNull()) == [True, False, False]
    assert column(spark, ["```json\n{\"a\": null}\n```"], lambda x: requests.without_fence(x, compat=True)) == ['{"a": None}']


def test_samples_repeat(spark):
    df = spark.range(2000).unionByName(spark.createDataFrame([(None,)], "id long"))
    rest, some = conversation.sampled(df, "id", 0.1, 3)
    assert 120 < some.count() < 280 and rest.count() + some.count() == 2001
    again = conversation.sampled(df.repartition(5), "id", 0.1, 3)[1]
    assert {r["id"] for r in some.collect()} == {r["id"] for r in again.collect()} != {r["id"] for r in conversation.sampled(df, "id", 0.1, 4)[1].collect()}


def test_files_of_text_and_images(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("")
    assert sorted(r["text"] for r in text.read_corpus(spark, str(tmp_path / "*.txt")).collect()) in (["one\ntwo"], ["", "one\ntwo"])
    (tmp_path / "Science_4_101.png").write_bytes(b"png")
    got = text.read_images(spark, str(tmp_path)).first()
    assert (got["subject"], got["grade"], bytes(got["content"])) == ("Science", "4", b"png")
    rows = spark.createDataFrame([("x",)], "content string")
    for _ in range(2):
        text.append_text(rows, str(tmp_path / "out"), "content")
    assert text.read_records(spark, str(tmp_path / "out")).count() == 2
    images = spark.createDataFrame([("a", 2, 5, 7), ("a", 1, 10, 20), ("b", 1, 3, 4)], "g string, image_no int, width int, height int")
    assert {r["g"]: (r["width"], r["height"], r["n"]) for r in layout.stacked(images, "g").collect()} == {"a": (10, 40, 2), "b": (3, 4, 1)}


def test_imperatives_by_a_tagger(spark):
    def make():
        def tag(sentence):
            words = sentence.split()
            verb = next((i for i, w in enumerate(words) if w.lower() in ("draw", "run")), None)
            return [("VB", "ROOT", i) if i == verb else ("PRP", "nsubj", verb if verb is not None else i) if w.lower() in ("you", "i") else ("NN", "obj", 0) for i, w in enumerate(words)]

        return tag

    assert column(spark, ["Draw a cat", "You draw a cat", "a cat", "", None], grammar.has_imperative(make)) == [True, False, False, False, False]


def test_sessions_with_tool_and_removal(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    call = '{"name": "generate_exercise", "parameters": {"n": 2}}'

    def respond(held):
        return f"done: {held[-1][1]}" if held[-1][0] == "tool" else call if held[-1][1] == "make" else f"{len(held)} so far"

    source, schema = tmp_path / "in", "session_id string, seq long, user_input string"
    rows = [("a", 1, "make"), ("a", 2, sessions.REMOVE), ("a", 3, "hi"), ("b", 1, "x"), ("b", 2, sessions.REMOVE)]
    spark.createDataFrame(rows, schema).write.parquet(str(source))
    out = sessions.answered(spark.readStream.schema(schema).parquet(str(source)), respond, system="s", tool=lambda n: f"{n} items")
    for _ in range(1):
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(((r["session_id"], r["seq"], r["role"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[0], r[2:] != ("user", "make"), r))
    assert ("a", 2, "assistant", call) in got and ("a", 3, "tool", "2 items") in got and ("a", 4, "assistant", "done: 2 items") in got
    assert ("a", 2, "assistant", "2 so far") in got  # the removed session began anew
    assert sessions.parameters_of("text") is None and sessions.parameters_of('"name": "generate_exercise" {bad}') is None


def test_splits_refuse_zero_ratios():
    with pytest.raises(ValueError):
        split.draws((7, 0, 1))


def test_mixed_samples_hashes_only(spark):
    """The order is by hash and row, but no text is a key by which partitions are bounded."""
    a, b = (spark.createDataFrame([(i, f"text {i}") for i in r], "id long, text string") for r in (range(50), range(50, 120)))
    got = conversation.mixed(a, b, seed=3)
    whole = F.to_json(F.struct("id", "text"))
    assert got.collect() == a.unionByName(b).orderBy(F.xxhash64(F.lit(3), whole), whole).collect()
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "rangepartitioning(" in x]
    assert dealt and all(x.count("ASC NULLS FIRST") == 1 for x in dealt)  # the hash alone


def test_results_of_a_large_job_stay_where_they_are(spark):
    lines = spark.range(300).selectExpr("concat('job', id % 3) AS job_id", "'{}' AS raw")
    jobs = spark.createDataFrame([("job1",), ("job1",), ("job9",), (None,)], "job_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = requests.results_of(jobs, lines)
        assert got.count() == 100 and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
