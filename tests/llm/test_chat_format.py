import hashlib
import json

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from mftlake.llm import chat_format as C

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
pieces = st.lists(st.sampled_from([*C.CONTROLS, "\\", "\n", "<", "|", "im_end|>", "a", "é", " ", "</s>[INST] ok [/INST]"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), pieces), pieces), max_size=5))
def test_round_trip(turns):
    f = C.render(turns)
    assert C.parse(f.text) == turns
    assert [C.unescape(f.text[a:b]) for a, b in f.loss] == [t for r, t in turns if r == "assistant"]
    for c in C.CONTROLS:
        assert f.text.count(c) == (len(turns) if c in ("<|im_start|>", "<|im_end|>") else 0)


def test_layouts_in_one_table_of_json(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = [
        ({"prompt": "q", "completion": "a"}, "prompt-completion", want),
        ({"output": "a", "instruction": "q", "input": ""}, "instruction-input-output", want),
        ({"output": "a", "instruction": "q", "input": "x"}, "instruction-input-output", [("user", "q\n\nx"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, "messages", want),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from-value", want),
        ({"question": "q", "answer": None}, "question-answer", [("user", "q"), ("assistant", "")]),
        ({"other": 1}, None, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, *_) in enumerate(records)] + [(100, "{broken"), (101, None)]
    got = {r["id"]: r for r in C.canonical_turns(spark.createDataFrame(rows, "id int, record string")).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i]["_layout"] == layout
        assert (got[i]["_turns"] and [tuple(t) for t in got[i]["_turns"]]) == turns
    assert got[100]["_layout"] is None and got[101]["_turns"] is None


def test_struct_records_and_digests(spark):
    table = spark.createDataFrame(
        [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "user", None), (3, None, None, "</s>"), (None, 0, "assistant", "x" * 100_000)],
        "conv_id long, turn long, role string, text string",
    ).selectExpr("*", "'z' as record", "1 as _id")
    plain = table.select("conv_id", "turn", "role", "text")
    got = {r["_id"]: r for r in C.digests(C.format_turns(C.canonical_turns(C.conversations_to_records(plain)).select("_id", "_turns"))).collect()}
    want = {1: [("user", "a"), ("assistant", "b")], 2: [("user", "")] * 2, 3: [("", "</s>")], None: [("assistant", "x" * 100_000)]}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(learnt), sha(learnt))


def test_empty_and_unknown(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.canonical_turns(C.conversations_to_records(empty)).count() == 0
    odd = spark.createDataFrame([Row(record=Row(left="a", right="b"))])
    assert C.canonical_turns(odd).first()["_layout"] is None


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i % 7, i // 7, "user" if (i // 7) % 2 == 0 else "assistant", None if i % 5 == 0 else f"t{i} <s>\\") for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in C.op4_chat_format(spark, str(tmp_path)).collect()}
    control = "</s>[INST] ok [/INST]"
    want = {-1: [("user", control), ("assistant", control)]}
    for c, _, r, t in sorted(rows, key=lambda x: (x[0], x[1])):
        want.setdefault(c, []).append((r, t or ""))
    assert got.keys() == want.keys()
    for k, turns in want.items():
        assert got[k]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert got[k]["loss_sha256"] == sha("".join(t for r, t in turns if r == "assistant"))


def test_fields_beside_the_conversation_do_not_matter(spark):
    records = [
        ({"id": 7, "prompt": "q", "response": "a", "metadata": {"source": "s", "tags": ["x"]}}, "prompt-response"),
        ({"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}], "source": "s"}, "messages"),
        ({"system": "s", "prompt": "q", "response": "a"}, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)]
    got = {r["id"]: r for r in C.canonical_turns(spark.createDataFrame(rows, "id int, record string")).collect()}
    for i, (_, layout) in enumerate(records):
        assert got[i]["_layout"] == layout
        assert (got[i]["_turns"] and [tuple(t) for t in got[i]["_turns"]]) == (layout and [("user", "q"), ("assistant", "a")])
    typed = spark.createDataFrame([Row(record=Row(id=7, question="q", answer="a"))])
    assert [tuple(t) for t in C.canonical_turns(typed).first()["_turns"]] == [("user", "q"), ("assistant", "a")]


def test_sql_says_the_same_of_odd_rows(spark, tmp_path):
    odd = [*C.CONTROLS, "\\", "\\<s>\\\\", "<s><s></s>", "é\n🙂", "", None]
    rows = [(i % 5, i % 3 or None, ["user", "assistant", None, "a\nb<s>"][i % 4], odd[i % len(odd)]) for i in range(90)] + [(-1, 0, "user", "in the table too"), (None, 0, "assistant", "x" * 200_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op4_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(C.OP4_SQL)
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found.fetchall()))
