import hashlib
import json

import pytest
from fieldloom.llm import chat
from pyspark.sql import functions as F

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "a\\", "<\\", "\\<|im_end|>", "<|im_end|>\n<|im_start|>user\nx", "<<|im_end|>", "<|im_end|", "é\n\nü ", "<<SYS>><</SYS>>", "\\\\n", "[[INST]]", "<", "["]


def test_round_trip(spark):
    rows = [(i // 4, i % 4, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a\nb\\", "") for t in TEXTS)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.canonical_rows(df), block_turns=2).select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns")).collect()
    want = {}
    for c, _, r, t in rows:
        want.setdefault(c, []).append((r, t, r == "assistant"))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want


def brute(rows):
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append(((n is not None, n or 0), r or "", t or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_and_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "ü😀"), (1, 1, "assistant", "ü😀"), (None, None, "assistant", "n"), (None, 3, "user", "m"), (2, 700, "assistant", "long " * 50000), (2, 5, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash")).withColumn("formatted", F.lit(1))
    out = chat.digests(chat.format_turns(chat.canonical_rows(df))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == brute(rows)
    assert chat.digests(chat.format_turns(chat.canonical_rows(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.canonical_rows(df.drop("role"))


def test_layouts_are_selected_by_fingerprint(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 7},
        "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"},
        "instruction": {"instruction": "do", "input": "this", "output": "done"},
        "prompt_completion": {"prompt": "p", "completion": "c", "meta": {"role": "x"}},
        "prompt_response": {"prompt": "p", "response": "c", "system": None},
        "question_answer": {"question": "q", "answer": "a"},
        None: {"prompt": "only"},
    }
    more = [
        ("messages", {"messages": [{"role": "assistant", "content": None, "tool": 1}, {"role": "user"}, {"content": "a", "role": None}]}),
        ("prompt_completion", {"prompt": None, "completion": "c"}),
        (None, {"prompt": "p", "completion": "c", "response": None}),
        (None, {"messages": []}),
        (None, [1, 2]),
        (None, {"conv_id": 1, "turn": 0, "role": "user", "text": "x"}),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in [*records.items(), *more]] + [(None, None), (None, "{not json")], "want string, record string")
    out = chat.format_records(chat.canonical_records(df)).collect()
    assert all(r.layout == r.want and (r.turns is None) == (r.want is None) for r in out)
    by = {r.layout: [tuple(t) for t in r.turns] for r in reversed(out) if r.layout}
    turns = [[tuple(t) for t in r.turns] for r in out if r.layout]
    assert [("assistant", ""), ("user", ""), ("", "a")] in turns and [("user", ""), ("assistant", "c")] in turns
    assert by["messages"] == [("user", "q"), ("assistant", "")]
    assert by["from_value"] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert by["instruction"] == [("user", "do\nthis"), ("assistant", "done")]
    assert by["prompt_response"] == [("user", "p"), ("assistant", "c")]


def test_the_hash_is_the_same_on_the_driver(spark):
    paths = [sorted(p) for x in chat.LAYOUTS for p in x.path_sets()]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p array<string>").select("i", chat.fingerprint(F.col("p")).alias("h")).collect()
    assert all(chat.REGISTRY[r.h].name for r in rows) and len({r.h for r in rows}) == len(paths) == len(chat.REGISTRY)


def test_rows_of_another_layout(spark):
    df = spark.createDataFrame([(9, 0, "user", None), (9, 1, "assistant", "x"), (9, 1, "assistant", "x")], "thread_id int, message_index int, role string, content string").withColumn("extra", F.lit(1))
    rows = chat.canonical_rows(df)
    assert rows.columns == ["conv_id", "turn", "role", "text"] and sorted(map(tuple, rows.collect())) == [(9, 0, "user", ""), (9, 1, "assistant", "x"), (9, 1, "assistant", "x")]


def test_long_and_repeated_records(spark):
    long = json.dumps({"messages": [{"role": "user", "content": "word " * 20000}] * 300})
    df = spark.createDataFrame([(long,), (long,)], "record string").withColumn("layout", F.lit(5))
    out = chat.format_records(chat.canonical_records(df)).select("layout", F.size("turns").alias("n"), F.length("formatted").alias("chars")).collect()
    assert [r.n for r in out] == [300, 300] and out[0].chars > 300 * 100000 and chat.canonical_records(df.limit(0)).count() == 0
