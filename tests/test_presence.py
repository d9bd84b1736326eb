import json
import random

from fieldloom.operators import presence

WANTED = {"id": "integer", "name": "string", "size": "number", "ok": "boolean", "links": "array", "pose": "object", "it's": "string"}


def kind(v):
    names = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}
    return names[type(v)]


def test_states_equal_a_loop(spark):
    rng = random.Random(3)
    values = [1, -5, 10**25, 2.5, "x", "", True, [], [1], {}, {"a": None}, None]
    docs = []
    for i in range(200):
        keys = rng.sample([*WANTED, "other", "Name"], rng.randrange(9))
        docs.append((i, {k: rng.choice(values) for k in keys}))
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "doc int, value string").repartition(3)
    want = set()
    for i, d in docs:
        for k, t in WANTED.items():
            fits = k in d and d[k] is not None and (kind(d[k]) == t or (t == "number" and kind(d[k]) == "integer"))
            big = isinstance(d.get(k), int) and abs(d[k]) > 2**63
            state = "absent" if k not in d else "null" if d[k] is None else "present" if fits else "is number" if big else f"is {kind(d[k])}"
            want.add((i, k, state))
        want |= {(i, k, "unknown") for k in d if k not in WANTED}
    got = [tuple(r) for r in presence.key_states(df, "value", WANTED).collect()]
    # decimal notation has no type of its own
    fixed = {(i, k, "is number" if s == "is number" else s) for i, k, s in got}
    assert len(got) == len(fixed) and fixed == want


def test_broken_documents_say_what_and_where(spark):
    rows = [(1, '{"a": 1}'), (2, '{"a": 1,\n "b" 2}'), (3, "[1]"), (4, None), (5, ""), (6, '{"a": 1'), (7, '"text"'), (7, '"text"')]
    df = spark.createDataFrame(rows, "line int, value string")
    got = sorted(map(tuple, presence.broken_documents(df.withColumnRenamed("line", "doc"), "value").collect()), key=repr)
    want = [(3, "not an object", None, None), (4, "no text", None, None), (7, "not an object", None, None), (7, "not an object", None, None)]
    for i in (2, 5, 6):
        try:
            json.loads(dict(rows)[i])
        except json.JSONDecodeError as e:
            want.append((i, e.msg, e.lineno, e.colno))
    assert got == sorted(want, key=repr) and (2, "Expecting ':' delimiter", 2, 6) in got
    empty = df.limit(0)
    assert presence.broken_documents(empty, "value").count() == presence.key_states(empty, "value", WANTED).count() == 0
    assert {tuple(r) for r in presence.key_states(df, "value", {}).collect()} == {(1, "a", "unknown")}
