import hashlib
import random

from fieldloom.llm import lines


def brute(docs, window):
    """{doc_id: text that is left} by comparing every window with every earlier position."""
    seen, dropped = {}, {}
    for doc, text in sorted((d, t) for d, t in docs if d is not None and t is not None):
        full = [x.strip(lines.BLANKS) for x in text.split("\n")]
        at = [i for i, x in enumerate(full) if x]
        for k in range(len(at) - window + 1):
            gram = tuple(full[i] for i in at[k : k + window])
            if seen.setdefault(gram, (doc, k)) < (doc, k):
                dropped.setdefault(doc, set()).update(at[k : k + window])
        for k, i in enumerate(at):
            if len(full[i].split(" ")) >= lines.LONG_WORDS and seen.setdefault((full[i], "long"), (doc, k)) < (doc, k):
                dropped.setdefault(doc, set()).add(i)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dropped.get(d, ())) for d, t in docs if d is not None and t is not None}, set(dropped)


def test_against_brute_force_and_edges(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["a", "b ", " b", "c", "", "  ", "dd"]) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "one line"), (103, "one line"), (104, "x\ny\n" * 5000), (105, "q\nr\ns"), (106, "q\nr\ns"), (None, "q\nr\ns")]
    long = " ".join(f"w{i}" for i in range(lines.LONG_WORDS))
    docs += [(107, f"only {long}\nhere"), (108, f" {long}\t"), (109, f"before\n{long}\nafter"), (110, f"{long}\nelse\n{long}"), (111, long.rpartition(" ")[0]), (112, long.rpartition(" ")[0])]
    df = spark.createDataFrame([(d, t, 1, [2]) for d, t in docs], "doc_id long, text string, line int, dropped array<int>")
    for window in (1, 2, 3):
        want, touched = brute(docs, window)
        out = lines.without_repeated_lines(df, window, drop_emptied=False)
        assert out.columns == df.columns
        assert {r.doc_id: r.text for r in out.collect() if r.doc_id is not None and r.text is not None} == want
        gone = {d for d in touched if not want[d].replace("\n", "").strip(lines.BLANKS)}
        assert {r.doc_id for r in lines.without_repeated_lines(df, window).collect()} == {d for d, _ in docs} - gone
    report = {r.doc_id: r for r in lines.line_report(df).collect()}
    assert len(report) == len(docs)
    assert report[106].n_dropped == 3 and report[106].kept_sha256 == hashlib.sha256(b"").hexdigest() and report[105].n_dropped == 0
    assert lines.line_report(df.limit(0)).count() == 0
    twice = lines.without_repeated_lines(df.where("doc_id = 105").union(df.where("doc_id = 105")))
    assert [r.text for r in twice.collect()] == ["q\nr\ns"] * 2


def test_only_selected_lines_are_shuffled_and_every_repeated_run_is_found(spark):
    rng = random.Random(8)
    plain = [(i, "\n".join(f"line {rng.randrange(10**9)}" for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    for window in (2, 3, 5):
        rows = lines.fingerprints(df, window)
        assert abs(rows.count() / (40 * 60) - 2 / (window + 1)) < 0.08
        assert lines.repeated_windows(df, window).count() == 0
    passage = "\n".join(f"passage {i}" for i in range(9))
    text = dict(plain)
    changed = [(i, t if i % 4 else t.replace("\n", f"\n{passage}\n", 1)) for i, t in plain]
    for window in (2, 3, 5):
        left = {r.doc_id: r.text for r in lines.without_repeated_lines(spark.createDataFrame(changed, "doc_id long, text string"), window).collect()}
        assert all(left[i] == (t if i == 0 else text[i]) for i, t in changed)
