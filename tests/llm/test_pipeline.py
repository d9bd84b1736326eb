"""The pipeline against a plain version of each stage on the stage's own input."""

import corpus_pipeline
import pyarrow as pa
from fieldloom.llm import batches, langid

from test_decontam import brute as leaks
from test_lines import brute as line_rest
from test_neardup import brute as groups
from test_packing import check as check_packed


def test_each_stage_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages, at = docs.columns, dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["language", "lines", "near_duplicates", "benchmark", "packing"]
    before = docs
    for name in list(stages)[:-1]:
        before = stages[name](spark, before, sf_dir).cache()
        assert before.columns == columns
        at[name] = {r.doc_id: r.text for r in before.collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    model = langid.train(docs)
    named = set()
    for d, t in texts.items():
        (name,), _, (off,) = model.predict(next(batches.texts(pa.array([t], pa.string()))), judged=True)
        if name != "und" and off >= -langid.DEVIATIONS:
            named.add(d)
    assert at["language"] == {d: t for d, t in texts.items() if d in named} and len(named) > 0.98 * len(texts)
    want, touched = line_rest(list(at["language"].items()), 2)
    assert at["lines"] == {d: t for d, t in want.items() if d not in touched or t.strip()}
    root = groups(list(at["lines"].items()))
    assert at["near_duplicates"] == {d: t for d, t in at["lines"].items() if root[d] == d}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in leaks(list(at["near_duplicates"].items()), bench)}
    assert at["benchmark"] == {d: t for d, t in at["near_duplicates"].items() if d not in bad}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packed(rows, at["benchmark"])


def test_extra_columns_nulls_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, line int"
    docs = spark.createDataFrame([(1, None, None, None, None, 1, 1), (None, "the of and with", "en", None, 3, 2, 2), (3, "", "en", "s", 0, None, None)], schema)
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.schema.simpleString() == df.schema.simpleString() and out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() == df.count()
