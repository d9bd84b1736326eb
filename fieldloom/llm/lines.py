"""Line deduplication: winnowed line hashes find runs of lines that stand earlier in the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.staging import staged

#: Any run of this many lines that are not blank is found when it stands earlier in the corpus.
WINDOW = 2
#: A line of this many words (parts between blanks) counts as such a run by itself.
LONG_WORDS = 50
#: What is taken off the ends of a line before it is compared.
BLANKS = " \t\r\x0b\x0c\u00a0"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(docs: DataFrame, body: Callable[[Column], Column]) -> DataFrame:
    """doc_id and the structs that `body` makes of each document's lines that aren't blank."""
    lines = F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x != "")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(_let(lines, body)))


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, line, print, around): the lines that winnowing selects, blank lines not counted.

    A line is selected if its hash is the smallest (on a tie the last such) in a run of `window` lines, so equal runs
    select the same line of them; of n lines about 2n / (window + 1) are. print is the line's hash, around the runs of
    `window` lines that it is in: (start, size, gram), gram being the hash of all their lines. Fewer lines than a
    window give no rows.
    """

    def selected(lines: Column) -> Column:
        run = lambda h, s: F.slice(h, s + 1, window)
        starts = lambda h: F.sequence(F.lit(0), F.size(h) - window)
        last = lambda h, s: s + window - F.array_position(F.reverse(run(h, s)), F.array_min(run(h, s))).cast("int")
        of = lambda h, i: F.transform(F.sequence(F.greatest(i - window + 1, F.lit(0)), F.least(i, F.size(h) - window)), lambda s: F.struct(s.alias("start"), F.lit(window).alias("size"), F.xxhash64(run(h, s)).alias("gram")))
        rows = lambda h: F.transform(F.array_distinct(F.transform(starts(h), lambda s: last(h, s))), lambda i: F.struct(i.alias("line"), F.get(h, i).alias("print"), of(h, i).alias("around")))
        return _let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) >= window, rows(h)))

    return _windows(docs.where(F.contains("text", F.lit("\n"))) if window > 1 else docs, selected)


def long_lines(docs: DataFrame, words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, start, size, gram): each line of at least so many words as a run of its own."""
    row = lambda x, i: F.when(F.size(F.split(x, " ")) >= words, F.struct(i.alias("start"), F.lit(1).alias("size"), F.xxhash64(F.array(F.xxhash64(x))).alias("gram")))
    return _windows(docs, lambda lines: F.array_compact(F.transform(lines, row)))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, size) of every run of `window` lines, and of every long line, that stands earlier in the corpus.

    Positions whose fingerprint occurs once drop out; so only selected lines are shuffled, and no run yet. The rest
    are extended to both sides, to all runs of `window` lines around them, and equal runs are joined with the first
    of them (the least of each task before the shuffle). Each run that stands earlier has its own fingerprint selected
    at both places, so none is missed; runs that touch are one longer run. The small sides are staged, so that Spark
    can split the joins' hot keys.
    """
    prints = staged(fingerprints(docs, window), "line-prints")
    twice = staged(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "line-repeated")
    runs = prints.join(twice, "print", "left_semi").select("doc_id", F.inline("around"))
    runs = staged(runs.unionByName(long_lines(docs)), "line-runs")
    first = runs.groupBy("gram", "size").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last"))
    first = staged(first.where("first < last").select("gram", "size", "first"), "line-first")
    return runs.join(first, ["gram", "size"]).where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start", "size")


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, dropped array<int>): the lines to delete, numbered without blank lines, ascending."""
    lines = F.flatten(F.transform(F.collect_set(F.struct("start", "size")), lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))
    return repeated_windows(docs, window).groupBy("doc_id").agg(F.array_sort(F.array_distinct(lines)).alias("dropped"))


def _kept(text: Column, dropped: Column) -> Column:
    """`text` without the lines numbered in `dropped`."""

    def rest(lines: Column) -> Column:
        full = F.filter(F.transform(lines, lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull())
        gone = _let(full, lambda at: F.transform(dropped, lambda k: F.get(at, k)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return _let(F.split(text, "\n"), rest)


def without_repeated_lines(docs: DataFrame, window: int = WINDOW, drop_emptied: bool = True) -> DataFrame:
    """The documents, all columns, with each run of `window` or more lines that stands earlier in the corpus
    deleted, and each line of LONG_WORDS words that does (earlier: a smaller doc_id, or further up in the same document).

    Lines are compared without white space at their ends; blank lines don't count and stay. Rows with the same
    doc_id count as one position each line, so none makes another's lines repeated; a null doc_id or text is
    left as it is. A document that loses its last line goes (drop_emptied) or keeps an empty text.
    """
    marks = repeated_lines(docs, window).select(F.col("doc_id").alias("__marked"), F.col("dropped").alias("__dropped"))
    out = docs.join(marks, F.col("doc_id").cast("long") == F.col("__marked"), "left")
    out = out.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("__dropped"))))
    if drop_emptied:
        out = out.where(F.col("__dropped").isNull() | (_trimmed(F.replace("text", F.lit("\n"), F.lit(""))) != ""))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, n_lines (not blank), n_dropped, kept_sha256 (hex, of the text that is left)."""
    kept = without_repeated_lines(docs.select("doc_id", "text", F.col("text").alias("before")), window, drop_emptied=False)
    count = lambda c: F.coalesce(F.size(F.filter(F.split(c, "\n"), lambda x: _trimmed(x) != "")), F.lit(0)).cast("long")
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), count("before").alias("n_lines"), (count("before") - count("text")).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _sql(window: int = WINDOW) -> str:
    blanks = "chr(32) || chr(9) || chr(13) || chr(11) || chr(12) || chr(160)"
    lead = " || chr(10) || ".join(["line", *(f"lead(line, {k}) OVER w" for k in range(1, window))])
    covered = " OR ".join(["bad", *(f"coalesce(lag(bad, {k}) OVER w, false)" for k in range(1, window))])
    return f"""
        WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS full_line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        full_lines AS (
            SELECT doc_id, pos, ltrim(rtrim(full_line, {blanks}), {blanks}) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
            FROM raw WHERE ltrim(rtrim(full_line, {blanks}), {blanks}) <> ''
        ),
        grams AS (SELECT *, {lead} AS gram FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        marked AS (
            SELECT *, coalesce(gram IS NOT NULL AND row_number() OVER (PARTITION BY gram ORDER BY doc_id, n) > 1, false) AS bad,
                len(string_split(line, ' ')) >= {LONG_WORDS} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, n) > 1 AS alone FROM grams
        ),
        dropped AS (SELECT *, {covered} OR alone AS gone FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        kept AS (
            SELECT raw.doc_id, count(d.n) AS n_lines, count(*) FILTER (WHERE d.gone) AS n_dropped,
                string_agg(full_line, chr(10) ORDER BY raw.pos) FILTER (WHERE NOT coalesce(d.gone, false)) AS text
            FROM raw LEFT JOIN dropped d ON d.doc_id = raw.doc_id AND d.pos = raw.pos GROUP BY raw.doc_id
        )
        SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM documents LEFT JOIN kept USING (doc_id)"""


REPORT_SQL = _sql()
