"""Tables of ordered rules: one automaton over all patterns, the matching rule with the smallest index decides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.classify import DEFAULT_MATERIAL
from fieldloom.operators.rounds import settled

#: Characters of patterns (with 16 for each rule) that go to every task at once, some hundred MB as an automaton; a larger
#: table takes more passes over the rows.
MOST_CHARS = 8_000_000

Found = tuple[int, str | None]


class Rules:
    """Of rules (rule_idx, match_type, pattern, result): the first that matches a text. An automaton reads a
    text once for all `contains` and `startswith` patterns, which are in lower case; `exact` ones are looked up."""

    def __init__(self, rows: Sequence[tuple[int, str, str, str | None]]):
        self.exact: dict[str, Found] = {}
        self.always: Found | None = None
        found: dict[str, dict[str, Found]] = {}
        for idx, match, pattern, result in sorted(rows, key=lambda r: (r[0], r[3] is None, r[3] or "")):
            own = (idx, result)
            if match == "exact":
                self.exact.setdefault(pattern, own)
            elif not pattern:
                self.always = self.always or own
            else:
                found.setdefault(pattern, {}).setdefault(match, own)
        self.automaton = ahocorasick.Automaton()
        for pattern, kinds in found.items():
            self.automaton.add_word(pattern, (len(pattern), kinds.get("contains"), kinds.get("startswith")))
        if found:
            self.automaton.make_automaton()

    @staticmethod
    def _before(a: Found | None, b: Found | None) -> Found | None:
        order = lambda x: (x[0], x[1] is None, x[1] or "")
        return a if b is None or (a is not None and order(a) <= order(b)) else b

    def first(self, text: str | None, low: str | None) -> Found | None:
        """low: the text in lower case."""
        if text is None:
            return None
        best = self._before(self.exact.get(text), self.always)
        if len(self.automaton):
            for end, (size, contains, startswith) in self.automaton.iter(low):
                best = self._before(best, contains)
                if end + 1 == size:
                    best = self._before(best, startswith)
        return best


@lru_cache(maxsize=2)
def _built(sent: Broadcast) -> Rules:
    return Rules(sent.value)


def _first(sent: Broadcast, text: Column) -> Column:
    @F.pandas_udf("struct<idx:long,result:string>")
    def first(own: pd.Series, low: pd.Series) -> pd.DataFrame:
        rules = _built(sent)
        seen: dict[str | None, Found] = {}
        for a, b in zip(own, low, strict=True):
            if a not in seen:
                seen[a] = rules.first(a, b) or (None, None)
        return pd.DataFrame([seen[a] for a in own], columns=["idx", "result"]).astype({"idx": "Int64", "result": "object"})

    return first(text, F.lower(text))


def match_table(df: DataFrame, text: Column, rules: DataFrame, default: str | None = DEFAULT_MATERIAL, most_chars: int = MOST_CHARS) -> DataFrame:
    """`df`, every row, with the column result: that of the matching rule with the smallest index, of equal ones the
    first result by name. rules: (rule_idx, match_type, pattern, result), match_type exact (as written), contains or
    startswith (whatever the case); others, and null patterns or indices, match nothing, nor does anything a null text. The rules go to
    the tasks in parts of a measured size, so rows are neither shuffled nor multiplied."""
    low = F.when(F.col("match_type") == "exact", F.col("pattern")).otherwise(F.lower("pattern"))
    kinds = F.col("match_type").isin("exact", "contains", "startswith") & F.col("pattern").isNotNull() & F.col("rule_idx").isNotNull()
    own = settled(rules.where(kinds).select(F.col("rule_idx").cast("long").alias("rule_idx"), "match_type", low.alias("pattern"), "result"), "rules")
    parts = max(1, -(-int(own.agg(F.coalesce(F.sum(F.length("pattern") + 16), F.lit(0))).first()[0]) // most_chars))
    context, out = df.sparkSession.sparkContext, df.withColumn("__best", F.lit(None).cast("struct<idx:long,result:string>"))
    for k in range(parts):
        some = [tuple(r) for r in own.where(F.pmod(F.xxhash64("rule_idx", "match_type", "pattern"), F.lit(parts)) == k).collect()]
        found = _first(context.broadcast(some), text)
        # of structs the least index, then the least result; none is after all others
        order = lambda c: F.when(c["idx"].isNotNull(), F.struct(c["idx"].alias("idx"), c["result"].isNull().alias("none"), c["result"].alias("result")))
        out = out.withColumn("__found", found).withColumn("__best", F.least(order(F.col("__best")), order(F.col("__found"))))
        out = out.withColumn("__best", F.when(F.col("__best").isNotNull(), F.struct("__best.idx", "__best.result"))).drop("__found")
        out = settled(out, "matched") if k < parts - 1 else out
    result = F.when(F.col("__best.idx").isNull(), F.lit(default)).otherwise(F.col("__best.result"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(result, F.lit(default)).alias("result"))
