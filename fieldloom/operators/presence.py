"""Which keys JSON documents have, as VARIANT: absent, null and wrongly typed ones are told apart, and so are documents that
are no JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What VARIANT calls the types that a key may be asked for.
TYPES = {
    "string": r"STRING",
    "integer": r"BIGINT|DECIMAL\(\d+,0\)",
    "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)",
    "boolean": r"BOOLEAN",
    "object": r"OBJECT<.*>",
    "array": r"ARRAY<.*>",
}


def _state(document: Column, key: str, wanted: str) -> Column:
    mark = '"' if "'" in key else "'"
    if mark in key:
        raise ValueError(f"a path can't name {key}")
    found = F.call_function("variant_get", document, F.lit(f"$[{mark}{key}{mark}]"))
    kind = F.schema_of_variant(found)
    other = F.when(kind.startswith("OBJECT"), F.lit("object")).when(kind.startswith("ARRAY"), F.lit("array")).when(kind.startswith("DECIMAL"), F.lit("number"))
    other = F.coalesce(other, F.lower(F.replace(F.replace(kind, F.lit("BIGINT"), F.lit("integer")), F.lit("DOUBLE"), F.lit("number"))))
    return F.when(found.isNull(), F.lit("absent")).when(F.is_variant_null(found), F.lit("null")).when(kind.rlike(f"^(?:{TYPES[wanted]})$"), F.lit("present")).otherwise(F.concat(F.lit("is "), other))


def key_states(documents: DataFrame, text: str, expected: Mapping[str, str]) -> DataFrame:
    """A row for each document and key: the other columns, key and state, which is present, absent, null, `is <type>` (not
    the wanted one) or unknown (a key that isn't expected). expected: a type of TYPES for each key of the top level. Texts that
    are null, no JSON or no object give no rows; `broken_documents` has those."""
    others = [c for c in documents.columns if c != text]
    rows = documents.withColumn("__v", F.try_parse_json(F.col(text))).where(F.schema_of_variant("__v").startswith("OBJECT"))
    states = [F.struct(F.lit(k).alias("key"), _state(F.col("__v"), k, t).alias("state")) for k, t in expected.items()]
    more = F.array_except(F.json_object_keys(F.col(text)), F.array(*map(F.lit, expected)).cast("array<string>"))
    unknown = F.transform(F.array_sort(F.coalesce(more, F.array().cast("array<string>"))), lambda k: F.struct(k.alias("key"), F.lit("unknown").alias("state")))
    return rows.select(*[F.col(f"`{c}`") for c in others], F.inline(F.concat(F.array(*states), unknown) if states else unknown))


def broken_documents(documents: DataFrame, text: str) -> DataFrame:
    """The documents that are no JSON object: the other columns, and error (what is wrong), line and place in it, from 1, null
    where the text is JSON of another kind or null. Only such texts are looked at again."""
    others = [F.col(f"`{c}`") for c in documents.columns if c != text]

    @F.pandas_udf("struct<error:string,line:int,place:int>")
    def fault(values: pd.Series) -> pd.DataFrame:
        out: list[Sequence[str | int | None]] = []
        for value in values:
            try:
                json.loads(value)
                out.append(("cannot be read", None, None))
            except json.JSONDecodeError as e:
                out.append((e.msg, e.lineno, e.colno))
            except RecursionError:
                out.append(("nested too deeply", None, None))
        return pd.DataFrame(out, columns=["error", "line", "place"]).astype({"line": "Int32", "place": "Int32"})

    v = F.try_parse_json(F.col(text))
    bad = documents.withColumn("__kind", F.schema_of_variant(v)).where(F.col("__kind").isNull() | ~F.col("__kind").startswith("OBJECT"))
    other = F.when(F.col(text).isNull(), F.lit("no text")).otherwise(F.lit("not an object"))
    whole = bad.where(F.col(text).isNull() | F.col("__kind").isNotNull()).select(*others, other.alias("error"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("place"))
    faulty = bad.where(F.col(text).isNotNull() & F.col("__kind").isNull()).withColumn("__fault", fault(F.col(text))).select(*others, "__fault.error", "__fault.line", "__fault.place")
    return whole.unionAll(faulty)
