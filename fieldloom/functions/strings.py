"""Column builders for names, identifiers and small text formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _default(value: Column, default: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(value)


def slugify(text: Column, default: str = "item") -> Column:
    """Lower case, each run of other characters than letters and digits one `_`, none at the ends."""
    return _default(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), F.lit("_")), default)


def safe_slug(text: Column) -> Column:
    return slugify(F.trim(text), "value")


def safe_filename(text: Column, default: str = "unnamed") -> Column:
    """Keeps case, letters, digits and `_ . -`; every other character becomes `_`; none at the ends."""
    return _default(F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_"), F.lit("_")), default)


def quoted_value(line: Column) -> Column:
    """What stands between the first and the last double quote; null without two."""
    return F.when(F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit(""))) >= 2, F.regexp_extract(line, r'(?s)"(.*)"', 1))


def scoped_parts(name: Column, mark: str = "::") -> Column:
    """struct(scope, name) of a name with exactly one mark and two parts that aren't empty; else null."""
    parts = F.split(name, mark)
    good = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("scope"), F.get(parts, F.lit(1)).alias("name")))


def composite_id(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def frame_name(frame: Column, prefix: str = "frame_") -> Column:
    """Numbers have three digits at least."""
    return F.format_string(f"{prefix}%03d", frame)


def numeric_list(text: Column, size: int, separator: str = r"\s+") -> Column:
    """array<double> of exactly `size` numbers; null where one isn't a number or the count differs."""
    values = F.split(F.trim(text), separator).try_cast("array<double>")
    # sorted, a null comes first
    return F.when((F.size(values) == size) & F.get(F.sort_array(values), F.lit(0)).isNotNull(), values)


def short_key(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, length)


def receiver_label(name: Column) -> Column:
    """Without the affixes rx_ and _base."""
    return F.regexp_replace(name, "^rx_|_base$", "")


def elapsed(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long"))


def lenient_double(text: Column) -> Column:
    """Null for what isn't a finite number."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def strict_double(text: Column, name: str) -> Column:
    """The number, or an error that names the column."""
    value = lenient_double(text)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no finite number: "), F.coalesce(text, F.lit("null")))).cast("double"))


def bool_text(text: Column) -> Column:
    """true and false, whatever their case; else null."""
    low = F.lower(F.trim(text))
    return F.when(low == "true", True).when(low == "false", False)


def binary_label(text: Column) -> Column:
    """0 or 1 of the texts 0, 0.0, 1 and 1.0; else null."""
    return F.when(F.trim(text).isin("0", "0.0"), 0).when(F.trim(text).isin("1", "1.0"), 1)


def general_text(value: Column, digits: int = 6) -> Column:
    """The shortest of fixed and exponent notation with so many significant digits and no zeros at the end; Spark's
    own format keeps the zeros. Zero keeps its sign; what isn't a number is `nan`, and only null is null."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{digits}g}").astype(object)

    return F.when(value.isNotNull(), text(value.cast("double")))


def rerooted(path: Column, root: str, marker: str) -> Column:
    """`path` from the last `marker` folder on, below `root`; null where it has none."""
    tail = F.regexp_extract(path, rf"(?:^|.*/)({marker}/.*)$", 1)
    return F.when(tail != "", F.concat(F.lit(root.rstrip("/") + "/"), tail))
