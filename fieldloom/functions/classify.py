"""Ordered rules: the first that matches decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIP, DEFAULT_MATERIAL = "__skip__", "composite"


@dataclass(frozen=True)
class Rule:
    """match: exact (as written), contains or startswith (whatever the case)."""

    match: str
    pattern: str
    result: str


def _hit(text: Column, match: str, pattern: Column) -> Column:
    low, sought = F.lower(text), F.lower(pattern)
    return {"exact": text == pattern, "contains": F.contains(low, sought), "startswith": F.startswith(low, sought)}[match]


def first_match(text: Column, rules: Sequence[Rule], default: str | None = DEFAULT_MATERIAL) -> Column:
    """Literal rules as one CASE."""
    out = F.lit(default).cast("string")
    for rule in reversed(rules):
        out = F.when(_hit(text, rule.match, F.lit(rule.pattern)), F.lit(rule.result)).otherwise(out)
    return out


# Words by which objects are named, in the order in which they are looked for.
ROBOT_ARM, WINDOW_MATERIAL = "robot_arm", "glass"
#: (class, names of whole models, parts of the text, parts of the text between blanks)
SEMANTIC_RULES = (
    ("drone", ("x500",), (), ()),
    ("shelf", (), ("picking_shelves", "shelf_"), (" shelf",)),
    ("desk", ("desk", "desk_0", "desk_1", "coffeetable"), ("desk", "table"), ()),
    ("door", (), ("factory_door", "_door", "door_"), (" door",)),
    ("window", (), ("window",), ()),
    ("box", (), ("clutteringc", "box", "crate"), ()),
    ("chair", (), ("officechair", "chair", "sofa"), ()),
    ("robot", ("naoh25v40", "cerberus_anymal_c_sensor_config_1"), ("cerberus_anymal", "naoh25v40"), ()),
    ("bin", (), ("trashbin", "_bin"), (" bin",)),
    ("laptop", ("monitorandkeyboard",), ("monitor", "keyboard", "laptop"), ()),
)


def semantic_class(model: Column, parts: Sequence[Column], material: Column, dynamic_models: Sequence[str], allowed: Sequence[str]) -> Column:
    """The first class whose words are found; then null if it isn't allowed (later classes aren't tried).

    model: the model's name; parts: it and the other names that are searched, joined by bars."""
    text = F.lower(F.concat_ws(" | ", *parts))
    padded = F.concat(F.lit(" "), F.replace(text, F.lit("|"), F.lit(" ")), F.lit(" "))
    name = F.lower(F.trim(model))
    found = F.lit(None).cast("string")
    for kind, models, words, spaced in reversed(SEMANTIC_RULES):
        tests = [name.isin(*models)] if models else []
        tests += [F.contains(text, F.lit(w)) for w in words] + [F.contains(padded, F.lit(w)) for w in spaced]
        if kind == "drone":
            tests.append(F.startswith(padded, F.lit(" x500 ")))
        if kind == "window":
            tests.append(F.coalesce(material == WINDOW_MATERIAL, F.lit(False)) & F.contains(text, F.lit("glass")))
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        found = F.when(hit, F.lit(kind)).otherwise(found)
    found = F.when(model.isin(*dynamic_models), F.lit(ROBOT_ARM)).otherwise(found) if dynamic_models else found
    return F.when(found.isin(*allowed), found)
