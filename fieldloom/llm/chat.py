"""Chat records of many layouts as canonical turns, and their formatting with a loss mask. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"
#: Turns of a conversation that are joined before the conversation is.
BLOCK_TURNS = 256

# -- schema fingerprints -------------------------------------------------------------------------------------


def nested_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves: fields by dots, list elements by []."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in nested_paths(f.dataType, f"{at}.{f.name}".lstrip(".")))
    if isinstance(kind, T.ArrayType):
        return nested_paths(kind.elementType, f"{at}[]")
    return [at]


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the paths that a record of this layout has, and where its turns are."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    #: (role, path) of single turns; absent ones are left out.
    single: tuple[tuple[str, str], ...] = ()
    #: (list, role field, text field) of listed turns.
    listed: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)
    #: (conversation, turn, role, text) where each record is one turn of a conversation.
    rows: tuple[str, str, str, str] | None = None

    def path_sets(self) -> list[list[str]]:
        return [sorted(self.required + extra) for n in range(len(self.optional) + 1) for extra in combinations(self.optional, n)]


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), listed=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("system",), (("system", "system"),), ("conversations", "from", "value"), {"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Layout("prompt_completion", ("completion", "prompt"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("answer", "question"), ("system",), (("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("message_rows", ("content", "message_index", "role", "thread_id"), rows=("thread_id", "message_index", "role", "content")),
)
KNOWN_PATHS = tuple(sorted({p for x in LAYOUTS for p in x.required + x.optional}))


def fingerprint(paths: Column) -> Column:
    """Hash of an ordered list of paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def _number(paths: list[str]) -> int:
    """The same hash on the driver."""
    n = xxhash.xxh64_intdigest("\n".join(paths).encode(), seed=42)
    return n - (1 << 64) * (n >> 63)


#: The mapping that each hash of a set of paths selects.
REGISTRY = {_number(paths): x for x in LAYOUTS for paths in x.path_sets()}


def _keys(value: Column) -> Column:
    """The field names of a variant object; null for other values."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def record_paths(record: Column) -> Column:
    """The nested paths of a variant object's fields, whatever their values: fields of objects by dots, fields of the
    objects in a list, of any of them, by []."""

    def below(e: Column) -> Column:
        items = F.try_variant_get(e["value"], "$", "array<variant>")
        inner = F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(_keys(x), F.array().cast("array<string>")))))
        of = lambda keys, mark: F.transform(keys, lambda k: F.concat(e["key"], F.lit(mark), k))
        found = F.when(items.isNotNull(), of(inner, "[].")).otherwise(of(_keys(e["value"]), "."))
        return F.when(F.size(found) > 0, found).otherwise(F.array(e["key"]))

    fields = F.map_entries(F.try_variant_get(record, "$", "map<string,variant>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fields, below))))


def _value(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, "$." + path, kind)


def canonical_records(df: DataFrame, column: str = "record") -> DataFrame:
    """Adds layout string, fingerprint long and turns array<struct<role,text>> to rows with a JSON record each.

    The record's nested paths are taken, whatever their values are and from all elements of a list; those that no
    layout knows are left out, the others hashed, and the hash selects the mapping. Records that are null, no JSON
    objects or of no known layout have layout and turns null, as have layouts with a record for each turn, which
    `canonical_rows` takes. Texts and roles that are null, or missing in one element of a list, become empty; so does
    a null single turn, but an optional one (system) is left out. Very long records are taken whole, repeated rows come out as often, an empty table
    gives none. Existing columns with these names are replaced; other columns stay.
    """
    record = F.try_parse_json(F.col(column))
    known = F.array_intersect(record_paths(record), F.array(*map(F.lit, KNOWN_PATHS)))
    df = df.withColumns({"__record": record, "fingerprint": fingerprint(known)})
    record = F.col("__record")
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for x in LAYOUTS:
        if x.rows:
            continue
        hit = F.col("fingerprint").isin(*[n for n, layout in REGISTRY.items() if layout is x])
        parts = [_single(record, role, path, path in x.optional) for role, path in x.single]
        if x.listed:
            parts.append(_listed(record, *x.listed, x.roles))
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        turns = F.when(hit, F.concat(*parts)).otherwise(turns)
    return df.withColumns({"layout": name, "turns": turns}).drop("__record")


def _single(record: Column, role: str, path: str, optional: bool) -> Column:
    first, *rest = path.split("+")
    value = _value(record, first)
    text = F.concat_ws("\n", F.coalesce(value, F.lit("")), *[F.nullif(_value(record, p), F.lit("")) for p in rest])
    turn = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.when(value.isNull(), F.array().cast(TURN)).otherwise(turn) if optional else turn


def _listed(record: Column, name: str, role: str, text: str, roles: dict[str, str]) -> Column:
    found = F.try_variant_get(record, f"$.{name}", f"array<struct<`{role}`:string,`{text}`:string>>")

    def turn(m: Column) -> Column:
        own = F.coalesce(m[role], F.lit(""))
        for old, new in roles.items():
            own = F.when(m[role] == old, F.lit(new)).otherwise(own)
        return F.struct(own.alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))

    return F.transform(F.coalesce(found, F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")), turn)


def canonical_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table with a row for each turn.

    The nested paths of the table's schema, those that no layout knows left out, are hashed, and the hash selects the
    mapping; without one it is an error. Null texts and roles become empty; repeated rows come out as often.
    """
    found = [p for p in nested_paths(df.schema) if p in KNOWN_PATHS]
    layout = REGISTRY.get(_number(sorted(found)))
    if layout is None or not layout.rows:
        raise ValueError(f"no mapping for the paths {nested_paths(df.schema)}")
    conversation, turn, role, text = layout.rows
    empty = F.lit("")
    return df.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))


# -- template ------------------------------------------------------------------------------------------------

OPEN, CLOSE, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"
#: Strings that a chat tokenizer may take as control tokens.
CONTROL = (OPEN, CLOSE, "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    header = F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "\n"))
    return F.concat(F.lit(OPEN), header, F.lit("\n"), escape(text), F.lit(CLOSE + "\n"))


def format_turns(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, formatted): turns by turn, then role and text; a null turn comes first, a null conv_id is one
    more conversation, repeated rows are turns of their own. Long conversations are joined block by block."""
    block = F.floor(F.col("turn") / block_turns)
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    blocks = blocks.select("conv_id", "block", F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("part"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"))


def format_records(records: DataFrame) -> DataFrame:
    """Adds the string formatted to rows with turns (null where turns is)."""
    return records.withColumn("formatted", F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), ""))


def parsed(formatted: Column) -> Column:
    """The turns that a formatted text holds, read back from it: role, text, loss (assistant texts are learned)."""
    closed = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.filter(closed, lambda x: x.startswith(OPEN)), lambda x: F.substr(x, F.lit(len(OPEN) + 1)))

    def turn(body: Column) -> Column:
        header = F.regexp_extract(body, r"^([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n", 1)
        role = unescape(header)
        return F.struct(role.alias("role"), unescape(F.substr(body, F.length(header) + 2)).alias("text"), (role == "assistant").alias("loss"))

    return F.transform(bodies, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks of each conversation, from its formatted text alone."""
    read = formatted.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"))
    read = read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all_text"),
        F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id", "n_turns", F.sha2("all_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars"
    )


def _sql() -> str:
    escaped = "replace({0}, '\\', '\\\\')"
    for c in CONTROL:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    marks = len(OPEN) + 1 + len(CLOSE) + 1
    return f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum({marks} + length(replace({escaped.format("role")}, chr(10), '\\' || chr(10))) + length({escaped.format("text")}))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id"""


DIGESTS_SQL = _sql()
