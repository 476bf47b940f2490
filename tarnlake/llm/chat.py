"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A layout's fingerprint is the SHA-256 of its sorted nested field paths (arrays as "[]"), of a
table's schema or of JSON records. ``MAPPINGS`` says for each known layout how its records become
turns (role, text): prompt and completion columns, instruction/input/output, message lists with
role/content or from/value, and rows by turn. ``canonical`` applies the mapping of a table,
``canonical_json`` that of each record by its own fingerprint. A table that has more columns than
a layout (a fingerprint of its own) is read by the largest layout that it holds.

The template writes a turn as <|im_start|>role\\ntext<|im_end|>\\n. Inside texts and roles
backslashes are doubled and every control string of ``CONTROLS`` gets a backslash behind its
first character, so that none stands in a text, and taking the backslashes away again restores
it. A line end in a role is written <|nl|>. ``loss`` holds the places of the assistant texts.

Everything is DataFrame expressions. A conversation becomes one row, because its output is one
string (of 2 GB at most, as any of Spark's); turns are ordered by turn (null first), then role and text.

Defined results: a null role or text is empty; rows with a null conv_id form one conversation;
repeated rows are repeated turns; other columns are ignored; an empty table gives no rows;
a table that holds no known layout raises in ``canonical``; a record of an unknown fingerprint, or
one that is null or no JSON, is returned by ``canonical_json`` as one turn of role record and null
mapping, with the record itself as its text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Control strings of common templates; "<|" and "|>" cover every <|...|>.
CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; arrays are "[]"."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(field_paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()


#: Field paths of each layout (the id aside), and its mapping: turns from columns (role, field),
#: where an optional field that is null or empty gives no turn; from a list (list, role, text);
#: or rows by turn.
LAYOUTS: dict[str, tuple[list[str], dict]] = {
    "prompt": (["prompt", "completion"], {"columns": [("user", ["prompt"]), ("assistant", ["completion"])]}),
    "prompt_response": (["prompt", "response"], {"columns": [("user", ["prompt"]), ("assistant", ["response"])]}),
    "instruction": (["instruction", "input", "output"], {"columns": [("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    "instruction_short": (["instruction", "output"], {"columns": [("user", ["instruction"]), ("assistant", ["output"])]}),
    "instruction_system": (["system", "instruction", "input", "output"], {"columns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    "messages": (["messages[].role", "messages[].content"], {"list": ("messages", "role", "content")}),
    "conversations": (["conversations[].from", "conversations[].value"], {"list": ("conversations", "from", "value")}),
    "rows": (["turn", "role", "text"], {"rows": True}),
}
MAPPINGS = {fingerprint(p): (name, mapping) for name, (p, mapping) in LAYOUTS.items()}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in ROLES.items():
        out = F.when(out == old, new).otherwise(out)
    return out


def _pair(role: str, text: str):
    return lambda x: F.struct(_role(x[role]).alias("role"), x[text].cast("string").alias("text"))


def _columns(mapping: dict, get) -> Column:
    """Turns of a mapping with columns; get(name) is a field as a string."""
    turns = []
    for role, fields in mapping["columns"]:
        text = F.concat_ws("\n\n", *[F.nullif(get(f), F.lit("")) for f in fields])
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    keep = {role for role, _ in mapping["columns"]} - {"system"}
    return F.filter(F.array(*turns), lambda x: x["role"].isin(*keep) | (x["text"] != ""))


def mapping_of(field_paths: list[str]) -> tuple[str, dict] | None:
    """The mapping of these paths' fingerprint; else that of the largest layout among them."""
    exact = MAPPINGS.get(fingerprint(field_paths))
    if exact is not None:
        return exact
    held = [(name, layout) for name, layout in LAYOUTS.items() if set(layout[0]) <= set(field_paths)]
    if not held:
        return None
    name, (_, mapping) = max(held, key=lambda x: len(x[1][0]))
    return name, mapping


def canonical(table: DataFrame, key: str) -> DataFrame:
    """conv_id, turn, role, text from a table of any known layout; key is its id column, and
    columns that the layout doesn't know are ignored."""
    known = {p.split("[")[0].split(".")[0] for layout, _ in LAYOUTS.values() for p in layout}
    rest = [f for f in table.schema if f.name in known and f.name != key]
    found = mapping_of([p for f in rest for p in paths(T.StructType([f]))])
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(f.name for f in rest)}")
    mapping = found[1]
    if "rows" in mapping:
        return table.select(F.col(key).alias("conv_id"), "turn", "role", "text")
    if "columns" in mapping:
        turns = _columns(mapping, lambda name: F.col(name).cast("string"))
    else:
        name, role, text = mapping["list"]
        turns = F.transform(name, _pair(role, text))
    return _exploded(table, key, turns)


def _exploded(table: DataFrame, key: str, turns: Column, *more: Column) -> DataFrame:
    rows = table.select(F.col(key).alias("conv_id"), *more, F.posexplode(turns).alias("turn", "x"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("x.role").alias("role"), F.col("x.text").alias("text"), *rows.columns[1:-2])


def json_fingerprint(record: Column) -> Column:
    """Of a JSON record: its fields, and those of the first element of a messages or
    conversations list, as paths."""
    lists = []
    for name in ("messages", "conversations"):
        inner = F.split(F.concat(F.lit(f"{name}[]."), F.array_join(F.json_object_keys(F.get_json_object(record, f"$.{name}[0]")), f"\n{name}[].")), "\n")
        lists.append(F.coalesce(inner, F.array().cast("array<string>")))
    top = F.filter(F.json_object_keys(record), lambda k: ~k.isin("messages", "conversations", "id", "conv_id"))
    return F.sha2(F.array_join(F.array_sort(F.concat(F.coalesce(top, F.array().cast("array<string>")), *lists)), "\n"), 256)


def canonical_json(table: DataFrame, key: str, record: str) -> DataFrame:
    """conv_id, turn, role, text, mapping (the layout's name) from JSON records of mixed layouts, each
    by its own fingerprint. Records without a mapping come as one turn of role record."""
    json, mark = F.col(record), json_fingerprint(F.col(record))
    turns = used = None
    for print_, (layout, mapping) in MAPPINGS.items():
        if "columns" in mapping:
            one = _columns(mapping, lambda name: F.get_json_object(json, f"$.{name}"))
        elif "list" in mapping:
            name, role, text = mapping["list"]
            parsed = F.from_json(F.get_json_object(json, f"$.{name}"), f"array<struct<`{role}`:string,`{text}`:string>>")
            one = F.transform(parsed, _pair(role, text))
        else:
            continue
        one = one.cast(TURNS)
        turns = F.when(mark == print_, one) if turns is None else turns.when(mark == print_, one)
        used = F.when(mark == print_, layout) if used is None else used.when(mark == print_, layout)
    whole = F.array(F.struct(F.lit("record").alias("role"), json.alias("text"))).cast(TURNS)
    return _exploded(table, key, F.coalesce(turns, whole), F.when(turns.isNotNull(), used).alias("mapping"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start, length in code points) of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = own.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END) + 1
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = pieces.select(
        "conv_id",
        F.row_number().over(order).alias("i"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("head")).alias("start"),
        F.length("body").cast("long").alias("length"),
        (F.col("role") == "assistant").alias("learned"),
        F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
    )
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "start", "length", "learned", "piece"))).alias("turns"))
    loss = F.transform(F.filter("turns", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    parts = F.filter(F.split(formatted, r"\Q" + END + r"\E\n", -1), lambda p: p != "")

    def turn(part: Column) -> Column:
        line = F.locate("\n", part)
        role = F.substring(part, F.lit(len(START) + 1), line - len(START) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(part, line + 1, F.length(part))).alias("text"))

    return F.transform(parts, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """Of what is read back from the output alone."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    out = formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("learned"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
