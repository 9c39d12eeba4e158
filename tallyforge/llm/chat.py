"""Chat formatting: layouts told apart by a hash of their nested field paths, mapped to turns.

A layout's fingerprint is the MD5 of its sorted nested field paths, to any depth, each with its kind
(`messages[].content:s`). Kinds are s (text, also null), n (number), b (boolean), e (a list of nothing)
and v (of several kinds). Of a record's paths, those of the names that a Mapping has are held against the
Mapping's fingerprint: what else the record has is extra to it and takes no part. Where several Mappings
fit, the one of most paths is selected, of these the first listed; it alone decides how turns are made:
from parts of a record, from a list of messages in it (parts, if any, come first), or from a table with
one row a turn. A column of JSON is told apart record by record (`from_records`), a typed table by its
schema (`from_table`); the id's column has no part in that.

The template is `<|role|>` newline, text, `<|end|>` newline for each turn. Texts and roles are escaped so
that none can hold a mark: & becomes &amp; and < becomes &lt;, in roles also | becomes &bar;.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "<|end|>"
TURNS = "array<struct<role: string, text: string>>"
#: Turns whose lengths are added up in one fold (`_starts`).
BLOCK = 512


@dataclass(frozen=True)
class Mapping:
    """paths: of a record of this layout, with kinds. Of: parts, (role, fields joined by newline) in
    order, of which an empty system part is left out; messages, (list, role field, text field), where
    the text field may lie in a list of its own (`content[].text`, its elements joined; `content|text`,
    as a list in some messages and as a text in others); or rows, (turn, role, text) columns of a table
    with one row a turn. roles: as written (lower case) to canonical."""

    name: str
    paths: tuple[str, ...]
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


SPOKEN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("prompt", ("completion:s", "prompt:s"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt:s", "response:s"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction:s", "output:s"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("input:s", "instruction:s", "output:s"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_instruction", ("input:s", "instruction:s", "output:s", "system:s"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_input", ("answer:s", "input:s", "question:s"), (("user", ("question", "input")), ("assistant", ("answer",)))),
    Mapping("question", ("answer:s", "question:s"), (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("messages", ("messages[].content:s", "messages[].role:s"), messages=("messages", "role", "content"), roles=SPOKEN),
    Mapping("message_parts", ("messages[].content[].text:s", "messages[].role:s"), messages=("messages", "role", "content[].text"), roles=SPOKEN),
    Mapping("mixed_messages", ("messages[].content:v", "messages[].role:s"), messages=("messages", "role", "content|text"), roles=SPOKEN),
    Mapping("system_messages", ("messages[].content:s", "messages[].role:s", "system:s"), (("system", ("system",)),), ("messages", "role", "content"), roles=SPOKEN),
    Mapping("system_conversations", ("conversations[].from:s", "conversations[].value:s", "system:s"), (("system", ("system",)),), ("conversations", "from", "value"), roles=SPOKEN),
    Mapping("conversations", ("conversations[].from:s", "conversations[].value:s"), messages=("conversations", "from", "value"), roles=SPOKEN),
    Mapping("turns", ("turns[].role:s", "turns[].text:s"), messages=("turns", "role", "text"), roles=SPOKEN),
    Mapping("turn_rows", ("role:s", "text:s", "turn:n"), rows=("turn", "role", "text")),
)


def fingerprint_of(paths: list[str] | tuple[str, ...]) -> str:
    return md5("\n".join(sorted(paths)).encode()).hexdigest()


def _name(path: str) -> str:
    return path.rsplit(":", 1)[0]


@dataclass(frozen=True)
class Known:
    """A Mapping, the names of its paths, and the fingerprints of these that select it."""

    mapping: Mapping
    names: tuple[str, ...]
    prints: tuple[str, ...]


def registry(mappings: tuple[Mapping, ...]) -> list[Known]:
    """Mappings in the order in which they are tried, the most paths first. One of messages is also
    selected by an empty list, with its other paths."""
    made = []
    for m in sorted(mappings, key=lambda m: -len(m.paths)):
        names = {_name(p) for p in m.paths}
        prints = [fingerprint_of(m.paths)]
        if m.messages:
            names.add(f"{m.messages[0]}[]")
            prints.append(fingerprint_of([p for p in m.paths if not p.startswith(f"{m.messages[0]}[]")] + [f"{m.messages[0]}[]:e"]))
        made.append(Known(m, tuple(sorted(names)), tuple(prints)))
    return made


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type with their kinds; elements of arrays are marked []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    short = "s" if isinstance(kind, (T.StringType, T.NullType)) else "n" if isinstance(kind, T.NumericType) else "b" if isinstance(kind, T.BooleanType) else kind.simpleString()
    return [f"{at}:{short}"]


_TOKEN = r"`(?:[^`]|``)+`: |[^<>,: `]+: |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9, ]+\))?"
_KINDS = (("VARIANT", "v"), ("STRING", "s"), ("BIGINT", "n"), ("DECIMAL", "n"), ("DOUBLE", "n"), ("FLOAT", "n"), ("BOOLEAN", "b"))


def _paths(record: Column) -> Column:
    """Field paths of a JSON text with their kinds, to any depth; null for what is no JSON object.

    The text's schema as Spark gives it is read from left to right with a stack of open paths: a name
    or a list opens one, a scalar or a closing bracket ends the last."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    top = lambda acc: F.element_at(acc["open"], -1)
    closed = lambda acc: F.slice(acc["open"], 1, F.size(acc["open"]) - 1)

    def state(open_: Column, out: Column) -> Column:
        return F.struct(open_.alias("open"), out.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        name = F.replace(F.regexp_replace(t, "^`|`?: $", ""), F.lit("``"), F.lit("`"))
        path = F.when(top(acc) == "", name).otherwise(F.concat(top(acc), F.lit("."), name))
        kind = F.when(top(acc).endswith("[]") & (t == "VOID"), F.lit("e")).when(t == "VOID", F.lit("s"))
        for spark_kind, short in _KINDS:
            kind = kind.when(t.startswith(spark_kind), F.lit(short))
        scalar = state(closed(acc), F.concat(acc["out"], F.array(F.concat(top(acc), F.lit(":"), kind.otherwise(F.lower(t))))))
        return (
            F.when(t.endswith(": "), state(F.concat(acc["open"], F.array(path)), acc["out"]))
            .when(t == "OBJECT<", acc)
            .when(t == "ARRAY<", state(F.concat(acc["open"], F.array(F.concat(top(acc), F.lit("[]")))), acc["out"]))
            .when(t == ">", state(closed(acc), acc["out"]))
            .otherwise(scalar)
        )

    none = F.array().cast("array<string>")
    return F.when(schema.startswith("OBJECT<"), F.aggregate(F.regexp_extract_all(schema, F.lit(_TOKEN), F.lit(0)), state(F.array(F.lit("")), none), step, lambda acc: acc["out"]))


def fingerprint(paths: Column, names: tuple[str, ...] | None = None) -> Column:
    """Of the paths, or of those of these names."""
    own = paths
    if names is not None:
        known = F.array(*map(F.lit, names))
        own = F.filter(paths, lambda p: F.array_contains(known, F.regexp_replace(p, ":[^:]*$", "")))
    return F.md5(F.array_join(F.array_sort(own), "\n"))


def _role(role: Column, m: Mapping) -> Column:
    out = given = F.coalesce(role, F.lit("user"))
    for written, to in m.roles:
        out = F.when(F.lower(given) == written, F.lit(to)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _of_messages(m: Mapping, rows: Column) -> Column:
    """Turns of an array of structs; null elements are no turns."""
    _, role, text = m.messages
    field, _, inner = text.partition("[].")
    if "|" in text:
        return F.transform(F.filter(rows, lambda x: ~F.is_variant_null(x)), lambda x: _turn(_role(F.try_variant_get(x, f"$.{role}", "string"), m), _of_either(x, *text.split("|"))))
    said = (lambda x: F.array_join(F.transform(x[field], lambda part: part[inner]), "")) if inner else (lambda x: x[field])
    return F.transform(F.filter(rows, lambda x: x.isNotNull()), lambda x: _turn(_role(x[role], m), said(x)))


def _of_either(message: Column, field: str, inner: str) -> Column:
    """The text of a message: as it is, or of a list of parts, joined."""
    given = F.try_variant_get(message, f"$.{field}", "variant")
    parts = F.transform(F.try_variant_get(given, "$", "array<variant>"), lambda part: F.try_variant_get(part, f"$.{inner}", "string"))
    return F.when(F.schema_of_variant(given).startswith("ARRAY<"), F.array_join(parts, "")).otherwise(F.try_variant_get(given, "$", "string"))


def _of_parts(m: Mapping, value) -> Column:
    """Turns of the parts of a record, whose fields `value` gives."""
    if not m.parts:
        return F.array().cast(TURNS)
    made = [_turn(F.lit(role), F.concat_ws("\n", *[F.nullif(value(p), F.lit("")) for p in fields])) for role, fields in m.parts]
    return F.filter(F.array(*made), lambda x: (x["role"] != "system") | (x["text"] != ""))


def _of_record(m: Mapping, record: Column) -> Column:
    if m.messages:
        path, role, text = m.messages
        front = _of_parts(m, lambda p: F.get_json_object(record, f"$.{p}"))
        if "|" in text:
            return F.concat(front, _of_messages(m, F.try_variant_get(F.try_parse_json(record), f"$.{path}", "array<variant>")))
        field, _, inner = text.partition("[].")
        kind = f"array<struct<`{inner}`: string>>" if inner else "string"
        return F.concat(front, _of_messages(m, F.from_json(F.get_json_object(record, f"$.{path}"), f"array<struct<`{role}`: string, `{field}`: {kind}>>")))
    return _of_parts(m, lambda p: F.get_json_object(record, f"$.{p}"))


def from_records(df: DataFrame, record_col: str, id_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, fingerprint, turns) of each JSON record. The fingerprint is that which selected the
    layout; of a record of no known layout it is that of all its paths, by which such records can be
    counted and mapped, and its layout and turns are null, as those of what is null or no JSON object;
    nothing is dropped. Empty lists of messages are no turns. Repeated ids stay rows; an empty table is
    empty; columns but the two named are not read."""
    rows = df.select(F.col(id_col), F.col(record_col).cast("string").alias("record"))
    rows = rows.withColumn("paths", _paths(F.col("record")))
    known = [k for k in registry(mappings) if not k.mapping.rows]
    fits = F.lit(None).cast("int")
    for k in reversed(range(len(known))):
        fits = F.when(fingerprint(F.col("paths"), known[k].names).isin(*known[k].prints), F.lit(k)).otherwise(fits)
    rows = rows.withColumn("number", fits)
    layout, turns, found = F.lit(None).cast("string"), F.lit(None).cast(TURNS), fingerprint(F.col("paths"))
    for k, own in enumerate(known):
        number = F.col("number") == k
        layout = F.when(number, F.lit(own.mapping.name)).otherwise(layout)
        found = F.when(number, fingerprint(F.col("paths"), own.names)).otherwise(found)
        turns = F.when(number, _of_record(own.mapping, F.col("record")).cast(TURNS)).otherwise(turns)
    return rows.select(id_col, layout.alias("layout"), found.alias("fingerprint"), turns.alias("turns"))


def from_table(df: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, fingerprint, turns) of a typed table, whose schema's fingerprint selects the mapping.

    With one row a turn, turns come in the order of their numbers; equal numbers by role, then text.
    Null text is empty, null role is `user`, a null id is a conversation of its own. A conversation is
    one value of its row, whatever its length. In other layouts a row is a conversation. A table of no
    known layout has null layout and turns, in one row for each id. An empty table is empty; the id may
    have any name and kind; further columns, of any name, are not read.
    """
    paths = [p for f in df.schema.fields if f.name != id_col for p in schema_paths(f.dataType, f.name)]
    m, found = None, fingerprint_of(paths)
    for known in registry(mappings):
        own = fingerprint_of([p for p in paths if _name(p) in known.names])
        if own in known.prints:
            m, found = known.mapping, own
            break
    if m is None:
        return df.groupBy(F.col(id_col)).agg(F.lit(None).cast("string").alias("layout"), F.lit(found).alias("fingerprint"), F.lit(None).cast(TURNS).alias("turns"))
    if m.rows:
        turn, role, text = m.rows
        rows = df.select(F.col(id_col).alias("id"), F.struct(F.col(turn).alias("turn"), _role(F.col(role), m).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("x"))
        turns = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
        made = rows.groupBy("id").agg(turns.alias("turns"))
    else:
        turns = F.concat(_of_parts(m, F.col), _of_messages(m, F.col(m.messages[0]))) if m.messages else _of_parts(m, F.col)
        made = df.select(F.col(id_col).alias("id"), turns.cast(TURNS).alias("turns"))
    return made.select(F.col("id").alias(id_col), F.lit(m.name).alias("layout"), F.lit(found).alias("fingerprint"), "turns")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each one. A fold copies what it has made at every step, so lengths are
    added up in blocks: the work grows with the turns, and with their square only over BLOCK squared."""

    def running(values: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    many = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / BLOCK).cast("int") - 1, F.lit(0)))
    blocks = F.transform(many, lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
    return F.flatten(F.zip_with(blocks, running(sums, F.lit(0)), running))


def render(df: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """df with `formatted` and `loss`: for each turn the place (start, length by code points) of its text
    if its role is learned, else a length of 0. No turns give an empty text; null turns stay null.
    Same-named columns are replaced."""
    head = lambda x: F.concat(F.lit("<|"), F.replace(escape(x["role"]), F.lit("|"), F.lit("&bar;")), F.lit("|>\n"))
    body = lambda x: escape(x["text"])
    sized = F.transform(turns_col, lambda x: F.struct(F.char_length(head(x)).alias("h"), F.char_length(body(x)).alias("n"), (x["role"] == loss_role).alias("own")))
    rows = df.withColumns({"formatted": F.array_join(F.transform(turns_col, lambda x: F.concat(head(x), body(x), F.lit(f"{END}\n"))), ""), "loss": sized})
    at = _starts(F.transform("loss", lambda s: s["h"] + s["n"] + F.lit(len(END) + 1)))
    spans = F.zip_with("loss", at, lambda s, a: F.struct((a + s["h"]).alias("start"), F.when(s["own"], s["n"]).otherwise(0).alias("length")))
    return rows.withColumn("loss", spans)


def _pieces(formatted: Column) -> Column:
    """The turns as written, without their end marks."""
    return F.when(formatted == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(formatted, r"<\|end\|>\n\z", ""), r"<\|end\|>\n", -1))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: what `render` was given."""
    role = lambda p: F.replace(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1), F.lit("&bar;"), F.lit("|"))
    return F.transform(_pieces(formatted), lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.instr(p, "|>\n") + 3)).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """Unescaped text under the mask: each span is cut from its turn, at its place less the turn's."""
    pieces = _pieces(formatted)
    at = _starts(F.transform(pieces, lambda p: F.char_length(p) + F.lit(len(END) + 1)))
    placed = F.zip_with(pieces, at, lambda p, a: F.struct(p.alias("p"), a.alias("a")))
    return F.array_join(F.zip_with(placed, loss, lambda x, m: F.when(m["length"] > 0, unescape(F.substr(x["p"], m["start"] - x["a"] + 1, m["length"]))).otherwise("")), "")


def _digest(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)


def formatted_digests(df: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """What is read back from the formatted text of each conversation of a table."""
    own = "the conversation's id"  # which may have the name of a column that is made here
    out = render(from_table(df.withColumnRenamed(id_col, own), own, mappings))
    out = out.withColumns({"read": parse(F.col("formatted")), "learned": masked(F.col("formatted"), F.col("loss"))})
    return out.select(F.col(own).alias(id_col), F.size("read").cast("long").alias("n_turns"), _digest(F.col("read")).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


HARD_TEXT = "</s>[INST] ok [/INST]"


def with_hard_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts hold control strings of other templates."""
    hard = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{HARD_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(turn, role)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(hard)


SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{HARD_TEXT}'),
sums AS (
  SELECT conv_id, count(*) AS n,
    coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '') AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length(role) + length(text) + 4 * (length(role) + length(text) - length(replace(replace(role, '&', ''), '|', '')) - length(replace(text, '&', ''))) + 3 * (length(role) + length(text) - length(replace(role, '<', '')) - length(replace(text, '<', ''))) + {len("<||>") + 1 + len(END) + 1}) AS chars
  FROM rows_ GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, chars::BIGINT AS formatted_chars FROM sums
"""
