"""Chat formatting by schema fingerprint; DataFrame operations only.

A layout is known by the hash of its nested field paths (``messages[].role``, ``prompt``,
...). Each known fingerprint selects a declarative mapping to canonical turns
(role, text). Tables have one fingerprint, taken from their schema; JSON records have
one each, taken from the fields that they fill, so that one column may mix layouts.
Fields that no layout knows are ignored, so extra columns change nothing.

Template of a turn: ``<turn ROLE>\\n`` TEXT ``\\n</turn>\\n``. In TEXT a backslash becomes two
and ``<`` becomes ``\\<``; ROLE is URL-encoded. So ``\\n</turn>`` never occurs inside a text, and
``parsed`` gives back every turn exactly. The loss mask is a list of spans (turn, start,
length in code points of the output) that cover the assistant's escaped texts.

Null role or text: empty. Null turn numbers sort first; equal ones by role, then text.
Rows with a null conversation id form one conversation. An empty table gives no rows.
A record of an unknown layout has null turns and ``layout`` null. A conversation is one
value of the result, so a single one has to fit into a task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free


def _fields(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RECORD = T.StructType(
    [T.StructField("messages", T.ArrayType(_fields("role", "content"))), T.StructField("conversations", T.ArrayType(_fields("from", "value")))]
    + _fields("prompt", "completion", "response", "instruction", "input", "output", "system", "role", "text").fields
)
#: Names of roles in JSON records; the roles of turn rows stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _paths(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        kind, name = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, name = kind.elementType, name + "[]"
        out += _paths(kind, name + ".") if isinstance(kind, T.StructType) else [name]
    return out


KNOWN = sorted(_paths(RECORD))


def fingerprint(paths: list[str]) -> str:
    return hashlib.md5("|".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


def schema_fingerprint(schema: T.StructType) -> str:
    return fingerprint(_paths(schema))


def record_fingerprint(record: Column) -> Column:
    """Of the fields that a record fills."""

    def there(path: str) -> Column:
        if "[]." in path:
            top, leaf = path.split("[].")
            return F.coalesce(F.exists(record[top], lambda x: x[leaf].isNotNull()), F.lit(False))
        return record[path].isNotNull()

    return F.md5(F.array_join(F.filter(F.array(*[F.when(there(p), F.lit(p)) for p in KNOWN]), lambda p: p.isNotNull()), "|"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _named(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(names[role], role)


def _pair(*parts: tuple[str, str]):
    return lambda r: F.array(*[_turn(F.lit(role), r[field]) for role, field in parts])


def _instruction(answer: str, *before: tuple[str, str]):
    def mapping(r):
        asked = F.when(F.coalesce(r["input"], F.lit("")) == "", r["instruction"]).otherwise(F.concat_ws("\n\n", r["instruction"], r["input"]))
        return F.array(*[_turn(F.lit(role), r[f]) for role, f in before], _turn(F.lit("user"), asked), _turn(F.lit("assistant"), r[answer]))

    return mapping


def _layouts() -> list[tuple[str, list[str], object]]:
    found = [
        ("turn rows", ["role", "text"], lambda r: F.array(_turn(r["role"], r["text"]))),
        ("messages", ["messages[].role", "messages[].content"], lambda r: F.transform(r["messages"], lambda m: _turn(_named(m["role"]), m["content"]))),
        ("from/value", ["conversations[].from", "conversations[].value"], lambda r: F.transform(r["conversations"], lambda m: _turn(_named(m["from"]), m["value"]))),
    ]
    for answer in ("completion", "response", "output"):
        found.append((f"prompt/{answer}", ["prompt", answer], _pair(("user", "prompt"), ("assistant", answer))))
        found.append((f"system/prompt/{answer}", ["system", "prompt", answer], _pair(("system", "system"), ("user", "prompt"), ("assistant", answer))))
        for extra in ([], ["input"]):
            name = "/".join(["instruction", *extra, answer])
            found.append((name, ["instruction", *extra, answer], _instruction(answer)))
            found.append((f"system/{name}", ["system", "instruction", *extra, answer], _instruction(answer, ("system", "system"))))
    return found


LAYOUTS = _layouts()


def json_turns(records: DataFrame, json_col: str) -> DataFrame:
    """Adds layout (its name, null if unknown) and turns to records that are JSON objects of any known layout; with underscores behind these names where columns have them."""
    parsed_as, known = (free(c, records.columns) for c in ("own_record", "own_fingerprint"))
    read = records.withColumn(parsed_as, F.from_json(F.col(f"`{json_col}`"), RECORD))
    read = read.withColumn(known, record_fingerprint(F.col(parsed_as)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role string, text string>>")
    for layout, paths, mapping in LAYOUTS:
        here = F.col(known) == fingerprint(paths)
        name, turns = F.when(here, layout).otherwise(name), F.when(here, mapping(F.col(parsed_as))).otherwise(turns)
    return read.withColumns({free("layout", records.columns): name, free("turns", records.columns): turns}).drop(parsed_as, known)


def table_turns(df: DataFrame) -> DataFrame:
    """Adds turns to a table whose schema has a known layout; with underscores behind the name where a column has it."""
    key = schema_fingerprint(df.schema)
    for _, paths, mapping in LAYOUTS:
        if fingerprint(paths) == key:
            return df.withColumn(free("turns", df.columns), mapping({f: F.col(f"`{f}`") for f in {p.split("[]")[0] for p in paths}}))
    raise ValueError(f"no layout has the fields {sorted(set(_paths(df.schema)) & set(KNOWN))}")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\<"), F.lit("<")), F.lit("\\\\"), F.lit("\\"))


END = "\n</turn>\n"


def formatted(turns: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn",), turns_col: str = "turns") -> DataFrame:
    """From rows with an id, order columns and an array ``turns``: conv id, formatted, loss_spans.

    One shuffle, by conversation; offsets are running sums, so long conversations cost in proportion.
    """
    keys = [F.col(c) for c in order]
    rows = turns.select(F.col(conv).alias("conv_id"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], F.posexplode(turns_col).alias("pos", "t"))
    rows = rows.select("*", F.concat(F.lit("<turn "), F.url_encode("t.role"), F.lit(">\n")).alias("head"), escaped(F.col("t.text")).alias("body"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    own = Window.partitionBy("conv_id").orderBy(*[f"k{i}" for i in range(len(keys))], "pos", "t.role", "t.text")
    rows = rows.select(
        "conv_id",
        F.row_number().over(own).alias("n"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("t.role") == "assistant", F.struct((F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("span"),
    )
    one = F.sort_array(F.collect_list(F.struct("n", "piece", "span")))
    got = rows.groupBy("conv_id").agg(one.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["span"].isNotNull()), lambda x: F.struct(x["n"].alias("turn"), x["span"]["start"].alias("start"), x["span"]["length"].alias("length")))
    return got.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(out: DataFrame) -> DataFrame:
    """Adds turns, read back from formatted, and loss_texts, what the spans' starts and lengths cut from it."""
    cut = F.split("formatted", END, -1)
    pieces = F.slice(cut, 1, F.size(cut) - 1)
    after = lambda p: F.locate(">\n", p)
    turn = lambda p: F.struct(F.url_decode(F.substring(p, F.lit(7), after(p) - 7)).alias("role"), unescaped(F.substring(p, after(p) + 2, F.length(p))).alias("text"))
    read = out.withColumn("turns", F.transform(pieces, turn))
    return read.withColumn("loss_texts", F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def op5(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text")))
    out = parsed(formatted(table_turns(rows)))
    said, loss = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), F.array_join("loss_texts", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(url_encode(role)) + length(replace(replace(text, '\', '\\'), '<', '\<')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
