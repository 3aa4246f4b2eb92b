"""Chat formatting: layouts are told apart by a fingerprint of their field paths and mapped to canonical turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


# --- fingerprints and mappings ---------------------------------------------------------------------------------------


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, sorted; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower()))
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(field_paths: list[str]) -> str:
    """Hash of sorted field paths: equal for all records of one layout, whatever the order of their fields."""
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


def _one(role: str, path: str) -> dict:
    return {"role": role, "path": path}


def _list(path: str, role: str, text: str) -> dict:
    return {"list": path, "role": role, "text": text}


#: Layouts by their field paths: what to read for each turn, in order. ``join`` paths make one text, parted by a blank line; empty ones fall away.
LAYOUTS: dict[str, tuple[list[str], list[dict]]] = {
    "prompt-completion": (["prompt", "completion"], [_one("user", "prompt"), _one("assistant", "completion")]),
    "prompt-response": (["prompt", "response"], [_one("user", "prompt"), _one("assistant", "response")]),
    "question-answer": (["question", "answer"], [_one("user", "question"), _one("assistant", "answer")]),
    "instruction-output": (["instruction", "output"], [_one("user", "instruction"), _one("assistant", "output")]),
    "instruction-input-output": (
        ["instruction", "input", "output"],
        [{"role": "user", "join": ["instruction", "input"]}, _one("assistant", "output")],
    ),
    "system-instruction-output": (["system", "instruction", "output"], [_one("system", "system"), _one("user", "instruction"), _one("assistant", "output")]),
    "messages": (["messages[].role", "messages[].content"], [_list("messages", "role", "content")]),
    "from-value": (["conversations[].from", "conversations[].value"], [_list("conversations", "from", "value") | {"rename": True}]),
    "role-text": (["turns[].role", "turns[].text"], [_list("turns", "role", "text")]),
}
#: fingerprint -> (layout, its declarative mapping)
MAPPINGS = {fingerprint(p): (name, mapping) for name, (p, mapping) in LAYOUTS.items()}
#: paths that bear a conversation; a record's other paths do not count for its layout
BEARING = {p for field_paths, _ in LAYOUTS.values() for p in field_paths}
#: other names of the canonical roles, for mappings that rename (fixed values)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def _role(c: Column) -> Column:
    named = F.coalesce(c.cast("string"), F.lit(""))
    out = named
    for other, canonical in ROLES.items():
        out = F.when(F.lower(named) == other, F.lit(canonical)).otherwise(out)
    return out


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def mapped(mapping: list[dict], field: Callable[[str], Column]) -> Column:
    """The canonical turns that a declarative mapping reads; ``field``: the column at a path."""
    parts = []
    for rule in mapping:
        if "list" in rule:
            parts.append(F.coalesce(_each(field(rule["list"]), rule), F.array().cast(TURNS)))
        elif "join" in rule:
            texts = F.filter(F.array(*(_text(field(p)) for p in rule["join"])), lambda t: t != "")
            parts.append(F.array(_turn(F.lit(rule["role"]), F.array_join(texts, "\n\n"))))
        else:
            parts.append(F.array(_turn(F.lit(rule["role"]), _text(field(rule["path"])))))
    return F.concat(*parts)


def _each(array: Column, rule: dict) -> Column:
    role = _role if rule.get("rename") else _text
    return F.transform(array, lambda m: _turn(role(m[rule["role"]]), _text(m[rule["text"]])))


def canonical_turns(df: DataFrame, record_col: str = "record") -> DataFrame:
    """``df`` with ``_layout`` and ``_turns`` for its records: a struct, or a string of JSON.

    A struct column has one layout, whose fingerprint is taken from its type. Records in JSON may each have their own: their
    paths come from each record's own schema, and the fingerprint picks the mapping row by row. Records of no known
    layout, nulls and malformed JSON have a null ``_layout`` and null ``_turns``. Fields that no layout reads (an id, a source) do not
    matter; one that another layout reads does, so that no turn of a mixed record is lost unsaid.
    """
    kind = df.schema[record_col].dataType
    if isinstance(kind, T.StructType):
        name, mapping = MAPPINGS.get(fingerprint([p for p in paths(kind) if p in BEARING]), (None, None))
        if mapping is None:
            return df.withColumn("_layout", F.lit(None).cast("string")).withColumn("_turns", F.lit(None).cast(TURNS))
        there = F.col(record_col).isNotNull()
        return df.withColumn("_layout", F.when(there, F.lit(name))).withColumn("_turns", F.when(there, mapped(mapping, lambda p: F.col(record_col)[p])))
    schema = F.schema_of_variant(F.try_parse_json(record_col))
    prints = F.udf(_print_of_ddl, T.StringType(), useArrow=True)(schema)
    out = df.withColumn("_print", prints)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for code, (name, mapping) in MAPPINGS.items():
        parsed = F.from_json(record_col, _json_type(mapping))
        layout = F.when(F.col("_print") == code, F.lit(name)).otherwise(layout)
        turns = F.when(F.col("_print") == code, mapped(mapping, lambda p, r=parsed: r[p])).otherwise(turns)
    return out.withColumn("_layout", layout).withColumn("_turns", turns).drop("_print")


def _json_type(mapping: list[dict]) -> T.StructType:
    fields = {}
    for rule in mapping:
        if "list" in rule:
            fields[rule["list"]] = T.ArrayType(T.StructType([T.StructField(rule["role"], T.StringType()), T.StructField(rule["text"], T.StringType())]))
        else:
            for p in rule.get("join", [rule.get("path")]):
                fields[p] = T.StringType()
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


def _print_of_ddl(ddl: str | None) -> str | None:
    """Fingerprint of the conversation-bearing paths of a variant's schema as text: OBJECT<name: TYPE, ...>, ARRAY<TYPE> or a plain type."""
    if ddl is None:
        return None
    found: list[str] = []

    def walk(at: int, path: str) -> int:
        if ddl.startswith("OBJECT<", at):
            at += 7
            while ddl[at] != ">":
                if ddl[at] == "`":
                    end = at + 1
                    while ddl[end] != "`" or ddl[end + 1 : end + 2] == "`":
                        end += 2 if ddl[end] == "`" else 1
                    name, at = ddl[at + 1 : end].replace("``", "`"), end + 1
                else:
                    end = ddl.index(":", at)
                    name, at = ddl[at:end], end
                at = walk(at + 2, f"{path}.{name.lower()}" if path else name.lower())
                at += 2 if ddl.startswith(", ", at) else 0
            return at + 1
        if ddl.startswith("ARRAY<", at):
            return walk(at + 6, f"{path}[]") + 1
        found.append(path)
        depth = 0
        while at < len(ddl) and (depth or ddl[at] not in ",>"):
            depth += (ddl[at] == "(") - (ddl[at] == ")")
            at += 1
        return at

    walk(0, "")
    return fingerprint([p for p in found if p in BEARING])


# --- template --------------------------------------------------------------------------------------------------------

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: strings that this or other chat templates give a meaning (fixed values); escaped wherever a role or text holds one
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>")
def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


@dataclass(frozen=True)
class Formatted:
    text: str
    #: (start, end) in the formatted text, code points: what counts for the loss
    loss: list[tuple[int, int]]


def escape(text: str) -> str:
    """Backslashes doubled, and a backslash inside each control string, after its first character: none is left whole."""
    if "\\" not in text and not any(c in text for c in CONTROLS):
        return text
    return re.sub("|".join(map(re.escape, CONTROLS)), lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def render(turns: list[tuple[str, str]]) -> Formatted:
    """Turns in the template: start mark, role, line end, text, end mark. The loss covers each assistant's text.

    Roles lose nothing: their line ends are escaped as well.
    """
    out, loss, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\n", "\\\n") + MIDDLE
        body = escape(text)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return Formatted("".join(out), loss)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        at = begin = at + len(START)
        while formatted[at] != "\n":
            at += 2 if formatted[at] == "\\" else 1
        role, begin = unescape(formatted[begin:at]), at + 1
        end = formatted.index(END, begin)
        turns.append((role, unescape(formatted[begin:end])))
        at = end + len(END)
    return turns


def format_turns(df: DataFrame, turns_col: str = "_turns") -> DataFrame:
    """``df`` with ``_formatted`` and ``_loss`` (spans in code points, end exclusive) for its canonical turns; null turns give nulls."""
    made = T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.ArrayType(T.ArrayType(T.LongType())))])

    @F.udf(made, useArrow=True)
    def run(turns):
        if turns is None:
            return None
        f = render([(t["role"] or "", t["text"] or "") for t in turns])
        return f.text, [list(x) for x in f.loss]

    return df.withColumn("_made", run(turns_col)).withColumn("_formatted", F.col("_made.text")).withColumn("_loss", F.col("_made.loss")).drop("_made")


def conversations_to_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record in the layout ``messages`` per conversation: its rows by turn (nulls first; ties by role and text).

    A conversation becomes one formatted text, so its rows meet in one task, where it must fit in memory anyway.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(turn)).alias("m"))
    return grouped.select("_id", F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")).alias("record"))


def digests(df: DataFrame) -> DataFrame:
    """What can be read back from ``_formatted`` and ``_loss``, by ``_id``."""
    schema = T.StructType(
        [df.schema["_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    )
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                learnt = "".join(unescape(text[a:b]) for a, b in loss)
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return df.select("_id", "_formatted", "_loss").mapInArrow(run, schema)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations")
    shared = canonical_turns(conversations_to_records(table)).select("_id", "_turns")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast(table.schema["conv_id"].dataType).alias("_id"), F.struct(F.lit(control).alias("prompt"), F.lit(control).alias("completion")).alias("record")
    )
    both = shared.unionByName(canonical_turns(extra).select("_id", "_turns"))
    return digests(format_turns(both)).withColumnRenamed("_id", "conv_id")


def _escaped_chars(text: str) -> str:
    """SQL: how long a text is once it is escaped."""
    more = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS)]
    return f"(length({text}) + {' + '.join(more)})"


OP4_SQL = f"""
WITH turns AS (
    SELECT false AS added, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT true, -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT true, -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, {len(START) + len(MIDDLE) + len(END)} + {_escaped_chars("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped_chars("text")} AS chars FROM turns
), whole AS (
    SELECT added, conv_id, count(*) AS n_turns, sum(chars) AS chars,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
           coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learnt
    FROM sized GROUP BY added, conv_id
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM whole
"""
