"""Chat formatting: records of any known layout become turns, and turns one string with a loss mask.

A record is JSON. Its fingerprint is a hash of the sorted paths of its fields (list positions left out, fields
that no layout knows left out); a table from fingerprints to declarative mappings picks how to read it. A layout
with optional fields has a fingerprint for each choice of them.

Template: ``<s>`` once, then for each turn ``[INST]text[/INST]`` (user), ``text</s>`` (assistant),
``[SYS]text[/SYS]`` (system) or ``[ROLE]role[/ROLE]text[/TURN]`` (any other role). Control strings inside texts and
roles get a backslash behind their first character (one more if there are some), which reading back takes
away; so no text can pass for a control string, and reading back gives exactly the turns. The loss mask is a
list of (start, length) in code points: the assistants' texts as they stand in the string.

Defined results: null texts and roles are empty; a record of an unknown layout, null or not JSON has no turns and a
null layout; a conversation without turns is ``<s>``; equal turn numbers are ordered by role, then text, null
first; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: Fixed: what marks turns.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]"]
_escape = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/TURN\])")
_escaped = re.compile(r"([<\[]\\*)\\(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/TURN\])")
_control = re.compile("|".join(map(re.escape, CONTROL)))
_closing = {"[INST]": ("user", "[/INST]"), "[SYS]": ("system", "[/SYS]")}


def escape(text: str) -> str:
    return _escape.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2", text)


@dataclass(frozen=True)
class Mapping:
    """A layout. ``turns``: (role, path) in order, for flat records; or ``items``: the list's field, the fields of
    role and text in it, and other names of roles."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        return {self.items[0], f"{self.items[0]}.{self.items[1]}", f"{self.items[0]}.{self.items[2]}"} | set(self.optional) if self.items else {p for _, p in self.turns}

    def read(self, record: dict) -> list[tuple[str, str]]:
        def text(x) -> str:
            return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)

        def at(path: str):
            x = record
            for part in path.split("."):
                x = x.get(part) if isinstance(x, dict) else None
            return x

        out = [(r, text(at(p))) for r, p in self.turns if at(p) is not None or p not in self.optional]
        if self.items:
            listed, role, said = self.items
            out += [(self.roles.get(text(x.get(role)), text(x.get(role))), text(x.get(said))) for x in at(listed) or [] if isinstance(x, dict)]
        return out


LAYOUTS = (
    Mapping("messages", items=("messages", "role", "content")),
    Mapping("conversations", items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("system_messages", turns=(("system", "system"),), items=("messages", "role", "content"), optional=("system",)),
    Mapping("prompt", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("question", turns=(("user", "question"), ("assistant", "answer"))),
    Mapping("nested_question", turns=(("user", "data.question"), ("assistant", "data.answer"))),
)


def field_paths(record, known: frozenset[str] | None = None) -> list[str]:
    """Sorted paths of a record's fields; those outside ``known`` are left out with all below them."""
    found, todo = set(), [("", record)]
    while todo:
        base, x = todo.pop()
        if isinstance(x, list):
            todo += [(base, y) for y in x]
        elif isinstance(x, dict):
            for k, v in x.items():
                path = f"{base}.{k}" if base else k
                if known is None or path in known:
                    found.add(path)
                    todo.append((path, v))
    return sorted(found)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(paths).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def fingerprints(layouts: tuple[Mapping, ...]) -> tuple[dict[str, Mapping], frozenset[str]]:
    """The table from fingerprints to layouts, the first of equals, and the fields that any layout knows."""
    table: dict[str, Mapping] = {}
    for m in layouts:
        needed = m.paths() - set(m.optional)
        for n in range(len(m.optional) + 1):
            for extra in itertools.combinations(m.optional, n):
                paths = needed | set(extra)
                paths |= {p[: k] for p in paths for k, c in enumerate(p) if c == "."}
                table.setdefault(fingerprint(sorted(paths)), m)
        if m.items:  # an empty list has no fields below it
            table.setdefault(fingerprint([m.items[0]]), m)
    known = {p for m in layouts for p in m.paths()}
    return table, frozenset(known | {p[:k] for p in known for k, c in enumerate(p) if c == "."})


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string of a conversation and its loss mask."""
    parts, mask, at = ["<s>"], [], 3
    for role, text in turns:
        text = escape(text)
        if role == "assistant":
            mask.append((at, len(text)))
            part = f"{text}</s>"
        elif role in ("user", "system"):
            tag = "INST" if role == "user" else "SYS"
            part = f"[{tag}]{text}[/{tag}]"
        else:
            part = f"[ROLE]{escape(role)}[/ROLE]{text}[/TURN]"
        parts.append(part)
        at += len(part)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted string holds."""
    marks = [(m.start(), m.end(), m.group()) for m in _control.finditer(formatted)][1:]
    turns, at, k = [], 3, 0
    while k < len(marks):
        start, end, mark = marks[k]
        if mark == "</s>":
            turns.append(("assistant", unescape(formatted[at:start])))
            at, k = end, k + 1
        elif mark in _closing:
            turns.append((_closing[mark][0], unescape(formatted[end : marks[k + 1][0]])))
            at, k = marks[k + 1][1], k + 2
        else:  # [ROLE] role [/ROLE] text [/TURN]
            turns.append((unescape(formatted[end : marks[k + 1][0]]), unescape(formatted[marks[k + 1][1] : marks[k + 2][0]])))
            at, k = marks[k + 2][1], k + 3
    return turns


def format_records(records: DataFrame, record: str = "record", layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """``records`` with layout, formatted and mask of the JSON column ``record``."""
    kind = "layout string, formatted string, mask array<struct<start:bigint,length:bigint>>"

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.DataFrame:
        table, known = fingerprints(layouts)
        out = []
        for raw in column:
            try:
                value = json.loads(raw) if raw is not None else None
            except ValueError:
                value = None
            layout = table.get(fingerprint(field_paths(value, known))) if isinstance(value, dict) else None
            text, mask = render(layout.read(value) if layout else [])
            out.append((layout.name if layout else None, text, [{"start": a, "length": n} for a, n in mask]))
        return pd.DataFrame(out, columns=["layout", "formatted", "mask"])

    return records.withColumn("_f", run(F.col(record))).withColumns({c: F.col(f"_f.{c}") for c in ("layout", "formatted", "mask")}).drop("_f")


def digest(formatted: DataFrame) -> DataFrame:
    """``formatted`` with what is read back from formatted and mask: n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars."""
    kind = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    @F.pandas_udf(kind)
    def run(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        def sha(x: str) -> str:
            return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

        out = []
        for text, mask in zip(texts, masks):
            turns = parse(text)
            loss = "".join(unescape(text[m["start"] : m["start"] + m["length"]]) for m in mask)
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.withColumn("_d", run("formatted", "mask")).withColumns({c: F.col(f"_d.{c}") for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}).drop("_d")


def records_of(turns: DataFrame) -> DataFrame:
    """(conv_id, record): conversations (conv_id, turn, role, text) as JSON, in the layout that fits each: prompt and
    response, instruction and output with a system text, or a list of messages."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.transform("t", lambda t: t["role"])

    def said(k: int):
        return F.get("t", k)["text"]

    return by.select("conv_id", F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response"))))
                     .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(said(0).alias("system"), said(1).alias("instruction"), said(2).alias("output"))))
                     .otherwise(F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))).alias("record"))


#: A conversation whose texts look like control strings, beside those of the table.
HARD = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def query(spark, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(HARD))
    return digest(format_records(records_of(turns))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g')) AS n,
             length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 11 ELSE 20 + r END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
