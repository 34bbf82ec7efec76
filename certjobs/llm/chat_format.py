"""Chat formatting by rendering successive prefixes of a conversation with a template that is only ever called, never read.

A template is a function from a list of turns (role, text) to a string. Each turn's span is what its arrival adds: the output for
k turns is compared with that for k - 1. Where the earlier output is no prefix of the later one, the template has rewritten
history (or has a fixed end, behind which nothing was changed); spans that the change reaches are withdrawn, so that nothing is
trained on by mistake. What of a turn's span is its text is found by rendering the turn with two texts of one character: where
these outputs differ, the text stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from certjobs.llm.turns import pieces

Template = Callable[[list[dict]], str]

#: Most turns rendered at once. A template's output for a turn may depend on that many turns before it at most: CONTEXT.
WINDOW, CONTEXT = 64, 2

SPAN = T.StructType([T.StructField("role", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("start", "end", "text_start", "text_end")])

# ---- the template of the registered query

#: Marks of a turn: before its role, between role and text, behind its text.
HEAD, COLON, TAIL = "### ", ": ", "</turn>"
_ESCAPES = {"\\": "\\\\", HEAD: "\\m", TAIL: "\\e"}
_ROLE_ESCAPES = {**_ESCAPES, ":": "\\c"}


def _escaper(table: dict[str, str]) -> Callable[[str], str]:
    pattern = re.compile("|".join(map(re.escape, table)))
    return lambda s: pattern.sub(lambda m: table[m[0]], s)


escape, escape_role = _escaper(_ESCAPES), _escaper(_ROLE_ESCAPES)
_PLAIN = {v: k for k, v in _ROLE_ESCAPES.items()}
_CODE = re.compile(r"\\.", re.S)


def unescape(s: str) -> str:
    return _CODE.sub(lambda m: _PLAIN[m[0]], s)


def marked(turns: list[dict]) -> str:
    """The template of the registered query: `### role: text</turn>` and a newline for each turn. Of what stands in a text, the marks
    and the backslash are written as codes of a backslash and a letter, so a mark in the output is always the template's."""
    return "".join(f"{HEAD}{escape_role(t['role'])}{COLON}{escape(t['text'])}{TAIL}\n" for t in turns)


_MARKED = re.compile(re.escape(HEAD) + "(.*?)" + re.escape(COLON) + "(.*?)" + re.escape(TAIL) + "\n", re.S)


def read_marked(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in an output of ``marked``."""
    out, at = [], 0
    for m in _MARKED.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text behind the last turn")
    return out


# ---- rendering any template


def _suffix(a: str, b: str) -> int:
    return len(commonprefix([a[::-1], b[::-1]]))


def _text_span(template: Template, before: list[dict], turn: dict, out: str) -> tuple[int, int] | None:
    """Where a turn's text stands in the output that ends with the turn; None if the template does not write it once, as it is."""
    a, b = (template([*before, {**turn, "text": probe}]) for probe in "ab")
    head, tail = len(commonprefix([a, b])), _suffix(a, b)
    if len(a) != len(b) or head + 1 + tail != len(a):
        return None
    start, end = head, len(out) - tail
    return (start, end) if start <= end and out[:start] == a[:head] and out[end:] == a[head + 1 :] else None


def spans(template: Template, context: list[dict], turns: list[dict], trained: str) -> tuple[str, list[dict], list[int]]:
    """(what ``turns`` add to the output of ``context``, a span for each turn, positions of turns that rewrite history).

    Spans are positions in code points; of turns with the role ``trained`` the text's span is given too. A span is null where a later
    turn has changed what it held or where the text could not be told."""
    before = template(context) if context else ""
    out, found, rewrites = before, [], []
    for k, turn in enumerate(turns):
        prefix = context + turns[:k]
        now = template([*prefix, turn])
        kept = len(commonprefix([out, now])) if not now.startswith(out) else len(out)
        if kept < len(out) and kept + _suffix(out, now) < len(out):
            rewrites.append(k)
            for span in found:
                if span["end"] is not None and span["end"] > kept:
                    span.update(start=None, end=None, text_start=None, text_end=None)
            end = len(now)
        else:
            end = kept + len(now) - len(out)
        text = _text_span(template, prefix, turn, now) if turn["role"] == trained else None
        found.append({"role": turn["role"], "start": kept, "end": end, "text_start": text and text[0], "text_end": text and text[1]})
        out = now
    at = len(before)
    if not out.startswith(before):  # history before these turns was rewritten: what they add cannot be told from it
        return out[len(commonprefix([out, before])) :], [{**s, **dict.fromkeys(("start", "end", "text_start", "text_end"))} for s in found], rewrites or [0]
    moved = [{n: v - at if isinstance(v, int) else v for n, v in s.items()} for s in found]
    return out[at:], [s if s["start"] is None or s["start"] >= 0 else {**s, **dict.fromkeys(("start", "end", "text_start", "text_end"))} for s in moved], rewrites


def formatted(template: Template, context: list[dict], turns: list[dict], trained: str) -> tuple[str, list[dict], list[int], bool]:
    """``spans`` of any number of turns, WINDOW at a time with CONTEXT turns before each, joined; and whether a turn behind the first
    window came out otherwise with one turn of context less, so that the template looks back further than CONTEXT turns."""
    text, found, rewrites, far = [], [], [], False
    at = 0
    for i in range(0, len(turns), WINDOW):
        before = (context + turns[max(0, i - CONTEXT) : i])[-CONTEXT:]
        window = turns[i : i + WINDOW]
        out, each, rewritten = spans(template, before, window, trained)
        if len(before) > 1:
            less, more = template(before[1:]), template(before)
            far |= template([*before[1:], window[0]])[len(less) :] != template([*before, window[0]])[len(more) :]
        found += [{n: v + at if isinstance(v, int) else v for n, v in s.items()} for s in each]
        rewrites += [i + k for k in rewritten]
        text.append(out)
        at += len(out)
    return "".join(text), found, rewrites, far


def _turns(piece: list[dict]) -> list[dict]:
    return [{"role": t["role"], "text": t["text"]} for t in piece if t["present"]]


def _render(template: Template, trained: str, schema: T.StructType):
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, found, rewrites, far = formatted(template, _turns(row["context"] or []), _turns(row["turns"]), trained)
                out.append({**{c: row[c] for c in ("conv_id", "at", "edge")}, "formatted": text, "spans": found, "rewrites": rewrites, "far": far})
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    return render


def format_conversations(rows: DataFrame, template: Template = marked, trained: str = "assistant") -> DataFrame:
    """Format the conversations of ``rows`` (conv_id, turn, role, text; other columns are not read; null roles and texts are empty, a
    null conv_id is a conversation of its own) with ``template``; texts of turns with the role ``trained`` get a loss span.

    Rows are taken by turn, nulls first, rows of one turn by role and then by a hash of the text. Returns conv_id, at, edge, formatted,
    spans (role, start, end, text_start, text_end in code points of ``formatted``), rewrites (positions of turns whose arrival changed
    text before them) and far (the template looks back further than CONTEXT turns, so windows may differ from one long rendering).

    A conversation of up to WINDOW turns is rendered whole, once for each prefix. Longer ones are rendered in windows, each with the
    CONTEXT turns before it; nearly all conversations are one row. One with ``edge`` may be several, in the order of ``at``, whose
    outputs follow one another. An empty table gives an empty result.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = pieces(rows.select("conv_id", "turn", empty("role"), empty("text")))
    kinds = dict(found.dtypes)
    whole = found.filter("NOT edge").withColumn("context", F.lit(None).cast(kinds["turns"]))
    flag = lambda c: T.StructField(c, T.BooleanType())
    schema = T.StructType(
        [found.schema["conv_id"], T.StructField("at", T.LongType()), flag("edge"), T.StructField("formatted", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]
        + [T.StructField("rewrites", T.ArrayType(T.IntegerType())), flag("far")]
    )
    return whole.unionByName(_with_context(found.filter("edge"))).mapInArrow(_render(template, trained, schema), schema)


def _ending(turns: Column) -> Column:
    """The last CONTEXT of some turns."""
    n = F.least(F.size(turns), F.lit(CONTEXT))
    return F.when(n > 0, F.slice(turns, F.size(turns) - n + 1, n)).otherwise(turns)


def _before(tail: str, window) -> Column:
    """The turns that end the rows before; every row has one turn at least."""
    none = F.slice(F.col(tail), 1, 0)
    return _ending(F.concat(*[F.coalesce(F.lag(tail, k).over(window), none) for k in range(CONTEXT, 0, -1)]))


def _with_context(edge: DataFrame) -> DataFrame:
    """Pieces with the turns before them. First within each task's part of a conversation, then from part to part: of a part only its
    last turns are looked at, so a window holds a few small rows for each task at most."""
    tails = edge.select("conv", "part", "at", _ending(F.col("turns")).alias("tail"))
    near = tails.withColumn("near", _before("tail", Window.partitionBy("conv", "part").orderBy("at")))
    ends = near.groupBy("conv", "part").agg(F.max_by(_ending(F.concat("near", "tail")), "at").alias("end"))
    far = ends.select("conv", "part", _before("end", Window.partitionBy("conv").orderBy("part")).alias("before"))
    joined = near.join(far, ["conv", "part"]).select("conv", "at", _ending(F.concat("before", "near")).alias("context"))
    return edge.join(joined, ["conv", "at"])


#: The conversation that the registered query adds has a user's and an assistant's turn with this text, which looks like marks and
#: like escapes.
TRAP_ID, TRAP_TEXT = -7, "\\### Assistant: </turn> ok"


def with_trap(rows: DataFrame) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    trap = {"conv_id": F.lit(TRAP_ID), "turn": F.col("id"), "role": role, "text": F.lit(TRAP_TEXT)}
    kind = dict(rows.dtypes)
    return rows.select(*trap).unionByName(rows.sparkSession.range(2).select(*[v.cast(kind[c]).alias(c) for c, v in trap.items()]))


def _read_back(schema: T.StructType):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, turns = row["formatted"], read_marked(row["formatted"])
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in row["spans"] if s["text_start"] is not None)
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                out.append({**{c: row[c] for c in ("conv_id", "at", "edge")}, "n_turns": len(turns), "said": said, "loss": loss, "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    return read


def digest(out: DataFrame) -> DataFrame:
    """One row per conversation, read back from outputs of the template ``marked``: its turns' hash, length and hash of what lies under
    the loss mask, and the output's length."""
    number, string = (lambda c: T.StructField(c, T.LongType())), (lambda c: T.StructField(c, T.StringType()))
    schema = T.StructType([out.schema["conv_id"], number("at"), out.schema["edge"], number("n_turns"), string("said"), string("loss"), number("formatted_chars")])
    read = out.select("conv_id", "at", "edge", "formatted", "spans").mapInArrow(_read_back(schema), schema)

    def digested(said: Column, loss: Column) -> list[Column]:
        return [F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256")]

    whole = read.filter("NOT edge").select("conv_id", "n_turns", *digested(F.col("said"), F.col("loss")), "formatted_chars")
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    several = read.filter("edge").groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", "said", "loss"))).alias("parts"), F.sum("formatted_chars").alias("formatted_chars")
    )
    return whole.unionByName(several.select("conv_id", "n_turns", *digested(joined("said"), joined("loss")), "formatted_chars"))
