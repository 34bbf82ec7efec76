"""Repair of damaged conversations at the least cost: layers of reachable grammar states, one for each cost, and a trace through them.

Roles have to be an optional system turn and then pairs of user and assistant, or nothing at all. Each row is kept (0), given the
role user or assistant (1) or deleted (2); empty user or assistant turns may be inserted anywhere (5); a truncated row that stays
adds 5; blank and repeated rows have to go. Four states are enough: nothing yet, after system, after user, after assistant; a set of
them is four bits. For each cost, from 0 up, there is one such set per row: the states from which the rest can be repaired at that
cost and no less. The first layer with the start state gives the cost; the trace takes at every row the first edit by name that
leads into the layer of what is left. Rows go through in blocks of BLOCK, each with its own layers, so time and memory grow with the
rows and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from certjobs.llm.common import attach, written
from certjobs.llm.turns import pieces

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What an inserted or renamed turn leads to: an assistant's after a user's, a user's after anything else.
NEXT = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Cost of the end from each state.
FINAL = [0, 2 * INSERT, INSERT, 0]
BLOCK = 32
NEVER = 1 << 40

_BEFORE = {i: [sum(1 << q for q, to in step.items() if bits >> to & 1) for bits in range(16)] for i, step in STEP.items()}
_ANY = [_BEFORE["u"][bits] | _BEFORE["a"][bits] for bits in range(16)]
_NONE = [0] * 16

Row = tuple[str, bool]  # initial of the role, truncated


def layers(block: list[Row], ends: list[int]) -> tuple[int, list[list[int]]]:
    """(lowest cost, sets by cost above it and row): bit q of ``sets[c][i]`` says that from state q before row i the cheapest
    way to the block's end and on, at ``ends`` by state, costs c more than the lowest."""
    n, low = len(block), min(ends)
    most = max(e for e in ends if e < NEVER) - low + DELETE * n + 3 * INSERT
    seen, sets = [0] * (n + 1), []
    none = [0] * (n + 1)
    before = lambda c: sets[c] if c >= 0 else none
    for c in range(most + 1):
        here = [0] * (n + 1)
        inserted, deleted = before(c - INSERT), before(c - DELETE)
        by_cut = ((here, before(c - REROLE)), (before(c - CUT), before(c - CUT - REROLE)))
        here[n] = (sum(1 << q for q in range(4) if ends[q] - low == c) | _ANY[inserted[n]]) & ~seen[n]
        seen[n] |= here[n]
        for i in range(n - 1, -1, -1):
            initial, cut = block[i]
            kept, renamed = by_cut[cut]
            here[i] = (deleted[i + 1] | _BEFORE.get(initial, _NONE)[kept[i + 1]] | _ANY[renamed[i + 1]] | _ANY[inserted[i]]) & ~seen[i]
            seen[i] |= here[i]
        sets.append(here)
        if seen[0] == 15:
            break
    return low, sets


def _costs(low: int, sets: list[list[int]]) -> list[int]:
    return [next((low + c for c, here in enumerate(sets) if here[0] >> q & 1), NEVER) for q in range(4)]


def costs_to_go(rows: list[Row], ends: list[int]) -> list[list[int]]:
    """Costs by state before each block, and at the end."""
    out = [ends]
    for at in range((len(rows) - 1) // BLOCK * BLOCK, -1, -BLOCK) if rows else ():
        out.append(_costs(*layers(rows[at : at + BLOCK], out[-1])))
    return out[::-1]


def _trace(block: list[Row], low: int, sets: list[list[int]], q: int) -> tuple[list[str], int]:
    """The edits of a block from state q, inserts before the row that they precede, and the state they lead to."""
    c, out, i, said = _costs(low, sets)[q] - low, [], 0, ""
    has = lambda c, i, q: c >= 0 and sets[c][i] >> q & 1
    while i < len(block):
        initial, cut = block[i]
        extra = CUT if cut else 0
        to = STEP.get(initial, {}).get(q)
        if has(c - DELETE, i + 1, q):
            c, said = c - DELETE, said + "D"
        elif has(c - INSERT, i, NEXT[q]):
            c, q, said = c - INSERT, NEXT[q], said + "I"
            continue
        elif to is not None and has(c - extra, i + 1, to):
            c, q, said = c - extra, to, said + "K"
        else:
            c, q, said = c - REROLE - extra, NEXT[q], said + "R"
        out.append(said)
        said, i = "", i + 1
    return out, q


def edits(rows: list[Row | None], ends: list[int], q: int) -> tuple[str, int]:
    """The least of the cheapest edits of rows (None: has to go) from state q, and the state after them."""
    free = [r for r in rows if r is not None]
    bounds, said = costs_to_go(free, ends), []
    for k, at in enumerate(range(0, len(free), BLOCK)):
        block = free[at : at + BLOCK]
        found, q = _trace(block, *layers(block, bounds[k + 1]), q)
        said += found
    each = iter(said)
    return "".join("D" if r is None else next(each) for r in rows), q


def closing(q: int) -> str:
    """What has to be inserted at the end."""
    return "I" * (FINAL[q] // INSERT)


def applied(turns: list[dict], audit: str, q: int = START) -> list[dict]:
    """The repaired turns (role, text)."""
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            q = NEXT[q]
            out.append({"role": NAMES[q], "text": ""})
            continue
        turn, i = turns[i], i + 1
        if letter == "K":
            q = STEP[turn["role"][:1]][q]
            out.append({"role": turn["role"], "text": turn["text"]})
        elif letter == "R":
            q = NEXT[q]
            out.append({"role": NAMES[q], "text": turn["text"]})
    return out


def _last(text: str) -> str:
    """The last character that is not white space; empty if there is none."""
    return text.rstrip(" \t\n\v\f\r")[-1:]


def judged(turns: list[dict], repeated: Iterable[int] | None = None) -> list[str]:
    """The first fault of each turn: blank, duplicate, truncated or none (empty). ``repeated`` has the positions of turns whose role
    and text came earlier; without it they are looked up among ``turns``."""
    if repeated is None:
        seen: set[tuple[str, str]] = set()
        repeated = {i for i, t in enumerate(turns) if (t["role"], t["text"]) in seen or seen.add((t["role"], t["text"]))}
    again = set(repeated)
    ends = [_last(t["text"]) for t in turns]
    return ["blank" if not e else "duplicate" if i in again else "" if e in ".!?" else "truncated" for i, e in enumerate(ends)]


def _rows(turns: list[dict], faults: list[str]) -> list[Row | None]:
    return [None if f in ("blank", "duplicate") else (t["role"][:1], f == "truncated") for t, f in zip(turns, faults, strict=True)]


LEGAL = {"su", "ua", "au"}


def _counts(turns: list[dict], faults: list[str]) -> dict:
    """What adds up over the runs of a conversation, and what its ends are."""
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    initials = [t["role"][:1] for t in turns]
    return {
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "distinct": len(set(numbers)),
        "low": min(numbers, default=None), "high": max(numbers, default=None), "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
    }


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _present(row_turns: list[dict]) -> list[dict]:
    return [t for t in row_turns if t["present"]]


def _whole(schema: T.StructType):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = _present(row["turns"])
                faults = judged(turns)
                rows = _rows(turns, faults)
                audit, q = edits(rows, FINAL, START)
                audit += closing(q)
                c = _counts(turns, faults)
                gaps = c["high"] - c["low"] + 1 - c["distinct"] if c["distinct"] else 0
                cost = sum({"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[x] for x in audit) + CUT * _kept_cut(rows, audit)
                out.append({"conv_id": row["conv_id"], "gaps": gaps, **{k: c[k] for k in COUNTS[1:-1]}, "cost": cost, "audit": audit, "at": row["at"], "edge": False, "turns": applied(turns, audit)})
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    return repair


def _kept_cut(rows: list[Row | None], audit: str) -> int:
    """Truncated rows that are not deleted."""
    return sum(r is not None and r[1] and letter != "D" for r, letter in zip(rows, (x for x in audit if x != "I")))


def _grouped(rows: GroupedData, make: Callable[[list[dict]], list[dict]], order: str, schema: str) -> DataFrame:
    """``make`` for each group's rows, sorted by ``order``."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def each(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(make(sorted(table.to_pylist(), key=lambda r: r[order])), arrow)

    return rows.applyInArrow(each, schema)


def _run(run: list[dict]) -> tuple[list[dict], list[str]]:
    """Turns and faults of a run: the pieces of one conversation in one part."""
    turns, again = [], []
    for piece in run:
        gone = set(piece["repeated"] or ())
        for i, t in enumerate(piece["turns"]):
            if t["present"]:
                if i in gone:
                    again.append(len(turns))
                turns.append(t)
    return turns, judged(turns, again)


def _key(run: list[dict]) -> dict:
    return {c: run[0][c] for c in ("conv", "part")}


_UNIT = [[0 if q == j else NEVER for q in range(4)] for j in range(4)]


def _measured(run: list[dict]) -> list[dict]:
    """A run's counts, and its cost from each state before it to each state after it (``ways``)."""
    turns, faults = _run(run)
    free = [r for r in _rows(turns, faults) if r is not None]
    columns = [costs_to_go(free, unit)[0] for unit in _UNIT]
    ways = [columns[j][q] for q in range(4) for j in range(4)]
    return [{**_key(run), **_counts(turns, faults), "forced": DELETE * (len(turns) - len(free)), "ways": ways}]


def _joined(runs: list[dict]) -> list[dict]:
    """The cost behind each run by state, from the last run back; counts of the conversation beside the first run."""
    ends, behind = FINAL, []
    for run in reversed(runs):
        behind.append(ends)
        ends = [min(run["ways"][4 * q + j] + ends[j] for j in range(4)) for q in range(4)]
    total = {k: sum(r[k] for r in runs) for k in COUNTS[1:-1]}
    said = [r for r in runs if r["head"] is not None]
    total["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(said, said[1:]))
    known = [r for r in runs if r["low"] is not None]
    shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))  # a turn's rows that two runs share
    gaps = max(r["high"] for r in known) - min(r["low"] for r in known) + 1 - sum(r["distinct"] for r in known) + shared if known else 0
    out = [{**_key([r]), "ends": e} for r, e in zip(runs, reversed(behind), strict=True)]
    out[0] |= {"gaps": gaps, **total, "cost": ends[START] + sum(r["forced"] for r in runs)}
    return out


def _traced(run: list[dict]) -> list[dict]:
    """A run's edits from each state."""
    rows = _rows(*_run(run))
    found = [edits(rows, run[0]["ends"], q) for q in range(4)]
    return [{**_key(run), "audits": [a for a, _ in found], "exits": [q for _, q in found]}]


def _chosen(runs: list[dict]) -> list[dict]:
    """Each run's edits from the state that the runs before it lead to."""
    q, out = START, []
    for run in runs:
        out.append({**_key([run]), "state": q, "audit": run["audits"][q]})
        q = run["exits"][q]
    out[-1]["audit"] += closing(q)
    return out


def _repaired(run: list[dict]) -> list[dict]:
    return [{"conv": run[0]["conv"], "at": run[0]["at"], "turns": applied(_run(run)[0], run[0]["audit"], run[0]["state"])}]


def _long(edge: DataFrame, schema: T.StructType) -> DataFrame:
    """Conversations that several pieces may share: first what each run costs between any two states, then what lies behind each
    run, then its edits from every state, then those that the runs before it lead to. A group is one task's part of a
    conversation, or one small row for each such part."""
    each = edge.select("conv", "at", F.posexplode("turns").alias("pos", "t")).filter("t.present")
    marked = each.select("conv", "at", "pos", F.col("t.role").alias("role"), F.sha2("t.text", 256).alias("mark"))
    place = F.struct("at", "pos")
    first = marked.groupBy("conv", "role", "mark").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = attach(marked, first, ["conv", "role", "mark"], "n").filter(F.col("first").isNotNull() & (place > F.col("first")))
    positions = again.groupBy("conv", "at").agg(F.collect_list("pos").alias("repeated"))
    known = written(edge.join(positions, ["conv", "at"], "left"), "known")
    numbers = ", ".join(f"{c} long" for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high"))
    measured = _grouped(known.groupBy("conv", "part"), _measured, "at", f"conv string, part long, {numbers}, head string, tail string, forced long, ways array<long>")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    behind = written(_grouped(measured.groupBy("conv"), _joined, "part", f"conv string, part long, ends array<long>, {counts}"), "behind")
    traced = _grouped(known.join(behind.select("conv", "part", "ends"), ["conv", "part"]).groupBy("conv", "part"), _traced, "at", "conv string, part long, audits array<string>, exits array<int>")
    chosen = written(_grouped(traced.groupBy("conv"), _chosen, "part", "conv string, part long, state int, audit string"), "chosen")
    audits = chosen.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    ids = known.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.min("at").alias("head_at"))
    totals = behind.filter("cost IS NOT NULL").drop("part", "ends").join(audits, "conv").join(ids, "conv")
    kinds = f"conv string, at long, turns {_TURNS.simpleString()}"
    turns = _grouped(known.join(chosen, ["conv", "part"]).groupBy("conv", "part"), _repaired, "at", kinds)
    # counts and audit stand beside a conversation's first run only
    head = F.col("at") == F.col("head_at")
    named = turns.join(ids, "conv").join(totals.drop("conv_id").withColumnRenamed("head_at", "at"), ["conv", "at"], "left")
    return named.select("conv_id", *COUNTS, F.when(head, F.col("audit")).alias("audit"), "at", F.lit(True).alias("edge"), "turns").to(schema)


def repair_conversations(rows: DataFrame, present=None) -> DataFrame:
    """Repair the conversations of ``rows`` (conv_id, turn, role, text; other columns are not read; nulls of role and text are one
    space, a null conv_id is a conversation of its own).

    Rows are taken by turn, nulls first, rows of one turn by role and then by a hash of the text, equal rows next to each other.
    ``present`` (a condition) marks the rows that are there; conversations of which none is there are returned with zeros.

    Returns conv_id, gaps (turn numbers missing between the lowest and the highest; nulls are left out), blank, duplicate, truncated
    (rows by their first fault), illegal (neighbours whose role initials may not follow each other), cost, audit (initials of the
    edits: delete, insert, keep, rerole), at, edge and turns (role, text of the repaired conversation). Nearly all conversations are
    one row. One with ``edge`` may be several, in the order of ``at``, the first with the counts and the whole audit, each with its
    own ``turns``; so no row holds more turns than one task has of a conversation. An empty table gives an empty result.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    there = F.lit(True) if present is None else present
    found = pieces(rows.select("conv_id", "turn", space("role"), space("text"), there.alias("present")), F.col("present"))
    number = lambda c: T.StructField(c, T.LongType())
    schema = T.StructType(
        [found.schema["conv_id"], *map(number, COUNTS), T.StructField("audit", T.StringType()), number("at"), T.StructField("edge", T.BooleanType()), T.StructField("turns", _TURNS)]
    )
    return found.filter("NOT edge").mapInArrow(_whole(schema), schema).unionByName(_long(found.filter("edge"), schema))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32(conv_id:turn) mod 20, nulls as one space: 0 takes the row out (``present`` is then
    false), 1 empties its text, 2 takes out full stops, exclamation and question marks, 3 repeats it, 4 gives it the role user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(kind == 4, "user").otherwise(word("role"))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return made.drop("copy")


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation, with the hash of its repaired turns (role:text, joined by newlines)."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    said = repaired.withColumn("said", joined).withColumn("any", F.size("turns") > 0)
    columns = ["conv_id", *COUNTS, "audit"]
    whole = said.filter("NOT edge").select(*columns, F.sha2("said", 256).alias("repaired_sha256"))
    parts = F.array_sort(F.collect_list(F.when(F.col("any"), F.struct("at", "said"))))
    several = said.filter("edge").groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns[1:]], F.sha2(F.array_join(F.transform(parts, lambda p: p["said"]), "\n"), 256).alias("repaired_sha256"))
    return whole.unionByName(several)
