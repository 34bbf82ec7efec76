"""Chat formatting and conversation repair against plain versions, with conversations that cross tasks, batches and pieces."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from certjobs.llm import chat_format as chat
from certjobs.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string, present int, at string, edge int, turns int, formatted long"
WHITE = " \t\n\v\f\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], ROWS)


def conversations(long=700):
    """Conversations of all lengths with nulls, ties, repeats, unknown roles and one of very many turns; in no order."""
    r = random.Random(11)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(r.choice([1, 1, 2, 3, 5, 8, 13])):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]) if r.random() < 0.3 else ["user", "assistant"][turn % 2]
            text = r.choice([None, "", " \t", "x" * 3000, "Again."]) if r.random() < 0.2 else f"say {r.randint(0, 5)}{r.choice('.!?,')}" + r.choice(["", " \n"])
            rows.append((conv, None if r.random() < 0.05 else turn + r.choice([0, 0, 0, 3]), role, text))
    for turn in range(long):
        rows.append((999, turn + turn // 50, r.choice(["user", "assistant", "system"]) if r.random() < 0.2 else ["user", "assistant"][turn % 2], f"long {turn if r.random() < 0.8 else 7}{r.choice('..,')}"))
    rows += [(70, 1, "user", "same.")] * 4
    r.shuffle(rows)
    return rows


def ordered(rows, empty, mark):
    """Rows of each conversation in the operators' order; ``mark`` has Spark's hash of a text."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, empty if role is None else role, empty if text is None else text))
    low = lambda x: (x is not None, x)
    return {c: sorted(v, key=lambda t: (low(t[0]), t[1], mark[t[2]])) for c, v in by.items()}


def marks(spark, rows, empty):
    texts = sorted({empty if t is None else t for *_, t in rows})
    return {r["t"]: r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("m")).collect()}


# ---- repair


def cheapest(rows):
    """(cost, audit) by a search over all edits in the order of cost and audit; rows: (initial, truncated, has to go)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    seen, heap = set(), [(0, "", 0, 0)]
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit
        other = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 5, audit + "I", i, other))
        if i < len(rows):
            initial, cut, forced = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if not forced:
                heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, other))
                if (q, initial) in step:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, step[q, initial]))


@pytest.mark.parametrize("seed", range(4))
def test_layers_find_the_least_of_the_cheapest_audits(seed):
    r = random.Random(seed)
    for _ in range(300):
        rows = [(r.choice("suuuaaatx"), r.random() < 0.3, r.random() < 0.2) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 31, 32, 33, 70]))]
        mine = [None if f else (i, c) for i, c, f in rows]
        audit, q = repair.edits(mine, repair.FINAL, repair.START)
        free = [x for x in mine if x]
        assert (repair.costs_to_go(free, repair.FINAL)[0][0] + 2 * (len(mine) - len(free)), audit + repair.closing(q)) == cheapest(rows)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(turns):
    """Counts, cost, audit and repaired turns of one conversation, plainly."""
    seen, rows, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in turns:
        last = text.rstrip(WHITE)[-1:]
        fault = "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (fault == "b"), duplicate + (fault == "d"), truncated + (fault == "t")
        rows.append((role[:1], fault == "t", fault in ("b", "d")))
    initials = [r[0] for r in rows]
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit = cheapest(rows)
    said, i, last = [], 0, ""
    for letter in audit:
        role, text = "assistant" if last == "u" else "user", ""
        if letter != "I":
            _, own, text = turns[i]
            i, role = i + 1, own if letter == "K" else role
        if letter != "D":
            said.append((role, text))
            last = role[:1]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, blank, duplicate, truncated, illegal, cost, audit), said


@pytest.mark.parametrize("batch", [7, 10000])
def test_repair_of_damaged_conversations(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = conversations()
        by = ordered(damage(rows), " ", marks(spark, [*rows, *damage(rows)], " "))
        got = repair.digest(repair.repair_conversations(repair.damaged(frame(spark, rows)), F.col("present"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(g["conv_id"]) for g in got) == sorted({str(c) for c, *_ in rows})
    for g in got:
        want, said = repaired(by.get(g["conv_id"], []))
        assert tuple(g)[1:8] == want, g["conv_id"]
        assert g["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def test_repair_gives_turns_and_takes_odd_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Ask?"), (1, 2, "assistant", "Tell."), (2, None, None, None), (3, 0, "system", "Be.")]
    got = {r["conv_id"]: r for r in repair.repair_conversations(frame(spark, rows)).groupBy("conv_id").agg(F.max("audit").alias("audit"), F.max("cost").alias("cost"), F.flatten(F.collect_list("turns")).alias("turns")).collect()}
    assert (got[1]["audit"], got[1]["cost"], [(t["role"], t["text"]) for t in got[1]["turns"]]) == ("DKK", 2, [("user", "Ask?"), ("assistant", "Tell.")])
    assert (got[2]["audit"], got[2]["turns"]) == ("D", []) and (got[3]["audit"], got[3]["turns"]) == ("D", [])
    assert repair.digest(repair.repair_conversations(frame(spark, []))).count() == 0
    gone = repair.digest(repair.repair_conversations(frame(spark, rows), F.lit(False))).collect()
    assert len(gone) == 3 and all(tuple(g)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for g in gone)


def test_repair_is_linear_in_a_conversation():
    import time

    took = []
    for n in (2000, 4000):
        rows = [(random.Random(i).choice("suuaa"), i % 3 == 0) for i in range(n)]
        began = time.time()
        repair.edits(rows, repair.FINAL, repair.START)
        took.append(time.time() - began)
    assert took[1] < 2.5 * took[0] + 0.2


# ---- formatting


def test_escapes_are_reversible():
    r = random.Random(3)
    parts = ["\\", "### ", "###", "#", "</turn>", "</turn", ">", "\\m", "\\e", "\\c", ":", ": ", "a", "\n", "é", "Assistant"]
    for _ in range(2000):
        text, role = ("".join(r.choice(parts) for _ in range(r.randint(0, 8))) for _ in range(2))
        assert chat.unescape(chat.escape(text)) == text and chat.HEAD not in chat.escape(text) and chat.TAIL not in chat.escape(text)
        turns = [{"role": role, "text": text}, {"role": "user", "text": text}]
        assert chat.read_marked(chat.marked(turns)) == [(role, text), ("user", text)]


def begin(turns):
    return "<s>" + "".join(f"[{t['role']}] {t['text']} " for t in turns)


def footed(turns):
    return "".join(f"<{t['role']}>{t['text']}</>" for t in turns) + "END"


def forgetful(turns):
    """Leaves what assistants thought out of all but the last turn."""
    return "".join(f"<{t['role']}>{t['text'] if i == len(turns) - 1 else re.sub('think.*?;', '', t['text'])}" for i, t in enumerate(turns))


def trimmed(turns):
    return "".join(f"<{t['role']}>{t['text'].strip()}" for t in turns)


def test_spans_of_black_boxes():
    turns = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "think so; yes"}, {"role": "user", "text": ""}, {"role": "assistant", "text": " done"}]
    for template in (begin, footed, chat.marked):
        text, found, rewrites, far = chat.formatted(template, [], turns, "assistant")
        assert text == template(turns) and rewrites == [] and not far
        assert [text[s["text_start"] : s["text_end"]] for s in found if s["role"] == "assistant"] == ["think so; yes", " done"]
        assert all(s["text_start"] is None for s in found if s["role"] == "user")
        assert all(a["end"] == b["start"] for a, b in zip(found, found[1:])) or template is footed
    text, found, rewrites, _ = chat.formatted(forgetful, [], turns, "assistant")
    assert text == forgetful(turns) and rewrites == [2]
    assert found[1]["start"] is None and found[1]["text_start"] is None and text[found[3]["text_start"] : found[3]["text_end"]] == " done"
    _, found, _, _ = chat.formatted(trimmed, [], turns, "assistant")
    assert found[3]["end"] - found[3]["start"] == len("<assistant>done")
    twice = lambda turns: "".join(t["text"] + t["text"] for t in turns)
    assert all(s["text_start"] is None for s in chat.formatted(twice, [], turns, "assistant")[1])


def test_windows_of_long_conversations():
    turns = [{"role": ["user", "assistant"][i % 2], "text": f"t{i}"} for i in range(300)]
    text, found, rewrites, far = chat.formatted(begin, [], turns, "assistant")
    assert text == begin(turns) and rewrites == [] and not far
    assert [text[s["text_start"] : s["text_end"]] for s in found if s["role"] == "assistant"] == [t["text"] for t in turns if t["role"] == "assistant"]
    numbered = lambda turns: "".join(f"{i}{t['text']}" for i, t in enumerate(turns))
    assert chat.formatted(numbered, [], turns, "assistant")[3]  # looks back to the first turn


@pytest.mark.parametrize("batch", [5, 10000])
def test_formatted_conversations(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = [(c, t, r, x if i % 4 else (x or "") + "\\### </turn>") for i, (c, t, r, x) in enumerate(conversations())]
        by = ordered(rows, "", marks(spark, rows, ""))
        by[-7] = [(0, "user", chat.TRAP_TEXT), (1, "assistant", chat.TRAP_TEXT)]
        got = chat.digest(chat.format_conversations(chat.with_trap(frame(spark, rows)))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(g["conv_id"]) for g in got) == sorted(map(str, by))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for g in got:
        turns = by[g["conv_id"]]
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = chat.marked([{"role": r, "text": t} for _, r, t in turns])
        assert tuple(g)[1:] == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), len(whole))


def test_formatting_of_odd_tables_and_templates(spark):
    assert chat.digest(chat.format_conversations(frame(spark, []))).count() == 0
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "think a; b"), (1, 2, "user", "more")]
    out = chat.format_conversations(frame(spark, rows), forgetful).orderBy("at").collect()
    assert [list(r["rewrites"]) for r in out if r["rewrites"]] == [[2]] or len(out) > 1
