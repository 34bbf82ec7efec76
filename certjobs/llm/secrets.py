"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certjobs.llm.common import attach, text_of, written

#: The three base patterns, the group that holds the secret, and its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: A span as it is kept: the secret only by its SHA-256.
KEPT = "array<struct<start:int,ord:int,kind:string,end:int,secret:string>>"
#: The kind that ownership decides on: long tokens with a small letter, a capital and a digit.
OPAQUE = (r"[A-Za-z0-9+/_=-]+", 0, 32)
#: A value that more owners than this share is a copied example, not a live credential.
MOST_OWNERS = 1

SPAN = "struct<start:int,ord:int,kind:string,end:int,value:string>"


#: Matches that are walked through one after the other; blocks of them are put together by their lengths.
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int, gate: str | None = None) -> Column:
    """Matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least`` or more characters, as an
    array of (start, ord, kind, end, value); positions are code points.

    What lies between the matches (``split``) and the matches themselves (``regexp_extract_all``) come from the same
    left-to-right scan; their lengths, summed, are the positions: within blocks of matches first, then block by block, so that
    no list grows by one element at a time over all matches of a text.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), gaps.alias("gap")
    )
    none = F.array().cast(f"array<{SPAN}>")
    span = lambda begin, end, value: F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")).cast(SPAN)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["all"]), F.lit(0))
        long_enough = F.coalesce(F.length(x["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(long_enough, F.concat(state["out"], F.array(span(begin, end, x["value"])))).otherwise(state["out"]).alias("out"))

    def blocks(matches: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
        one = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.transform(starts, lambda b: F.aggregate(F.slice(matches, b * BLOCK + 1, BLOCK), one, step))

    def placed(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        before = F.aggregate(parts, zero, lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")), lambda s: s["before"])
        moved = lambda at: lambda s: span(s["start"] + at, s["end"] + at, s["value"])
        return _let(before, lambda at: F.flatten(F.transform(parts, lambda x, i: F.transform(x["out"], moved(F.get(at, i))))))

    return F.when(text.rlike(gate or pattern), _let(found, lambda m: _let(blocks(m), placed))).otherwise(none)


def candidates(docs: DataFrame, key: str, text: str, owner: str, repository: str) -> DataFrame:
    """One row per document: its base spans, its opaque candidates, and a row key that equal rows share."""
    body = text_of(text)
    # the gates only spare the scan for texts without any match that is long enough
    gates = {"access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
    base = [spans(body, kind, n, *KINDS[kind], gate=gates.get(kind)) for n, kind in enumerate(KINDS)]
    opaque = F.filter(
        spans(body, "opaque", len(KINDS), *OPAQUE, gate=r"[A-Za-z0-9+/_=-]{32}"),
        lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"),
    )
    sealed = lambda s: F.struct(s["start"], s["ord"], s["kind"], s["end"], F.sha2(s["value"], 256))
    return docs.select(
        F.col(key).alias("doc_id"), F.sha2(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("")), F.sha2(body, 256)), 256).alias("row_key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.array_sort(F.transform(F.concat(*base), sealed).cast(KEPT)).alias("base"), F.transform(opaque, sealed).cast(KEPT).alias("opaque"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """For each secret's hash: its distinct owners and repositories and its occurrences, over the whole corpus."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "opaque")).alias("s"))
    hashed = each.select("s.secret", "owner", "repository")
    by_repository = hashed.groupBy("secret", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("secret", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return by_owner.groupBy("secret").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("uses"))


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_spans``, ``spans`` (strings of
    kind:start:end), ``n_live`` (base secrets that at most ``most_owners`` owners have) and ``n_copied`` (the others).

    ``spans`` holds the base spans and those opaque tokens that at most ``most_owners`` owners have: a long token that
    only one owner's repositories hold looks like a live credential, one that many owners copied is an example. Values
    are only ever grouped by their SHA-256. Null texts count as empty; null owners are one owner; rows that are alike
    are judged alike; an empty table gives no rows.
    """
    found = written(candidates(docs, key, text, owner, repository), "candidates")  # read three times below, without texts
    frequency = ownership(found)
    each = found.select("row_key", F.explode(F.concat("base", "opaque")).alias("s")).withColumn("secret", F.col("s.secret"))
    judged = attach(each, frequency, ["secret"], "uses")
    few = F.col("owners") <= most_owners
    is_opaque = F.col("s.kind") == "opaque"
    bare = F.struct(F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    per_row = judged.groupBy("row_key").agg(
        F.collect_set(F.when(is_opaque & few, bare)).alias("extra"),
        F.size(F.collect_set(F.when(~is_opaque & few, bare))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(~is_opaque & ~few, bare))).cast("long").alias("n_copied"),
    )
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    narrow = found.select("doc_id", "row_key", *[count(k) for k in KINDS], plain.alias("base"))
    out = narrow.join(per_row, "row_key", "left")
    extra = F.coalesce("extra", F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>"))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], _joined(F.col("base")).alias("base_spans"), _joined(F.array_sort(F.concat("base", extra))).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
    )
