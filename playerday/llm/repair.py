"""Repair of damaged conversations: cheapest edits to s?(ua)+ by bottom-up interval parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playerday.llm.common import discard, materialise, table

#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

Cell = tuple[int, str]

# A span derives a piece of the string of roles: nothing (the empty key), or a piece that begins with one
# role and ends with one, s only in front: "su" is a piece from s to u. These are the non-terminals;
# XY -> XP QY for each PQ that may stand side by side, XY -> XY empty, XY -> empty XY.
_BESIDE = ("su", "ua", "au")


def join_cells(left: dict[str, Cell], right: dict[str, Cell]) -> dict[str, Cell]:
    """The cell of two neighbouring spans: by non-terminal the least (cost, audit).

    Where costs are equal no audit of a span begins another one (a longer one
    would cost its insertions more), so the least audits of the parts give the
    least audit of the whole. A piece is cut at any place into pieces, so one
    cut of a span stands for all.
    """
    out: dict[str, Cell] = {}
    for a, (cost_a, audit_a) in left.items():
        for b, (cost_b, audit_b) in right.items():
            if a and b and a[-1] + b[0] not in _BESIDE:
                continue
            key = a[:1] + b[-1:] if a and b else a or b
            one = (cost_a + cost_b, audit_a + audit_b)
            if key not in out or one < out[key]:
                out[key] = one
    return out


def _inserted() -> dict[str, Cell]:
    """What insertions alone make, from nothing to the pieces that a repair can need between two rows: closed under joining."""
    cell = {"": (0, ""), "uu": (INSERT, "I"), "aa": (INSERT, "I")}
    while (more := join_cells(cell, cell)) != cell:
        cell = more
    return cell


INSERTED = _inserted()


def _leaf(code: str) -> dict[str, Cell]:
    """A row between possible insertions. code: its role's initial and its fault (b, d, t or -)."""
    initial, fault = code[0], code[1]
    cell: dict[str, Cell] = {"": (DELETE, "D")}
    if fault not in "bd":
        stays = TRUNCATED if fault == "t" else 0
        for role in "ua":
            cell[role * 2] = (stays, "K") if role == initial else (REROLE + stays, "R")
        if initial == "s":
            cell["ss"] = (stays, "K")
    return join_cells(join_cells(INSERTED, cell), INSERTED)


def parse(codes: list[str]) -> Cell:
    """(cost, audit) of the cheapest repair of rows given by their codes, ASCII-least audit among the cheapest.

    Spans of one row come first, then spans of two, four and so on: each joins
    two of half its length, so a conversation of n rows takes n joins.
    """
    leaves = {c: _leaf(c) for c in set(codes)}
    level = [leaves[c] for c in codes] or [INSERTED]
    while len(level) > 1:
        level = [join_cells(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return min(level[0][k] for k in ("", "ua", "sa") if k in level[0])


def edits(codes: list[str], audit: str) -> list[tuple[str, str | None]]:
    """By row (lines inserted before it, the role it gets or None if it goes), then the lines inserted at the end."""
    out: list[tuple[str, str | None]] = []
    lines, last, row = "", "", 0

    def following() -> str:
        return "a" if last == "u" else "u"

    for edit in audit:
        if edit == "I":
            last = following()
            lines += f"{ROLES[last]}:\n"
            continue
        role = None
        if edit == "R":
            last = following()
            role = ROLES[last]
        elif edit == "K":
            last = codes[row][0]
            role = ""  # its own
        out.append((lines, role))
        lines, row = "", row + 1
    return [*out, (lines, None)]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of the row's ids draws; nulls of role and text are one space."""
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *ids).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind <> 0").select("conv_id", "turn", "role", "text", twice.alias("copy")).drop("copy")


def _fault(seen: Column) -> Column:
    """b, d, t or -: the row's first fault; seen: its number among the rows of its role and text."""
    body = F.rtrim(F.col("text"), F.lit(_SPACES))
    return F.when(body == "", "b").when(seen > 1, "d").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "t").otherwise("-")


def numbered(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with their position in the conversation, code (initial and fault) and whether the role may follow the one before.

    Order: turn, nulls first; then role and text, so ties have one order. One
    exchange by conv_id serves both windows.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    by = Window.partitionBy("conv_id").orderBy(*order)
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    initial = F.substring("role", 1, 1)
    beside = F.concat(F.lag(initial).over(by), initial)
    out = rows.withColumns({"position": F.row_number().over(by), "beside": beside, "fault": _fault(seen)})
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")  # no other initial can stay
    return out.select("conv_id", "turn", "role", "text", "position", F.concat(known, "fault").alias("code"), "fault", (~F.col("beside").isin(*_BESIDE)).alias("illegal"))


def _parsed(codes: pd.Series) -> pd.DataFrame:
    """heads and roles: edits() by row, the last head for the end."""
    out, known = [], {}
    for joined in codes:
        if joined not in known:
            rows = [joined[i : i + 2] for i in range(0, len(joined), 2)]
            cost, audit = parse(rows)
            done = edits(rows, audit)
            known[joined] = (cost, audit, [h for h, _ in done], [r for _, r in done[:-1]])
        out.append(known[joined])
    return pd.DataFrame(out, columns=["cost", "audit", "heads", "roles"])


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, line, last) in order -> (conv, sha256 of all its lines), a line at a time."""
    begun, digest = None, None
    for batch in batches:
        convs, sums = [], []
        for conv, line, last in zip(*(c.to_pylist() for c in batch.columns)):
            if begun != conv:
                begun, digest, tail = conv, hashlib.sha256(), ""
            whole = tail + line
            digest.update(whole[:-1].encode("utf-8", "replace"))
            tail = whole[-1:]  # the last line feed separates only if another line follows
            if last:
                convs.append(conv)
                sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(sums, pa.string())], names=["conv", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conv_id of the damaged table.

    Text is split from structure: a conversation's codes, two letters a row,
    are parsed in one row, as long as the audit that is its result; the texts
    take their edits by (conversation, position), spread over all tasks, and
    are hashed in order a line at a time, so a very long conversation is never
    held whole. Its rows do meet in the sorts by position, which spill.

    A null conv_id is a conversation of its own; null roles and texts are one
    space; other initials than s, u and a are deleted or reroled; repeated rows
    are duplicates; empty texts are blank; very long texts are handled whole;
    columns beside the four are left out, whatever their names; a conversation
    without rows gives zeros, and an empty table no rows.
    """
    parsed = F.pandas_udf(_parsed, "cost bigint, audit string, heads array<string>, roles array<string>")
    convs = conversations.select(F.col("conv_id").alias("conv_id")).distinct()
    convs = materialise(convs.select("conv_id", F.monotonically_increasing_id().alias("conv")), "repair-convs")
    rows = materialise(numbered(damaged(conversations)), "repair-rows")
    known = rows.join(convs, rows["conv_id"].eqNullSafe(convs["conv_id"])).drop(rows["conv_id"])
    count = lambda f: F.count_if(F.col("fault") == f)
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: x["code"]), "")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    facts = known.groupBy("conv").agg(gaps.cast("bigint").alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), F.count_if("illegal").alias("illegal"), codes.alias("codes"))
    facts = materialise(facts.withColumn("parsed", parsed("codes")).select("*", "parsed.*").drop("parsed", "codes"), "repair-facts")
    row_edits = facts.select("conv", F.posexplode("heads").alias("at", "head"), "roles").select("conv", (F.col("at") + 1).alias("position"), "head", F.get("roles", F.col("at")).alias("new"), (F.col("at") == F.size("roles")).alias("last"))
    texts = known.select("conv", "position", "role", "text")
    lines = row_edits.join(texts, ["conv", "position"], "left")
    own = F.when(F.col("new").isNull(), "").otherwise(F.concat(F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")), F.lit(":"), F.col("text"), F.lit("\n")))
    lines = lines.select("conv", F.concat("head", own).alias("line"), "last", "position").repartition("conv").sortWithinPartitions("conv", "position")
    hashes = lines.select("conv", "line", "last").mapInArrow(_hash_lines, "conv bigint, repaired_sha256 string")
    out = convs.join(facts.drop("heads", "roles"), "conv", "left").join(hashes, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    done = materialise(out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")), "repair-done")
    for used in (convs, rows, facts):
        discard(used)
    return done


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults and cheapest repair of every conversation."""
    return repair(table(spark, sf_dir, "conversations"))
