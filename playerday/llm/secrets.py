"""Secret scan of whole texts by one combined automaton."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.llm.automaton import Scanner
from playerday.llm.common import table

# The rules, in the order in which their kinds are listed.
RULES = {
    "assign": rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]{16,}",
    "private_key": rb"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "forge_token": rb"gh[opsu]_[A-Za-z0-9]+",
    "web_token": rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}
BASE = ("assign", "access", "hex")
# Shorter matches are dropped (they still take their place in the text). Lengths that a
# rule itself would count multiply the automaton's states, so only the run of hex digits counts there.
LEAST_LENGTH = {"access": 18, "forge_token": 34}
LEAST_VALUE = 12
_VALUE = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

Span = tuple[str, int, int]
_scanner: Scanner | None = None


def scanner() -> Scanner:
    """The compiled rules, built once by the driver and broadcast (a fixed size, whatever the data)."""
    global _scanner
    if _scanner is None:
        _scanner = Scanner(RULES)
    return _scanner


def secret_spans(text: str | None, scan: Scanner | None = None) -> list[Span]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    data = (text or "").encode("utf-8", "replace")
    scan = scan or scanner()
    found = []
    for n, start, end in scan.find(data):
        kind = scan.names[n]
        if kind == "assign" and len(_VALUE.fullmatch(data, start, end)[1]) < LEAST_VALUE:
            continue
        if end - start >= LEAST_LENGTH.get(kind, 0):
            found.append((start, n, end))
    found.sort()
    if not data.isascii():
        marks, at, points = {}, 0, 0
        for b in sorted({b for s, _, e in found for b in (s, e)}):
            points += len(data[at:b].decode("utf-8"))
            at, marks[b] = b, points
        return [(scan.names[n], marks[s], marks[e]) for s, n, e in found]
    return [(scan.names[n], s, e) for s, n, e in found]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(text: Column) -> Column:
    """array<struct<kind,start,end>> of whole texts, in code points; null and empty texts give none.

    Every byte is read once, whatever the number of rules, so a very long text
    costs in proportion to its length. A row depends on its text alone: repeated
    rows get equal spans, other columns play no part whatever their names, and
    an empty table gives no rows.
    """

    shared = SparkSession.active().sparkContext.broadcast(scanner())

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(x, shared.value)] for x in texts], dtype="object")

    return spans(text)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts by base kind, digest of the base spans, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", scan_secrets(F.col("text")).alias("found"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return docs.select("doc_id", *[of(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
