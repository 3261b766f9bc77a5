"""Personal data: exact base patterns, and a semi-Markov random field that adds spans."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.llm.common import table
from playerday.llm.semicrf import ENDINGS, TYPES, SemiCrf, luhn, octet, tokenise, train

KINDS = TYPES[1:]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match (each begins at the start of a run of digits) but keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NUMBERS = re.compile(r"[0-9](?:[0-9 \t().\[\]{}<>/+-]|(?<=[ (\[{<])(?:dot|DOT)(?=[ )\]}>]))*")
_BRACKETED = re.compile(r"[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]")
_HOST = r"[A-Za-z0-9-]+"
_DOT = r"(?:\x20?[(\[{<]\x20?(?:\.|dot|DOT)\x20?[)\]}>]\x20?|\x20(?:dot|DOT|\.)\x20|\.)"
#: " at " counts as a sign only before a domain that is spelt out or ends like one.
_ENDED = rf"{_HOST}(?:\.{_HOST})*\.(?:{'|'.join(sorted(ENDINGS))})(?![A-Za-z0-9-])"
_MARK = re.compile(rf"[(\[{{<]\s?(?:at|AT|@)\s?[)\]}}>]|@|(?<=\x20)(?:at|AT)(?=\x20(?:{_HOST}\x20(?:dot|DOT|\.)\x20|{_ENDED}))")
_SPELT_DOMAIN = re.compile(rf"\s?{_HOST}(?:{_DOT}{_HOST})+")
#: No address is longer (a name of 64 and a domain of 255 characters), and so many characters beside a stretch are its context.
MOST_ADDRESS, CONTEXT = 320, 20
#: An added span must beat reading its tokens as plain text by this much log-likelihood.
LEAST_GAIN = 1.0

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: around each at sign the whole run of local characters before it and the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind as listed and then start."""
    found: list[Span] = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _may_have_address(text: str) -> bool:
    return "@" in text or " at " in text or " AT " in text or bool(_BRACKETED.search(text))


def stretches(text: str) -> list[tuple[int, int]]:
    """Where an entity may stand: runs of digits and their marks, and names and domains around an at sign, spelt out or not.

    Every candidate of the random field lies within one; the work is linear in the text.
    """
    out = []
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= 7:
            start = m.start()
            while start and text[start - 1] in "+([":
                start -= 1
            out.append((start, m.end()))
    if _may_have_address(text):
        last = 0
        for m in _MARK.finditer(text):
            if domain := _SPELT_DOMAIN.match(text, m.end(), m.end() + MOST_ADDRESS):
                start = m.start() - (text[m.start() - 1 : m.start()] == " ")
                least = max(last, start - MOST_ADDRESS)
                while start > least and text[start - 1] in _LOCAL:
                    start -= 1
                out.append((start, domain.end()))
                last = domain.end()
    merged: list[tuple[int, int]] = []
    for start, end in sorted(out):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _apart(spans: list[Span]) -> list[Span]:
    """Of overlapping spans the first, longest one."""
    out: list[Span] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if not out or s >= out[-1][2]:
            out.append((k, s, e))
    return out


def examples_of(text: str | None) -> list[dict]:
    """Every base span of a text with its context on both sides, for training."""
    text = text or ""
    spans = _apart(base_spans(text))
    edges = [0, *(e for _, _, e in spans)], [*(s for _, s, _ in spans[1:]), len(text)]
    return [{"left": text[max(a, s - CONTEXT) : s], "value": text[s:e], "right": text[e : min(b, e + CONTEXT)], "kind": k} for (k, s, e), a, b in zip(spans, *edges)]


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card_number(rng, good: bool) -> str:
    body = rng.choice(list("3456")) + _digits(rng, 14)
    return next(body + d for d in "0123456789" if luhn(body + d) == good)


def _amex(rng, good: bool) -> str:
    """15 digits, as some cards have."""
    body = rng.choice(["34", "37"]) + _digits(rng, 12)
    return next(body + d for d in "0123456789" if luhn(body + d) == good)


def _parted(rng, digits: str, marks: tuple[str, ...]) -> str:
    return str(rng.choice(marks)).join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _national(rng, country: str = "") -> str:
    """A phone number as it is written within a country, or abroad without a plus sign."""
    area, a, b = str(rng.integers(200, 990)), _digits(rng, 3), _digits(rng, 4)
    pairs = [_digits(rng, 2) for _ in range(4)]
    forms = (
        ["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "({0}) {1} {2}", "({0}){1}-{2}", "{0} {1} {2}", "1 ({0}) {1}-{2}", "1-{0}-{1}-{2}", "0{0} {1} {2}", "0{0}/{1}{2}", "00{3} {0} {1} {2}", "00{3} {0} {1}{2}", "{3}-{0}-{1}-{2}", "{3} {0} {1} {2}", "+{3} ({0}) {1}-{2}"]
        + ["0{5} {4}", "0{5} {4}", "0{5}-{4}", "00{3} {5} {4}", "00 {3} {0} {1} {2}", "00 {3} {5}{5} {2} {2}", "{3} {6} {7}", "0{6} {7}", "0{0}-{6}", "({3}) {0} {1} {2}"]
    )
    form = str(rng.choice(forms))
    parted = ("-" if "-" in form else " ").join(pairs)
    return form.format(area, a, b, country or rng.integers(1, 99), parted, rng.integers(1, 10), f"{rng.integers(6, 10)}{_digits(rng, 4)}", _digits(rng, 5))


def _mail(rng, value: str) -> str:
    """An address with its signs spelt out."""
    name, _, domain = value.partition("@")
    dot = str(rng.choice([".", ".", " [dot] ", "[.]", " dot ", "(dot)", "<dot>", " . "]))
    if dot in (" dot ", " . "):
        return name + str(rng.choice([" at ", " @ "])) + domain.replace(".", dot)
    if dot == "." and set(name) & set("._0123456789") and domain.rpartition(".")[2] in ENDINGS and rng.random() < 0.6:
        return f"{name} at {domain}"
    return name + str(rng.choice(["(at)", "[at]", " (at) ", " [at] ", "{at}", "<at>", "[@]", "(@)", " @ "] if dot == "." else ["(at)", "[at]", " [at] ", "<at>", "[@]", "@"])) + domain.replace(".", dot)


def disguised(rng, kind: str, value: str) -> str:
    """The same entity in another common form, one that the base patterns miss."""
    if kind == "email":
        return _mail(rng, value)
    if kind == "ip":
        mark = str(rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)"]))
        return value.replace(".", mark) if rng.random() < 0.8 or "dot" in mark else mark.join(value.rsplit(".", 1))
    if kind == "card":
        return _parted(rng, _NOT_DIGIT.sub("", value), (".", " - ", "/", "  "))
    return _national(rng)


def other_number(rng) -> str:
    """A number that is nobody's: a date, a time, an amount, a version, an order number, a failed check sum."""
    d, i = _digits, rng.integers
    forms = (
        lambda: f"{i(1990, 2030)}-{i(1, 13):02}-{i(1, 29):02}", lambda: f"{i(1, 29):02}/{i(1, 13):02}/{i(1990, 2030)}", lambda: f"{i(1, 29)}.{i(1, 13)}.{i(1990, 2030)}", lambda: f"{i(1990, 2030)}-{i(1990, 2030)}",
        lambda: f"{i(1990, 2030)}-{i(1, 13):02}-{i(1, 29):02} {i(0, 24):02}", lambda: f"{i(1, 999)} {d(rng, 3)} {d(rng, 3)}", lambda: f"{i(1, 99)}.{d(rng, 3)}.{d(rng, 3)}", lambda: f"{i(1, 9)}.{d(rng, 9)}", lambda: d(rng, int(i(7, 20))),
        lambda: _card_number(rng, False), lambda: _amex(rng, False), lambda: _parted(rng, _card_number(rng, False), (" ", "-", ".")), lambda: f"{i(1, 20)}.{i(0, 20)}.{i(256, 99999)}.{i(0, 9999)}", lambda: f"978-{i(0, 10)}-{d(rng, 2)}-{d(rng, 6)}-{i(0, 10)}", lambda: f"{d(rng, 5)}-{d(rng, 4)}", lambda: f"{d(rng, 8)}-{d(rng, 2)}", lambda: f"{i(1, 9)}.{i(0, 99)}.{i(0, 99)}-{d(rng, 4)}",
        lambda: f"{i(1, 13)} {i(1, 99)} {i(100, 9999)} {i(1, 99)}", lambda: f"{d(rng, 3)}/{d(rng, 4)}", lambda: " ".join(str(i(1, 60)) for _ in range(i(4, 9))), lambda: f"{i(1, 20)} . {i(0, 20)} . {i(256, 99999)} . {i(0, 9999)}", lambda: ".".join(str(i(0, 99)) for _ in range(3)), lambda: "".join(rng.choice(list("0123456789" * 3 + "abcdef"), int(i(16, 41)))),
    )
    return forms[i(len(forms))]()


_BEFORE = {"email": ("mail ", "contact: ", ""), "ip": ("host ", "ip ", ""), "card": ("card ", "visa ", ""), "phone": ("call ", "tel. ", "phone: ", ""), "O": ("version ", "order ", "no. ", "date ", "page ", "", "")}


def made_examples(rng, many: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """`many` examples by rule for each type (phones twice), in many forms, and three times as many numbers that are none."""
    words = ["".join(rng.choice(list("aeinorstlu"), int(rng.integers(2, 8)))) for _ in range(200)]
    some = lambda: " ".join(rng.choice(words, int(rng.integers(0, 4))))
    out = []
    for n in range(many * 8):
        kind = (*KINDS, "phone", "O", "O", "O")[n % 8]
        if kind == "email":
            value = disguised(rng, kind, f"{rng.choice(words)}{rng.choice(['', '.', '_'])}{rng.choice(words)}@{rng.choice(words)}{rng.choice(['', '-x', '3'])}.{rng.choice(['com', 'org', 'net', 'de', 'it', 'fr', 'example.com', 'co.uk'])}")
        elif kind == "ip":
            value = ".".join(str(rng.integers(0, 256)) for _ in range(4))
            value = value if rng.random() < 0.3 else disguised(rng, kind, value)
        elif kind == "card":
            number = _amex(rng, True)
            value = str(rng.choice([number, f"{number[:4]} {number[4:10]} {number[10:]}", f"{number[:4]}-{number[4:10]}-{number[10:]}"])) if rng.random() < 0.25 else disguised(rng, kind, _card_number(rng, True))
        else:
            value = _national(rng) if kind == "phone" else other_number(rng)
        cued = kind == "phone" and rng.random() < 0.15  # ten digits in a row are a phone number only after a word that says so
        value = str(rng.integers(200, 990)) + _digits(rng, 7) if cued else value
        left = " ".join(filter(None, (some(), str(rng.choice(_BEFORE[kind])).strip())))
        left = f"{some()} {rng.choice(['tel', 'phone', 'call', 'mobile', 'fax'])}{rng.choice([':', ': ', ' '])}" if cued else left + (" " if left else "")
        right = str(rng.choice(["", ".", " " + some(), ". " + some(), ", " + some()]))
        if not cued and rng.random() < 0.2:
            left = right = ""
        out.append((left + value + right, [] if kind == "O" else [(len(left), len(left) + len(value), kind)]))
        if kind == "O" and n % 3 == 0:  # an at sign that is no address
            out.append((f"{some()} @ {rng.choice(words)} {some()}. {str(rng.choice(words)).title()}", []))
            out.append((f"{rng.choice(words)} at {rng.choice(words)}.{rng.choice(words)} {some()}", []))
            out.append((f"{some()} {rng.choice(words)} at {rng.choice(words)}.{rng.choice(['com', 'org', 'net', 'de'])} {some()}", []))
    return out


def fit(docs: DataFrame, most: int = 200, made: int = 120) -> SemiCrf:
    """Fit the random field on examples made by rule and on at most `most` entities of the corpus, with and without disguise.

    The base patterns mark the corpus's entities (those with the smallest
    hashes of all), so no labels are needed. `made` examples of each type teach
    forms that the corpus's base spans can't show; without any text the field
    is that of these alone.
    """

    @F.pandas_udf("array<struct<left:string,value:string,right:string,kind:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([examples_of(x) for x in texts], dtype="object")

    rows = docs.where(F.col("text").rlike("[0-9@]")).select(F.explode(found("text")).alias("x")).select("x.*")
    sample = rows.distinct().orderBy(F.xxhash64("left", "value", "right"), "left", "value", "right").limit(most).collect()
    rng = np.random.default_rng(11)
    examples = made_examples(rng, made)
    for r in sample:
        for value in (r["value"], disguised(rng, r["kind"], r["value"])):
            examples.append((r["left"] + value + r["right"], [(len(r["left"]), len(r["left"]) + len(value), r["kind"])]))
        other = other_number(rng)
        examples.append((r["left"] + other + r["right"], []))
    return train(examples)


def pii_spans(text: str | None, model: SemiCrf | None) -> list[Span]:
    """Base spans, and those that the model adds beside them; by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    if model is None or not (_DIGIT.search(text) or _may_have_address(text)):
        return base
    found, last = list(base), 0
    taken, t = sorted((s, e) for _, s, e in base), 0
    places = stretches(text)
    for n, (start, end) in enumerate(places):
        parts, at, limit = [], start, places[n + 1][0] if n + 1 < len(places) else len(text)
        while t < len(taken) and taken[t][1] <= start:
            t += 1
        k = t
        while k < len(taken) and taken[k][0] < end:
            parts.append((at, taken[k][0]))
            at, k = max(at, taken[k][1]), k + 1
        parts.append((at, end))
        for a, b in parts:
            if b - a < 5:
                continue
            a = max(last, a - CONTEXT) if a == start else a
            b = min(limit, b + CONTEXT) if b == end else b
            tokens = tokenise(text[a:b])
            places_at = np.cumsum([a, *(len(x) for _, x in tokens)]).tolist()
            for i, j, y, gain in model.decode(tokens):
                s, e = places_at[i], places_at[j]
                if gain >= LEAST_GAIN and not any(s < f and e > g for g, f in taken[max(0, t - 1) : k + 1]):
                    found.append((TYPES[y], s, e))
        last = end
    return sorted(set(found), key=lambda x: (KINDS.index(x[0]), x[1]))


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(text: Column, model: SemiCrf | None) -> Column:
    """array<struct<kind,start,end,base>> of whole texts, in code points; null and empty texts give none.

    A row depends on its text alone, so repeated rows get equal spans. The work
    is linear in a text's length, also where it is one very long word.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)  # features of at most `most` regions

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            base = set(base_spans(x or ""))
            out.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in base} for k, s, e in pii_spans(x, shared.value)])
        return pd.Series(out, dtype="object")

    return spans(text)


def masked(text: str | None, model: SemiCrf | None) -> str | None:
    """The text with every found span replaced by its kind, as <EMAIL>; overlapping spans share one mark."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in _apart(pii_spans(text, model)):
        out += (text[at:s], f"<{kind.upper()}>")
        at = e
    return "".join(out) + text[at:] if out else text


def mask_pii(docs: DataFrame, most: int = 200) -> DataFrame:
    """docs with personal data in text masked and n_chars brought up to date; every row and column stays.

    Null and empty texts stay as they are, very long ones are masked whole, repeated rows alike.
    """
    model = fit(docs, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(x, shared.value) for x in texts], dtype="object")

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.lit(0).cast("bigint")))
    return out.select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts by kind and digest of the base spans, all spans."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", find_pii(F.col("text"), fit(docs)).alias("found"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("found", lambda x: x["base"])

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
