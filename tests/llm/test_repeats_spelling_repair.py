"""Operators 11 to 13 against plain versions, on awkward rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from playerday.llm import suffixes
from playerday.llm.collection_bwt import repeated, segments
from playerday.llm.repair import edits, parse, repair
from playerday.llm.spelling import variants

SPACES = " \t\n\x0b\x0c\r"


def test_segments_are_the_sorted_suffixes():
    rng = random.Random(1)
    for trial in range(200):
        strings = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd\0") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 8))]
        first = np.array([rng.randint(-3, 3) for _ in strings], np.int64)
        seen = 0
        for column, who, prefix, bwt in segments(strings, first, 5):
            found = [strings[w][column - first[w] :] for w in who]
            seen += len(found)
            assert found == sorted(found)
            for i, w in enumerate(who):
                shared = 0
                while i and shared < min(len(found[i]), len(found[i - 1])) and found[i][shared] == found[i - 1][shared]:
                    shared += 1
                at = column - first[w]
                assert prefix[i] == min(shared, 5) and bwt[i] == (strings[w][at - 1] if at else -1)
        assert seen == sum(len(s) + 1 for s in strings)
        places = np.array([rng.randint(1, 2) for _ in strings], np.int64)
        total = Counter()
        for s, f, n in zip(strings, first, places):
            for i in range(len(s) - 2):
                total[i + f, s[i : i + 3]] += n
        want = [{i + f for i in range(len(s) - 2) if total[i + f, s[i : i + 3]] > 1} for s, f in zip(strings, first)]
        assert [{x for a, b in ranges for x in range(a, b)} for ranges in repeated(strings, first, places, 3)] == want


def plain_removal(texts):
    total = Counter(x[i : i + 200] for x in texts for i in range(len(x) - 199))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if total[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_repeats_against_counting(spark, hot, monkeypatch):
    """Passages at other places, overlapping ones, periodic text, copies, texts that share all but an end; a hot anchor is one of three stretches."""
    monkeypatch.setattr(suffixes.repeated_columns, "__defaults__", (hot, suffixes.LEVELS))
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, longer = word(230), word(700)
    texts = [None, "", "short", word(199), word(200), "a" * 700, "ab" * 300, word(900), longer, longer, longer[:400] + word(100)]
    texts += [word(rng.randint(0, 300)) + passage[rng.randint(0, 40) :] + word(rng.randint(0, 300)) for _ in range(12)]
    texts += [word(50) + passage + word(20) + passage, longer[100:420], longer[250:] + longer[:260], "nul\0" + passage]
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    want = Counter((r[0], *w) for r, w in zip(rows, plain_removal([(t or "").encode() for t in texts])))
    assert Counter(tuple(r) for r in suffixes.remove_repeats(docs).collect()) == want
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def plain_variants(rows):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    seen = Counter()
    for id_, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    known = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    letters = {c for w in known for c in w}
    near = {}
    for w in known:
        others = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in letters if j <= len(w)}
        near[w] = {x for x in others - {w} if x in known}
    form = {w: b for w in known if near[w] for b in [min(near[w], key=lambda x: (-known[x], x))] if known[b] >= 10 * known[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), known.get(form.get(w))) for w, n in known.items()}


def test_variants_against_plain_search(spark):
    """Chains of forms, ties, runs of equal letters, accents, long words, repeated rows, nulls."""
    rng = random.Random(8)
    words = ["kleinstadt", "zzzzzzzzz", "ÀÉÿéÿéÿab", "straßenbahnhaltestelle", "abcdefgh"]
    lines = []
    for w in words:
        lines += [w] * 230 + [w[:3] + w[4:]] * 21 + [w[:3] + "q" + w[4:]] * 2 + [w + "s"] * 21 + [w[:5] + "qz" + w[6:]] * 2 + [w.upper()] * 3
    rng.shuffle(lines)
    rows = [(rng.choice([None, *range(40)]), ", ".join(lines[i : i + 9])) for i in range(0, len(lines), 9)] + [(1, None), (2, ""), (3, "x7y"), (4, "abcdefgh"), (4, "abcdefgh")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, n int")
    found = variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows)
    assert {tuple(r) for r in found.collect()} == want and any(w[1] and w[1] != w[2] for w in want)  # a chain of two forms
    assert variants(docs.limit(0)).count() == 0


def cheapest(codes):
    """Shortest path over (row, last role), least audit first."""
    heap, seen, best = [(0, "", 0, "")], set(), None
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(codes) and last in ("", "a") and (best is None or (cost, audit) < best):
            best = (cost, audit)
        role = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, role))
        if i < len(codes):
            initial, fault = codes[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if fault not in "bd":
                stays = 3 if fault == "t" else 0
                heapq.heappush(heap, (cost + stays + (0 if initial == role else 3), audit + ("K" if initial == role else "R"), i + 1, role))
                if initial == "s" and last == "":
                    heapq.heappush(heap, (cost + stays, audit + "K", i + 1, "s"))
    return best


def test_parse_against_shortest_paths():
    rng = random.Random(3)
    for _ in range(2000):
        codes = [rng.choice("suax") + rng.choice("bdt----") for _ in range(rng.randint(0, 9))]
        cost, audit = parse(codes)
        assert (cost, audit) == cheapest(codes)
        roles = "".join("".join(x[0] for x in head.split("\n") if x) + ("" if role is None else role[:1] or code[0]) for (head, role), code in zip(edits(codes, audit), [*codes, ""]))
        assert re.fullmatch("(s?(ua)+)?", roles)


def plain_repair(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, codes = set(), []
        for _, role, text in turns:
            body = text.rstrip(SPACES)
            codes.append((role[:1] if role[:1] in ("s", "u", "a") else "x") + ("b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t"))
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        cost, audit = cheapest(codes) if codes else (0, "")
        lines, last, i = [], "", 0
        for edit in audit:
            if edit == "I":
                last = "a" if last == "u" else "u"
                lines.append({"u": "user:", "a": "assistant:"}[last])
                continue
            _, role, text = turns[i]
            i += 1
            if edit != "D":
                last = role[0] if edit == "K" else "a" if last == "u" else "u"
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
        faults = Counter(c[1] for c in codes)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_against_plain_version(spark):
    rng = random.Random(2)
    text = lambda: rng.choice(["Yes.", "No", "", " \t", "Why?\n", "again!", "été.", "two\nlines.", "x" * 5000])
    rows = [(c if c else None, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None]), rng.choice([text(), text(), None])) for c in range(120) for _ in range(rng.randint(1, 9))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)] + rows[:40]
    chat = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv int")
    assert {r.conv_id: tuple(r)[1:] for r in repair(chat).collect()} == plain_repair(rows)
    lone = chat.where(F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20 == 0).limit(1)
    assert [tuple(r)[1:] for r in repair(lone).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair(chat.limit(0)).count() == 0
