"""Edge cases and brute-force comparisons of the corpus operators."""

import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from playerday.llm import automaton, components, fingerprints, mixing, neighbours, packing, pii, quality, secrets, semicrf, simhash, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    base = prose(rng, 200)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(60, base, "en", "src0", 0), (61, base, "en", "src1", 0), (62, base + " tail", "en", None, 0), (63, None, None, None, None), (64, "", "en", "src0", 0), (64, "", "en", "src0", 0), (None, "lost id", "en", "src1", 7), (65, prose(rng, 9000), "en", "src2", 0), (66, " \t\n", "en", "src2", 3)]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(7)).withColumn("fp", F.lit("x")).persist()


def simhash_plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(spark, docs):
    got = {(r.doc_id, r.fp % 2**64): r.component_id for r in simhash.near_duplicate_classes(docs).collect()}
    rows = [(r.doc_id, simhash_plain(r.text)) for r in docs.collect()]
    assert set(got) == set(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4:
                parent[root(i)] = root(j)
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        assert got[row] == (min(ids) if ids else None)
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert 60 in kept and 61 not in kept and 62 not in kept and kept.count(63) + kept.count(64) + kept.count(66) == 1 and None in kept


@pytest.mark.parametrize("distance", [4, 5])
def test_links_are_complete(spark, distance):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for s in seeds for _ in range(12)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = sorted((r.a, r.b) for r in simhash.link_pairs(spark.createDataFrame([(v,) for v in signed], "fp bigint"), distance).collect())
    want = sorted((min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) % 2**64).count("1") <= distance)
    assert got == want


def test_classes_of_many_near_fingerprints(spark):
    rng = random.Random(9)
    values = set()
    for seed in [rng.getrandbits(64) for _ in range(6)]:
        values |= {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(80)}
        for _ in range(12):  # a chain away from the seed
            seed ^= sum(1 << b for b in rng.sample(range(64), 4))
            values.add(seed)
    values = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    checks = {v: 0 if rng.random() < 0.8 else 2**20 - 1 for v in values}
    for bits in (None, 16):
        parent = {v: v for v in values}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for i, a in enumerate(values):
            for b in values[:i]:
                if bin((a ^ b) % 2**64).count("1") <= 4 and (bits is None or bin(checks[a] ^ checks[b]).count("1") <= bits):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
        rows = spark.createDataFrame([(i, v, checks[v]) for i, v in enumerate(values)], "doc_id bigint, fp bigint, check bigint")
        got = {r.fp: (r.class_fp, r.component_id) for r in simhash.classify(rows, 4, bits).collect()}
        first = {}
        for i, v in enumerate(values):
            first.setdefault(root(v), i)
        assert got == {v: (root(v), first[root(v)]) for v in values}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_automaton():
    a = automaton.Automaton([b"ab+c", rb"[0-9]{2,3}"], anywhere=False)
    for text, rule in ((b"abbc", 1), (b"12", 2), (b"1234", 0), (b"ac", 0)):
        s = a.start
        for b in text:
            s = a.table[s + b]
        assert a.rules[s >> 8] == rule


def test_secrets(spark):
    a, b, c = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
    rng = random.Random(2)
    parts = ["password", "Passwd", "secret", "TOKEN", "api_key", "=", ":", " ", '"', "AKIA", "Z9", "é", "0123456789abcdef", "abc", "_", "-", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = sorted([(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in b.finditer(t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in c.finditer(t) if len(m[0]) >= 16])
        assert [x for x in secrets.secret_spans(t) if x[0] in secrets.BASE] == [(secrets.BASE[k], s, e) for s, k, e in want]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000 + " AKIA" + "A" * 16)], "doc_id int, text string")
    assert [len(r[0]) for r in df.select(secrets.scan_secrets(F.col("text"))).collect()] == [0, 0, 1]


def test_pii_base():
    digits = lambda s: re.sub("[^0-9]", "", s)
    e, i, c, p = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(3)
    parts = ["a", "B9", "@", "@x.y", "-", ".", "1", "25", "300", "+", "(", ") ", " ", "4111", "1111", "\n", "é", "000"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 22)))
        want = [("email", m.start(), m.end()) for m in e.finditer(t)] + [("ip", m.start(), m.end()) for m in i.finditer(t) if all(int(x) < 256 for x in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in c.finditer(t) if 16 <= len(digits(m[0])) <= 19 and semicrf.luhn(digits(m[0]))] + [("phone", m.start(), m.end()) for m in p.finditer(t) if 8 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == want


def test_pii_model(spark):
    rows = [(i, f"call +1 (3{i % 10}9) 555-{1000 + i} or write bob.{i}@mail{i % 7}.example.com from 10.0.{i}.{i} on {i}.{i}. end") for i in range(60)]
    docs = spark.createDataFrame(rows + [(99, None), (100, "")], "doc_id int, text string")
    model = pii.fit(docs)
    text = "ring (319) 555-1234 now, version 2.0. and 12 apples"
    assert [(k, text[s:e]) for k, s, e in pii.pii_spans(text, model)] == [("phone", "(319) 555-1234")]
    text = "first +1 (843) 555-7672 170.106.47.218 last"  # the base pattern reads one number too long and drops it
    assert [(k, text[s:e]) for k, s, e in pii.pii_spans(text, model)] == [("ip", "170.106.47.218"), ("phone", "+1 (843) 555-7672")]
    out = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    assert out[3].startswith("call <PHONE> or write <EMAIL> from <IP> on 3.3. end") and out[99] is None and out[100] == ""
    made = pii.fit(docs.limit(0))  # without a corpus, from the made examples alone
    seen, hits, others, wrong = 0, 0, 0, 0
    for text, spans in pii.made_examples(np.random.default_rng(77), 60):
        found = pii.pii_spans(text, made)
        seen, hits = seen + len(spans), hits + sum((k, s, e) in found for s, e, k in spans)
        others, wrong = others + (not spans), wrong + (not spans and bool(found))
    assert hits >= 0.9 * seen and wrong <= 0.01 * others


def test_long_texts_are_linear():
    model = semicrf.train(pii.made_examples(np.random.default_rng(5), 20))
    rng = random.Random(6)
    mixed = "".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(1_000_000))
    for text in (mixed, "(" * 300_000 + "1" * 9, "a@" * 200_000, "0" * 500_000 + ".1.1.1", "1." * 200_000):
        began = time.process_time()
        pii.pii_spans(text, model)
        assert time.process_time() - began < 10


def segmentations(n, segs):
    """All segmentations of n tokens: lists of (first, end, type)."""
    if n == 0:
        yield []
        return
    for rest in segmentations(n - 1, segs):
        yield rest + [(n - 1, n, 0)]
    for a, b, key in segs:
        if b == n:
            for y, may in enumerate(semicrf.allowed(key)):
                if may:
                    for rest in segmentations(a, segs):
                        yield rest + [(a, b, y)]


def test_random_field_against_enumeration():
    rng = np.random.default_rng(4)
    model = semicrf.train(pii.made_examples(rng, 6), passes=1)
    model.moves = rng.normal(size=model.moves.shape)
    for text in ("call 319-555-1234 x", "10.0.0.1 4111", "a@b.com or c@d.org", "4111 1111 1111 1111"):
        tokens = semicrf.tokenise(text)
        segs = semicrf.segments(tokens)
        keys = {(a, b): key for a, b, key in segs}

        def total(parts):
            out, prev = 0.0, 0
            for a, b, y in parts:
                out += model.moves[prev, y] + (model.score(keys[a, b])[y] if y else model.plain(tokens[a]))
                prev = y
            return out

        every = [(total(p), p) for p in segmentations(len(tokens), segs)]
        best, parts = max(every, key=lambda x: x[0])
        model._scores.clear()
        assert [(a, b, y) for a, b, y, _ in model.decode(tokens)] == [p for p in parts if p[2]]
        gold = {(a, b): y for a, b, y in every[len(every) // 2][1] if y}
        truth = next(t for t, p in every if {(a, b): y for a, b, y in p if y} == gold)
        top = max(t for t, _ in every)
        log_z = top + math.log(sum(math.exp(t - top) for t, _ in every))
        value, slope, move_slope = semicrf.gradient(model, tokens, segs, gold)
        assert value == pytest.approx(truth - log_z)
        step = 1e-5
        for f in list(slope)[:6]:
            w = model.weights.setdefault(f, np.zeros(len(semicrf.TYPES)))
            for y in range(len(semicrf.TYPES)):
                w[y] += step
                up = semicrf.gradient(model, tokens, segs, gold)[0]
                w[y] -= 2 * step
                down = semicrf.gradient(model, tokens, segs, gold)[0]
                w[y] += step
                assert (up - down) / (2 * step) == pytest.approx(slope[f][y], abs=1e-4)
        model.moves[0, 4] += step
        up = semicrf.gradient(model, tokens, segs, gold)[0]
        model.moves[0, 4] -= step
        assert (up - value) / step == pytest.approx(move_slope[0, 4], abs=1e-3)


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    words = {}
    for r in docs.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    total = sum(words.values())
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for r in rows:
        assert r.source_size == words[r.source] and r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs, max_broadcast_sources=0).agg(F.sum("taken")).first() == mixing.mix(docs).agg(F.sum("taken")).first()


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, capacity=512).collect()
    by_id, bins = {}, {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in docs.where("doc_id <> 64").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want = [(i // 512, i, len(x := ids[i : i + 512]), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i in range(0, len(ids), 512)]
        assert sorted(by_id[r.doc_id]) == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= sum(r.length for r in rows) / 512 * 1.1 + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_bins_places_everything():
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(rng.randint(1, 60))}
        used = {}
        for length, first, items, first_bin, offset in packing.plan_bins(counts, 100):
            for i in range(items):
                used.setdefault(first_bin + i, []).append((offset, length))
        assert sum(map(len, used.values())) == sum(counts.values())
        assert all(sum(n for _, n in x) <= 100 and [o for o, _ in sorted(x)] == list(np.cumsum([0] + [n for _, n in sorted(x)])[:-1]) for x in used.values())
        assert all(sum(3 * n > 100 for _, n in x) <= 2 for x in used.values())


def test_unicode_words_encode_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    words = packing.WordEncoder(path, most_words=50)
    for text in ("It's a dog's life. Don't!", "Ünïcode Σίσυφος, <|endoftext|> éa.", "a b 12.5, x'. 'quoted.'   ok?!", ""):
        want = t.encode(text, add_special_tokens=False).ids
        assert list(memoryview(words.ids(text)).cast("I")) == want


def test_fingerprints(spark, docs):
    f = fingerprints
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    df = spark.createDataFrame([(long, long), (long, None), (None, ""), ("one two", "ONE\ttwo")], "a string, b string")
    got = [r[0] for r in df.select(f.likeness(f.sketch(F.col("a")), f.sketch(F.col("b")))).collect()]
    assert got == [1.0, 0.0, 1.0, 1.0]
    f_hashes = lambda text: spark.createDataFrame([(text,)], "t string").select(f.sketch(F.col("t"))).first()[0].hashes
    merged = spark.createDataFrame([("p q r s t u v", "u v w x y z")], "a string, b string").select(f.merge(f.sketch(F.col("a")), f.sketch(F.col("b")))).first()[0]
    assert set(merged.hashes) == set(f_hashes("p q r s t u v")) | set(f_hashes("u v w x y z"))
    rows = f.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"], rows_per_bucket=7).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.text, r.next_text) for r in rows) == sorted((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))


def test_warc(spark):
    big = "x" * 1200
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "u v", "small"), (5, "http://e", None), (6, "http://f", "é" * 700), (None, "n", "z" * 1500), (7, "http://a", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("size", F.lit(1))
    path, index = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_records(path, index).collect()}
    assert len(got) == len(rows) and all(r.whole for r in got.values())
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert bytes(got[i].payload) == (b"" if i in (1, 2) else data)
    assert [(i, got[i].record_type, got[i].refers_to) for i in (1, 2, 7, 3)] == [(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (3, "response", None)]
    one = warc.read_records(path, index.where("page_id = 6")).collect()
    assert len(one) == 1 and bytes(one[0].payload) == ("é" * 700).encode()
    path, index = warc.write_archives(pages.limit(0))
    assert warc.read_records(path, index).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:340] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1))
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, block_rows=64, shortlist=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        hit += len(set(want.tolist()) & {v for v, _ in found})
        assert all(abs(s - d[v]) < 1e-9 for v, s in found)
    assert len(got) == 30 and hit >= 0.9 * 300
    assert [v for v, _ in got[0]] == list(range(300, 310))  # ties go to the smaller id
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def _labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad, rude = i % 4 == 0, i % 5 == 0
        words = prose(rng, 40).split()
        if bad:
            words = [w + "%%%" for w in words]
        if rude:
            words[3] = words[20] = "scoundrel"
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 1 if rude else 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(902, None, None)], "doc_id bigint, quality int, toxic int")


def test_quality(spark):
    docs, labels = _labelled(spark)
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", quality.quality_score(F.col("text"), model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.s >= 0.3) == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.fit(docs, labels.limit(0)).score("any") == pytest.approx(0.5)


def test_linear_model_parts():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(80)]
    y = np.array([1.0 if (len(r) % 3) or 2 in r else -1.0 for r in rows])
    good = np.array([sum(k in r for r, v in zip(rows, y) if v > 0) for k in range(12)], float)
    bad = np.array([sum(k in r for r, v in zip(rows, y) if v < 0) for k in range(12)], float)
    ratios = quality.log_count_ratios(good, bad, (good.sum(), bad.sum()))
    for k in range(12):
        assert ratios[k] == pytest.approx(math.log((good[k] + 1) / (good.sum() + quality.WIDTH) / ((bad[k] + 1) / (bad.sum() + quality.WIDTH))), abs=1e-5)
    w, bias = quality.dual_coordinate_descent(rows, y, ratios, passes=400, tolerance=1e-9)
    x = np.zeros((len(rows), 13))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / (np.linalg.norm(ratios[r]) or 1.0)
        x[i, 12] = 1.0
    cost = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    v, least = np.zeros(13), np.inf
    for n in range(1, 40_000):  # plain subgradient descent on the same loss
        v = v - (v - x.T @ (y * (y * (x @ v) < 1))) / (n + 10)
        least = min(least, cost(v)) if n % 50 == 0 else least
    assert cost(np.append(w, bias)) <= least * 1.01 + 1e-6


def test_toxic_features():
    lexicon = {"be:scou": 2.0, "foul": 3.0}
    dense = toxicity.Dense(lexicon)
    text = "You are a scoundrel, FOUL foul you!! b*d soooo 12"
    words = text.split()
    got = dict(zip(toxicity.NAMES, dense.of(text)))
    weights = [0, 0, 0, 2.0, 3.0, 3.0, 0, 0, 0, 0]
    hits, you = [n for n, w in enumerate(weights) if w], [0, 6]
    near = sum(math.exp(-min(abs(h - u) for u in you) / toxicity.NEAR) for h in hits) / len(words)
    want = {"hit_rate": 3 / 10, "weight_rate": 0.8, "top": 3.0, "second": 2.0, "distinct": 2.0, "hits": 3.0, "near_you": near, "you_rate": 0.2, "capitals": 5 / len(text), "loud_words": 0.1, "punctuation": 4 / len(text), "marks": 2 / len(text), "digits": 2 / len(text), "masked": 0.1, "stretched": 0.1, "length": math.log1p(10)}
    assert got == pytest.approx(want)
    assert dense.of(None) == dense.of(" ") == [0.0] * len(toxicity.NAMES)


def test_toxicity(spark):
    docs, labels = _labelled(spark)
    rows = toxicity.fit(docs, labels).score(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert {r.score for r in toxicity.fit(docs, labels.limit(0)).score(docs).collect()} == {0.5}
