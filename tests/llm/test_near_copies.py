"""Near copies against exact similarities of all pairs."""

import random

import pytest

from playerday.llm import simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(texts):
    """The smallest index reachable from each text over pairs of exact similarity 0.8 or more."""
    sets = [shingled(t) for t in texts]
    first = list(range(len(texts)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                first[y] = x
    return [root(i) for i in range(len(texts))]


def texts():
    rng = random.Random(4)
    out = [None, "", " \t", "one", "One", "la de", "de la", "la de la", "a b c d e f", "a b c d e f g"]
    for size in (12, 40, 90, 200):
        base = words(rng, size)
        out.append(" ".join(base))
        for part in (0.3, 0.6, 0.7, 0.85, 0.9, 0.95):  # shared head, other tail: about so much in common
            out += [" ".join(base[: int(size * part)] + words(rng, more)) for more in (0, int(size * (1 - part)))]
        for _ in range(30):  # near the border on both sides
            w = list(base)
            for at in rng.sample(range(size), rng.randint(1, max(1, size // 30))):
                w[at] = words(rng, 1)[0]
            out.append(" ".join(w))
        out += [" ".join(rng.sample(base, size)), " ".join(base).upper()]  # the same words in another order; the same text
        chain = list(base)
        for at in range(0, size, 10):
            chain[at] = words(rng, 1)[0]
            out.append(" ".join(chain))
    out += [" ".join(words(rng, 60) + base[:30]) for _ in range(20)]  # one passage in texts that are otherwise apart
    return out


@pytest.mark.parametrize("backwards", [False, True])
def test_near_copies_are_exact(spark, backwards):
    given = texts()[:: -1 if backwards else 1]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(set(classes(given)))


def test_near_copies_come_through_simhash(spark, monkeypatch):
    """Every fingerprint that could have a near copy is filed and linked at 4 bits, and those links are the first that are verified."""
    from playerday.llm import jaccard

    filed, given = [], []
    classify, star_links = simhash.classify, jaccard.star_links

    def watched(rows, distance=4, check_bits=None):
        filed.append((distance, {r.fp for r in rows.collect()}))
        return classify(rows, distance, check_bits)

    def stars(keys, found, groups):
        given.append({r.node: r.group for r in groups.collect()})
        return star_links(keys, found, groups)

    monkeypatch.setattr(simhash, "classify", watched)
    monkeypatch.setattr(jaccard, "star_links", stars)
    rng = random.Random(8)
    base = words(rng, 400)
    copies = [" ".join([*base[:at], "other", *base[at + 1 :]]) for at in range(0, 400, 40)]
    texts = [" ".join(base), *copies, " ".join(words(rng, 50)), " ".join(words(rng, 50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 11, 12]
    prints = [simhash.fingerprint_of(t, 4, 42) for t in texts]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    (distance, fps), (groups,) = filed[0], given
    assert distance == 4 and fps == set(prints[:11]) and len(groups) == len(set(texts[:11]))
    assert any(near(a, b) for a in fps for b in fps if a != b)
    sizes = [list(groups.values()).count(g) for g in set(groups.values())]
    assert max(sizes) > 1 and len(sizes) == len({min(reach(a, fps, near)) for a in fps})


def reach(a, fps, near):
    """The fingerprints reachable from a over near ones."""
    seen, todo = {a}, [a]
    while todo:
        b = todo.pop()
        fresh = {c for c in fps - seen if near(b, c)}
        seen |= fresh
        todo += fresh
    return seen


def test_rows_of_equal_fp_are_checked(spark):
    far = 2**40 - 1
    given = [(0, 5, 0), (1, 5, far), (2, 5, 3), (3, 4, far - 1), (4, 5, far), (5, 1 << 50, 0)]
    rows = spark.createDataFrame(given, "doc_id bigint, fp bigint, check bigint")
    got = {r.doc_id: r.component_id for r in simhash.classify(rows, 4, 14).collect()}
    assert got == {0: 0, 2: 0, 1: 1, 3: 1, 4: 1, 5: 0}
    assert sorted((tuple(r.a), tuple(r.b)) for r in simhash.link_pairs(rows.where("doc_id < 3"), 4, 14).collect()) == [((5, 0), (5, 3))]


@pytest.mark.parametrize("bits", [None, 14])
def test_keys_are_not_broadcast(spark, bits):
    """A small table becomes 64 times as many keys, which do not go through the driver."""
    rng = random.Random(8)
    fps = [rng.getrandbits(62) for _ in range(300)]
    given = [(i, fp ^ (i % 2), 0, i % 7) for i, fp in enumerate(fps + fps)]
    rows = simhash.materialise(spark.createDataFrame(given, "doc_id bigint, fp bigint, check bigint, star bigint"), "test-keys")
    for found in (simhash.link_pairs(rows, 4, bits), simhash.link_pairs(rows, 4, bits, apart="star"), simhash.star_links(rows, 4, bits)):
        assert "Join" in (plan := found._jdf.queryExecution().executedPlan().toString())
        assert "Broadcast" not in plan
