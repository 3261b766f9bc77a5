"""Best-fit packing of token sequences by large-item matching on the length histogram."""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playerday.llm.common import materialise, table

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
# The tokenizer's special tokens, found in a text as it stands, before it is lower-cased.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"  # ASCII and Latin-1 letters, which the tokenizer keeps as one run
#: A word of letters.
_PLAIN = re.compile(_LETTERS + b"+")
#: One with a tail of ASCII symbols, which never joins the letter or digit before it into one token.
_TAILED = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-/:-@\[-`{-~]+)", re.S)


class WordEncoder:
    """Ids of whole texts by a public tokenizer, with a bounded cache of words.

    The tokenizer drops white space, lower-cases and never joins across white
    space, so a text's ids are its words' ids in turn. A word of letters that
    is new to the cache goes to the tokenizer's model, since normalising and
    parting leave it as it is; any other new word goes through the whole
    tokenizer. The cache is emptied when full. A text that holds a special
    token goes through the tokenizer as a whole.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.load, self.whole, self.words = lambda: Tokenizer.from_file(path), None, Tokenizer.from_file(path)
        self.words.encode_special_tokens = True  # a lower-cased word that looks like one is ordinary text
        self.model, self.most_words, self.cache = self.words.model, most_words, {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = [chr(n) for n in range(128)] + [""] * 128  # the model's character for each byte
        for c in map(chr, range(0xC0, 0x100)):
            for byte, spelt in zip(c.encode(), level.pre_tokenize_str(c)[0][0]):
                self.spelt[byte] = spelt

    def _model_ids(self, word: bytes) -> bytes:
        """Ids of a word of letters."""
        word = word.decode() if word.isascii() else "".join([self.spelt[n] for n in word.decode().lower().encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def _learn(self, new: set[bytes]) -> None:
        """Put words into the cache."""
        cache, others, tailed = self.cache, set(), []
        plain, parted = _PLAIN.fullmatch, _TAILED.fullmatch
        for w in new:
            if plain(w):
                cache[w] = self._model_ids(w)
            elif m := parted(w):
                tailed.append((w, *m.groups()))
            else:
                others.add(w)
        for part in {x for t in tailed for x in t[1:]}.difference(cache):
            if plain(part):
                cache[part] = self._model_ids(part)
            else:
                others.add(part)
        rest = list(others)
        for at in range(0, len(rest), 4096):
            block = rest[at : at + 4096]
            found = self.words.encode_batch_fast([w.decode() for w in block], add_special_tokens=False)
            cache.update((w, struct.pack(f"<{len(i)}I", *i)) for w, i in zip(block, (e.ids for e in found)))
        cache.update((w, cache[stem] + cache[tail]) for w, stem, tail in tailed)

    def _whole(self, text: str) -> bytes:
        self.whole = self.whole or self.load()  # few texts need it
        found = self.whole.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def _of_words(self, texts: list[str]) -> list[bytes]:
        lists = [x.encode("utf-8", "replace").lower().split() for x in texts]
        new = set().union(*lists).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > self.most_words:
                self.cache.clear()
                new = set().union(*lists)
            self._learn(new)
        known = self.cache.__getitem__
        return [b"".join(map(known, words)) for words in lists]

    def all_ids(self, texts: Iterable[str | None], block: int = 1 << 20) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; new words are looked up together for about `block` characters of text."""
        waiting, held = [], 0
        for text in texts:
            text = text or ""
            if "<|" in text and any(s in text for s in SPECIAL):
                yield from self._of_words(waiting)
                yield self._whole(text)
                waiting, held = [], 0
                continue
            waiting.append(text)
            held += len(text)
            if held >= block:
                yield from self._of_words(waiting)
                waiting, held = [], 0
        yield from self._of_words(waiting)

    def ids(self, text: str | None) -> bytes:
        return next(self.all_ids([text]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(ids: bytes, capacity: int) -> list[dict]:
    """The pieces of one document: ids, then the end id 1, cut every `capacity` tokens."""
    ids += (1).to_bytes(4, "little")
    step = 4 * capacity
    return [{"piece": n, "start": n * capacity, "length": len(block := ids[at : at + step]) // 4, "ids_crc32": zlib.crc32(block)} for n, at in enumerate(range(0, len(ids), step))]


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), a row per piece; the ids themselves stay behind."""

    @F.pandas_udf(PIECES)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(ids, capacity) for ids in encoder(tokenizer).all_ids(texts)], dtype="object")

    rows = docs.select(F.col("doc_id").alias("doc_id"), F.explode(split("text")).alias("p"))
    return rows.select("doc_id", "p.*")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, items, first bin, offset): where the items of each length go.

    Works on the histogram, so its size depends on the capacity alone. Items
    above a third of the capacity come first, two to a bin at most: from the
    longest down, each is matched with the longest partner that still fits.
    Shorter items follow, longest first, each into the bin with the smallest
    gap that takes it; a new bin opens only when none does. Runs of bins that
    were filled alike are handled together.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank: dict[int, int] = defaultdict(int)
    placed: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of bins (first, how many)
    sorted_gaps: list[int] = []
    bins = 0

    def put(length: int, items: int, first: int, offset: int) -> None:
        placed.append((length, rank[length], items, first, offset))
        rank[length] += items
        left[length] -= items

    def free(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if not gaps[gap]:
                insort(sorted_gaps, gap)
            gaps[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    alive = list(large)
    while alive:
        n = alive[-1]
        at = bisect_left(alive, capacity - n + 1) - 1
        partner = alive[at] if at >= 0 else None
        if partner is None:
            many = left[n]
            put(n, many, bins, 0)
            free(capacity - n, bins, many)
        else:
            many = left[n] // 2 if partner == n else min(left[n], left[partner])
            if many == 0:  # a single item is left of the length that would pair with itself
                at -= 1
                if at >= 0:
                    partner, many = alive[at], 1
                else:
                    partner, many = None, 1
            put(n, many, bins, 0)
            if partner is None:
                free(capacity - n, bins, many)
            else:
                put(partner, many, bins, n)
                free(capacity - n - partner, bins, many)
        bins += many
        alive = [x for x in alive if left[x] > 0] if (left[n] == 0 or (partner and left[partner] == 0)) else alive
    for n in sorted((n for n in left if 3 * n <= capacity and left[n] > 0), reverse=True):
        while left[n] > 0:
            at = bisect_left(sorted_gaps, n)
            if at == len(sorted_gaps):
                per = capacity // n
                many = max(1, left[n] // per)
                each = min(per, left[n])
                for k in range(each):
                    put(n, many, bins, k * n)
                free(capacity - each * n, bins, many)
                bins += many
                continue
            gap = sorted_gaps[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                sorted_gaps.pop(at)
            # fill each bin of the run with as many of this length as best fit would go on to put there
            take = min(many, left[n])
            each = max(1, min(gap // n, left[n] // many)) if take == many else 1
            for k in range(each):
                put(n, take, first, capacity - gap + k * n)
            free(gap - each * n, first, take)
            free(gap, first + take, many - take)
    return placed


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, salts: int = 256) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs(doc_id, text).

    Only the histogram of lengths (at most `capacity` rows) comes to the driver
    and only the plan made of it (bounded by the capacity too) is broadcast;
    pieces of one length are ranked in salted parts, so that a length that a
    third of all pieces share does not meet in one task.

    A null or empty text is the end id alone. Null and repeated ids and whole
    repeated rows are fine: every row is packed. A very long text is encoded
    whole and cut, in one task. Other columns of docs are left out, whatever
    their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = pieces_of(docs, capacity, tokenizer)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    pieces = materialise(pieces.withColumn("salt", salt), "pack-pieces")
    parts = pieces.groupBy("length", "salt").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("length", "salt", start.alias("ranks_before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(parts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ranks_before"))

    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    plan = plan_bins(counts, capacity)
    plan = spark.createDataFrame(plan, "plan_length bigint, first_rank bigint, items bigint, first_bin bigint, offset bigint")
    here = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("items"))
    packed = ranked.join(F.broadcast(plan), here)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_bin") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def sequences(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. docs needs unique, non-null ids."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    where = materialise(pack(docs, capacity, path), "pack-places")

    @F.pandas_udf("array<array<int>>")
    def ids_of(texts: pd.Series) -> pd.Series:
        out = []
        for found in encoder(path).all_ids(texts):
            ids = list(memoryview(found + (1).to_bytes(4, "little")).cast("I"))
            out.append([ids[at : at + capacity] for at in range(0, len(ids), capacity)])
        return pd.Series(out, dtype="object")

    ids = docs.select("doc_id", F.posexplode(ids_of("text")).alias("piece", "ids"))
    placed = ids.join(where.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    run = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` tokens a sequence
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(run, lambda x: x["ids"])).alias("ids"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return pack(table(spark, sf_dir, "documents"))
