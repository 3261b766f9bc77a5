"""Spelling variants: words one inserted, deleted or replaced code point apart, over pairs of trie nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.llm.common import discard, materialise, table

RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"
#: Code points and occurrences that a word has at least, and how many times a word's occurrences its form has at least.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: One run of a document in so many loses a code point.
DAMAGED = 31
#: Nodes down to this depth have their spelling as number, seven bits a letter; deeper ones are numbered in a table.
SHALLOW = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of docs(doc_id, text) after the damage, of LETTERS code points and OCCURRENCES occurrences or more.

    Damage depends on document and run alone. Runs are counted before the
    shuffle, so a frequent word costs a task one row.
    """
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(id_.alias("id"), F.explode(F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    # a shorter run is no word, damaged or not
    runs = runs.where(F.char_length("run") >= LETTERS).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DAMAGED == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= LETTERS) & (F.col("n") >= OCCURRENCES))


def letter(x: Column) -> Column:
    """1 to 90 for a to z and U+00C0 to U+00FF."""
    code = F.ascii(x)
    return F.when(code < 128, code - 96).otherwise(code - 0xC0 + 27).cast("bigint")


def shallow_node(part: Column, depth: Column) -> Column:
    """The number of a node of at most SHALLOW letters: 1, then seven bits a letter; 0 beyond."""
    steps = F.transform(F.sequence(F.lit(1), F.least(depth, F.lit(SHALLOW))), lambda i: letter(F.substr(part, i, F.lit(1))))
    spelt = F.aggregate(F.when(depth > 0, steps).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda s, x: s * 128 + x)
    return F.when(depth <= SHALLOW, spelt).otherwise(0)


def _part(side: Column, i: Column) -> Column:
    """The first (side 0) or last (side 1) i letters of word."""
    return F.when(side == 0, F.substr("word", F.lit(1), i)).otherwise(F.substr("word", F.char_length("word") - i + 1, i))


def deep_nodes(dictionary: DataFrame) -> DataFrame:
    """(id, prefix, suffix): for words of more than SHALLOW letters the numbers, below zero, of their nodes deeper than SHALLOW, by depth.

    The distinct prefixes and suffixes are the nodes of the trie and of the
    trie of the reversed words; they are numbered in a written table.
    """
    size = F.char_length("word")
    each = dictionary.where(size > SHALLOW).select("id", "word", F.explode(F.sequence(F.lit(SHALLOW + 1), size)).alias("depth")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    each = each.select("id", "side", "depth", _part(F.col("side"), F.col("depth")).alias("part"))
    numbers = materialise(each.select("side", "part").distinct().withColumn("node", -F.monotonically_increasing_id() - 1), "spelling-nodes")
    steps = each.join(numbers, ["side", "part"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("side", "depth", "node"))).alias("s"))
    nodes = lambda side: F.transform(F.filter("s", lambda x: x["side"] == side), lambda x: x["node"])
    out = materialise(steps.select("id", nodes(0).alias("prefix"), nodes(1).alias("suffix")), "spelling-deep")
    discard(numbers)
    return out


def pair_groups(dictionary: DataFrame) -> DataFrame:
    """(skipping, inserting): ids of the words of dictionary(id, word) that share a pair of nodes; only pairs that make words near.

    A word has at each place i the pair (node of its first i letters, node of
    what follows letter i + 1), in which that letter is skipped, and the pair
    (node of its first i letters, node of the rest), into which a letter may be
    inserted. Two words with an equal skipping pair differ by a replaced
    letter; a word with a skipping pair equal to another's inserting pair has a
    letter more; nothing else makes two words near. At most as many words share
    a skipping pair as there are letters, and one word has an inserting pair,
    so groups are small by nature.
    """
    deep = deep_nodes(dictionary)
    size = F.char_length("word")
    paths = dictionary.join(deep, "id", "left")
    shallow = lambda side: F.transform(F.sequence(F.lit(0), F.least(size, F.lit(SHALLOW))), lambda i: shallow_node(_part(F.lit(side), i), i))
    none = F.array().cast("array<bigint>")
    paths = paths.select("id", size.alias("size"), F.concat(shallow(0), F.coalesce("prefix", none)).alias("prefix"), F.concat(shallow(1), F.coalesce("suffix", none)).alias("suffix"))
    # place i: the skipping pair and then the inserting pair; the last place has no letter to skip
    rows = paths.select("id", "size", "prefix", "suffix", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("i"))
    rows = rows.select("id", F.get("prefix", F.col("i")).alias("p"), F.explode(F.array(F.struct(F.lit(True).alias("skips"), F.get("suffix", F.col("size") - 1 - F.col("i")).alias("s")), F.struct(F.lit(False).alias("skips"), F.get("suffix", F.col("size") - F.col("i")).alias("s")))).alias("e"))
    rows = rows.select("id", "p", "e.s", "e.skips").where("s IS NOT NULL")
    groups = rows.groupBy("p", "s").agg(F.collect_list(F.when(F.col("skips"), F.col("id"))).alias("skipping"), F.max(F.when(~F.col("skips"), F.col("id"))).alias("inserting"))
    groups = groups.where("size(skipping) > 1 OR size(skipping) = 1 AND inserting IS NOT NULL")
    out = materialise(groups.select(F.array_sort("skipping").alias("skipping"), "inserting"), "spelling-groups")
    discard(deep)
    return out


def near_words(dictionary: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near a word, and the least id among them, for words that have any.

    Within a group of replaced letters a word's best is the group's first or
    second, so no pairs are made; a word with a letter more meets one other,
    once however many places of a run of equal letters tell so.
    """
    groups = pair_groups(dictionary)
    first, second = F.get("skipping", F.lit(0)), F.get("skipping", F.lit(1))
    one = groups.where("size(skipping) > 1").select(F.explode("skipping").alias("id"), (F.size("skipping") - 1).cast("bigint").alias("n_near"), first.alias("first"), second.alias("second"))
    replaced = one.select("id", "n_near", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))
    longer = groups.where("inserting IS NOT NULL").select(F.explode("skipping").alias("a"), F.col("inserting").alias("b")).distinct()
    both = longer.union(longer.select("b", "a")).select(F.col("a").alias("id"), F.lit(1).cast("bigint").alias("n_near"), F.col("b").alias("best"))
    out = materialise(replaced.union(both).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "spelling-near")
    discard(groups)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the end of the chain of forms(id, form) from each id.

    Occurrences grow TIMES-fold at each step, so chains are short; each round
    doubles the steps taken.
    """
    at = materialise(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = materialise(at.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(at)
        at = moved
        if not at.where("moved").limit(1).count():
            return at.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs(doc_id, text).

    A word's form is its near word with most occurrences (ties: least in code
    points), where that has TIMES as many as the word; root follows the forms
    to the last. Null texts have no words; a null doc_id counts as an empty
    one; repeated rows count each; very long texts are read whole; empty tables
    give no rows; other columns of docs are left out, whatever their names.
    """
    counted = materialise(words(docs), "spelling-words")
    # in the order in which forms are preferred, so that the least id is the best
    ordered = counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    dictionary = materialise(ordered, "spelling-dictionary")
    near = near_words(dictionary)
    other = dictionary.select(F.col("id").alias("best"), F.col("n").alias("best_n"), F.col("word").alias("best_word"))
    found = dictionary.join(near.join(other, "best"), "id", "left").withColumn("holds", F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False)))
    found = materialise(found, "spelling-found")
    ends = roots(found.where("holds").select("id", F.col("best").alias("form")))
    named = ends.join(dictionary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    held = lambda c: F.when(F.col("holds"), F.col(c))
    out = found.join(named, "id", "left").select("word", held("best_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), held("best_n").alias("form_n"))
    done = materialise(out, "spelling-done")
    for used in (counted, dictionary, near, found):
        discard(used)
    return done


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their spelling forms."""
    return variants(table(spark, sf_dir, "documents"))
