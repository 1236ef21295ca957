"""Spelling variants: words within one edit, joined by two disjoint chunks of one word and the positional grams of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Code points of a word and occurrences of it, at least; how often a form occurs for each occurrence of its variant, at least.
LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 7, 2, 10
#: Words on either side of one key from which on the key is split by the halves of what it leaves undecided.
HOT_KEY = 256
#: Doublings of the way from a word to its root. A form occurs ten times as often as its variant, so 64-bit counts allow 18 steps.
DOUBLINGS = 5
_RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def noisy_words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): occurrences of all words of at least ``least`` code points, over whole texts.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased. Where ``every`` divides the crc32 of ``<key>:<word>``, the
    word lacks its code point crc32 % length in that row, so that the table carries known misspellings. A null key counts as the text ``null``,
    a null text has no words. Shorter runs never matter and are not read out; counts are summed in each task before the shuffle.
    """
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    words = docs.select(name.alias("key"), F.explode(runs).alias("run")).select("key", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    lacking = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = words.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, lacking).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _piece(start: Column, length: Column) -> Column:
    return F.substring("word", (start + 1).cast("int"), length.cast("int"))


def _split(rows: DataFrame) -> DataFrame:
    """Every row's undecided part, ``len`` code points from ``start`` on, as two chunks: one row for each of them, which adds the chunk to the key and
    leaves the other chunk undecided. An edit in the second chunk leaves the first in its place; one in the first shifts the second by ``shift``."""
    half = F.floor(F.col("len") / 2).cast("int")
    start, length = F.col("start"), F.col("len")
    first = F.struct(F.xxhash64("key", F.lit(0), _piece(start, half)).alias("key"), (start + half).alias("start"), (length - half).alias("len"))
    second = F.struct(F.xxhash64("key", F.lit(1), _piece(start + half + F.col("shift"), length - half)).alias("key"), start.alias("start"), half.alias("len"))
    rows = rows.select("word", "n", "shift", F.explode(F.array(first, second)).alias("c"))
    return rows.select("c.key", "word", "n", "shift", "c.start", "c.len")


def _whole(words: DataFrame, shift: int) -> DataFrame:
    """Words against words that are ``shift`` shorter: the shorter length is the first part of the key, all of the word is undecided."""
    size = F.length("word") - shift
    return words.select(F.xxhash64(size).alias("key"), "word", "n", F.lit(shift).alias("shift"), F.lit(0).alias("start"), size.alias("len"))


def near_words(words: DataFrame, hot: int = HOT_KEY) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of distinct words, each once, that differ by exactly one inserted, deleted or replaced code point.

    The shorter word of a pair (or the smaller) contributes its two halves, which are disjoint; the other contributes, of its positional
    grams, those that such a half can equal: at the same place where the half lies before the edit, shifted by the difference of the lengths, none
    or one, where it lies behind. One edit leaves one half alone, so near words share a key. Keys that more than ``hot`` x ``hot`` pairs would share are split
    again by the halves of what they leave undecided, of which one edit leaves one alone too. A part of one code point cannot be split; words that agree in all
    others are no more than there are letters. So candidates grow with the words and no group is dropped. Pairs are verified by their distance.
    """
    chunks = _split(_whole(words, 0))
    grams = chunks.unionByName(_split(_whole(words, 1)))
    found = None
    while True:
        chunks, grams = settle(chunks, "chunks"), settle(grams, "grams")
        sizes = chunks.select("key", F.lit(1).alias("x"), F.lit(0).alias("y"), F.col("len").alias("l"))
        sizes = sizes.unionByName(grams.select("key", F.lit(0).alias("x"), F.lit(1).alias("y"), F.col("len").alias("l")))
        sizes = sizes.groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("l").alias("l"))
        crowded = settle(sizes.where((F.col("x") * F.col("y") > hot * hot) & (F.col("l") > 1)).select(F.col("key").alias("of")), "crowded")
        is_hot = F.col("key") == F.col("of")
        one = chunks.join(crowded, is_hot, "left_anti").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        two = grams.join(crowded, is_hot, "left_anti").select(F.col("key").alias("at"), F.col("word").alias("b"), F.col("n").alias("b_n"), "shift")
        pairs = one.join(two, (F.col("key") == F.col("at")) & ((F.col("shift") == 1) | (F.col("a") < F.col("b"))))
        pairs = settle(pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n"), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        if crowded.isEmpty():
            return found.distinct()
        chunks, grams = (_split(side.join(crowded, is_hot, "left_semi")) for side in (chunks, grams))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to. Each round doubles the steps taken."""
    hops = settle(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(DOUBLINGS):
        onward = hops.select(F.col("word").alias("of"), F.col("root").alias("onward"))
        hops = settle(hops.join(onward, F.col("root") == F.col("of"), "left").select("word", F.coalesce("onward", "root").alias("root"), "onward"), "roots")
        if hops.where("onward is not null").isEmpty():
            break
        hops = hops.drop("onward")
    return hops.select("word", "root")


def group_spellings(words: DataFrame, dominance: int = DOMINANCE, hot: int = HOT_KEY) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n; each word once).

    ``n_near`` counts the words within one edit. ``form`` is the most frequent of them (ties: the smallest in code-point order) where it occurs at least
    ``dominance`` times as often, else null; ``root`` is where forms lead in the end, the word itself without a form. Null words have no part. An
    empty table gives an empty result. Other columns are not looked at.
    """
    words = settle(words.where("word is not null").select("word", F.col("n").cast("bigint").alias("n")), "words")
    near = near_words(words, hot)
    both = near.select(F.col("a").alias("of"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(near.select(F.col("b").alias("of"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("of").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = words.join(best, F.col("word") == F.col("of"), "left")
    wins = -F.col("best.less") >= dominance * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wins, F.col("best.other")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n"))
    joined = settle(joined, "forms-of-words")
    ends = roots(joined.where("form is not null")).select(F.col("word").alias("of"), F.col("root").alias("end"))
    return joined.join(ends, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("end", "word").alias("root"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, dominance: int = DOMINANCE) -> DataFrame:
    """``group_spellings`` of the words of ``docs`` that occur at least ``count`` times."""
    return group_spellings(noisy_words(docs, key, text, every, least).where(F.col("n") >= count), dominance)


def unify_spellings(docs: DataFrame, variants: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``unified``: its words (runs of letters, A-Z lower-cased) as an array, variants replaced by their root.

    Words of a row are exploded, joined with the variants that have a form, and gathered again by row; null texts have null words. The rows are kept apart by
    a number of their own, so repeated rows stay.
    """
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    words = rows.select("__row", F.posexplode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(_RUN), F.lit(0))).alias("at", "run"))
    forms = variants.where("form is not null").select(F.col("word").alias("of"), "root")
    words = words.select("__row", "at", lower_ascii(F.col("run")).alias("run")).join(forms, F.col("run") == F.col("of"), "left")
    words = words.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("root", "run").alias("w")))).alias("w"))
    words = words.select(F.col("__row").alias("of"), F.col("w.w").alias("unified"))
    none = F.when(F.col(f"`{text}`").isNotNull(), F.array().cast("array<string>"))
    out = rows.join(words, F.col("__row") == F.col("of"), "left").withColumn("unified", F.coalesce("unified", none))
    return out.drop("__row", "of")
