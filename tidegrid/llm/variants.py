"""Spelling variants: words one edit apart, found by anagram hashing, grouped under their most frequent form.

A word's key is the sum of its letters' fifth powers, so it doesn't depend on their order, and one letter more, less or other
changes it by a value that the letters know: taking a letter's power away from either of two such words gives the same sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, drop_written, written

#: Runs that words come from; a word's least length and number of places.
RUN, LEAST_LENGTH, LEAST_COUNT = r"[A-Za-zÀ-ÿ]+", 5, 3
#: Fifth powers are added modulo a Mersenne prime: no sum overflows, however long a word is.
MODULUS = (1 << 61) - 1
#: Letters that a segment has, as long as a word has no more segments than these. See _keys().
SEGMENT, SEGMENTS = 3, 16


def occurrences(docs: DataFrame, *, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a run of letters of a text: word, A-Z lower-cased. Where `every` divides the CRC-32 of `<id>:<run>`, one letter of it is
    missing, as a made-up misspelling (0: never). A null id is written as nothing."""
    run = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    low = run.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run")).alias("run"))
    if not every:
        return low.select(F.col("run").alias("word"))
    hashed = low.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of words of so many letters and places at least."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long") % 5000  # so fifth powers fit; letters that share a value make candidates, not links
    return code * code * code * code * code % MODULUS


def _keys(words: DataFrame) -> DataFrame:
    """key, word: words one edit apart share a key.

    A word of L letters has ceil(L / 3) segments of equal length, 16 at most. For each letter of a segment there is a key of: L, the
    segment, the letters outside it, in order, and the word's sum less that letter's power. Two words that differ by a replaced
    letter share the key of its segment. For each segment of words of L + 1 letters there is another, of the word's whole sum: that of
    a word which has one letter more there. So what shares a key agrees outside a few letters, and a key has a bounded number
    of words, unless words are longer than 48 letters; rows of a word grow with its length up to 16 times the alphabet.
    """
    length = F.char_length("word")
    letters = F.transform(F.split("word", ""), lambda c: F.struct(c.alias("c"), _power(c).alias("v")))
    total = F.aggregate("letters", F.lit(0).cast("long"), lambda s, x: (s + x["v"]) % MODULUS)
    summed = words.select("word", length.alias("length"), letters.alias("letters")).withColumn("total", total)
    count = lambda n: F.least(F.ceil(n / SEGMENT), F.lit(SEGMENTS)).cast("int")
    begin = lambda k, n: F.floor(k * n / count(n)).cast("int")
    segment = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1)).alias("k")
    outside = lambda first, last: F.concat(F.substring("word", F.lit(1), first), F.lit("|"), F.substring("word", last + 1, F.col("length")))
    key = lambda rest, n, a, b: F.xxhash64(rest, n, F.col("k"), outside(a, b)).alias("key")
    n = F.col("length")
    own = summed.select("word", "length", "total", "letters", segment(n)).withColumns({"a": begin(F.col("k"), n), "b": begin(F.col("k") + 1, n)})
    less = own.withColumn("v", F.explode(F.array_distinct(F.transform(F.slice("letters", F.col("a") + 1, F.col("b") - F.col("a")), lambda x: x["v"]))))
    less = less.select(key(F.pmod(F.col("total") - F.col("v"), F.lit(MODULUS)), n, F.col("a"), F.col("b")), "word")
    more = summed.select("word", "length", "total", segment(n + 1)).withColumns({"a": begin(F.col("k"), n + 1), "b": begin(F.col("k") + 1, n + 1) - 1})
    return less.unionByName(more.select(key(F.col("total"), n + 1, F.col("a"), F.col("b")), "word"))


def near_words(words: DataFrame) -> DataFrame:
    """a, b (a < b): each two words that differ by exactly one inserted, deleted or replaced code point, once.

    Candidates share a key; then the order of their letters is compared. words: distinct, without nulls.
    """
    keys = _keys(words)
    pairs = keys.select("key", F.col("word").alias("a")).join(keys.select("key", F.col("word").alias("b")), "key")
    return pairs.where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def group_variants(words: DataFrame, *, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n).

    A word's form is its near word of largest n, of the smallest in code-point order if several have it, where that n is `ratio`
    times its own at least, else null. Its root is where forms lead to. As n at least doubles from a word to its form there are no
    cycles, and paths are halved each turn: a handful of turns, each a join whose hot roots are split as skew.
    """
    words = written(words.select("word", "n"), "words")
    pairs = written(near_words(words), "near")
    sided = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    known = sided.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to")
    )
    judged = written(judged.select("word", "to.form", "n", "n_near", "to.form_n"), "judged")
    drop_written(pairs)
    roots = written(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = written(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        drop_written(roots)
        moved, roots = longer.where("moved").limit(1).count(), longer.drop("moved")
        roots._tidegrid_path = longer._tidegrid_path
        if not moved:
            break
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **kwargs) -> DataFrame:
    """The variants of all words of whole texts: see occurrences(), count_words() and group_variants().

    Null and empty texts have no words; null ids are written as nothing. Repeated rows count each time. An empty table gives no
    rows. Other columns are ignored. Words are counted in each task before they are shuffled: a frequent one is no hot key.
    """
    return group_variants(count_words(occurrences(docs, **kwargs)))
