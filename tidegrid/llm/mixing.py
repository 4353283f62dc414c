"""Mixing sources to target weights: blocks of equal numbers of words, dealt to shards by Sainte-Laguë."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words of a block, and documents that a shard of a source has, about.
BLOCK_WORDS, SHARD_DOCS = 8, 1000
_CUTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with sid: their place from 0 by code points, null last. No task sorts all of them."""
    dealt = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, at = {}, 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        before[r["part"]] = at
        at += r["count"]
    base = dealt.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part int, base long")
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.join(base, "part").withColumn("sid", F.col("base") + place).drop("part", "base")


def fill_targets(sources: DataFrame, most: float) -> DataFrame:
    """Adds target: shares of all sizes by weight; what exceeds most * source_size is shared again among the rest."""
    got = sources.agg(F.sum("source_size").alias("t"), F.sum(F.when(F.col("source_size") > 0, F.col("weight"))).alias("w")).first()
    total, level = got["t"] or 0, 0.0
    new = total / got["w"] if total else 0.0
    while new > level:  # each turn caps at least one more source; few turns do
        level = new
        over = F.col("source_size") * most < F.col("weight") * level
        got = sources.agg(F.sum(F.when(over, F.col("source_size"))).alias("s"), F.sum(F.when(~over & (F.col("source_size") > 0), F.col("weight"))).alias("w")).first()
        if got["w"]:
            new = (total - (got["s"] or 0) * most) / got["w"]
    return sources.withColumn("target", F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(float(level))))


def sainte_lague(cells: DataFrame, seats: int, votes: str = "votes", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds quota: seats dealt by the highest quotients votes/(2k+1).

    A seat's quotient is at least 2/d iff votes/d + 1/2 counts it, so a divisor d is sought for which the
    rounded votes sum to seats, _CUTS candidates in each pass. Equal quotients at the end go by order.
    """
    total = cells.agg(F.sum(votes)).first()[0] or 0.0
    if not total or seats <= 0:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    count = lambda d: F.floor(F.col(votes) / F.lit(float(d)) + 0.5).cast("long")
    low, high = total / seats / 4, total / seats * 4
    exact = None
    for _ in range(14):
        cuts = [low + (high - low) * (k + 1) / (_CUTS + 1) for k in range(_CUTS)]
        sums = list(cells.agg(*[F.sum(count(d)).alias(f"s{k}") for k, d in enumerate(cuts)]).first())
        if seats in sums:
            exact = cuts[sums.index(seats)]
            break
        many = [d for d, s in zip(cuts, sums) if s > seats]
        few = [d for d, s in zip(cuts, sums) if s < seats]
        # Sums fall as divisors rise; an end that nothing lies beyond is moved out.
        low, high = max(many, default=low / 4), min(few, default=high * 4)
        if math.nextafter(low, high) >= high:
            break
    if exact is not None:
        return cells.withColumn("quota", count(exact))
    # Ties: with the divisor just too small, the lowest last quotients lose a seat, one each.
    some = cells.withColumn("quota", count(low))
    over = some.agg(F.sum("quota")).first()[0] - seats
    if over <= 0:
        return some
    lose = some.where("quota > 0").orderBy((F.col(votes) / (2 * F.col("quota") - 1)).asc(), *[F.col(c).desc() for c in order]).limit(over).select(*order, F.lit(1).alias("less"))
    return some.join(lose, list(order), "left").withColumn("quota", F.col("quota") - F.coalesce("less", F.lit(0))).drop("less")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = 11, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, skip, and the columns named in keep (as keep_<name>).

    size counts words. Sources in order of code points, null last (a source like any other), weigh weights,
    repeating. Targets share the sum of all sizes by weight, none above most times its source. Each source is
    dealt by hash to shards; blocks of block_words words go to shards by highest quotients of their share of
    the target. A shard's documents, in an order of the seed, are a ring of words: its quota takes the whole
    ring as often as it can and the rest from a seeded block on. taken is the number of words that the mix
    takes of a document, repeats counted, never above most * size. Of the last, partial taking, skip is where
    it begins (in words), if it doesn't begin at 0.

    Null and empty texts have size 0 and taken 0. Null ids and repeated rows are documents like others.
    An empty table gives no rows; where all sizes are 0, all targets are. Other columns are ignored.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    # Columns that are kept can be whole texts: they are read again for the result instead of written here.
    sizes = written(base.select("doc_id", "source", "size", "key"), "sizes")
    base = base if keep else sizes
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    sources = written(sources, "weights")
    sources = written(fill_targets(sources, most).withColumn("shards", F.ceil(F.col("n_docs") / shard_docs)), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0

    # Not by name: source may be null. Spark broadcasts the sources if they are few, else it splits hot ones.
    right = sources.select(F.col("source").alias("s_source"), "sid", "source_size", "target", "shards")
    dealt = lambda x: x.join(right, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("shard", F.pmod(F.col("key"), F.col("shards"))).drop("s_source", "shards")
    rows = dealt(base)
    cells = dealt(sizes).groupBy("sid", "shard").agg(F.sum("size").alias("n"), F.first("source_size").alias("all"), F.first("target").alias("target"))
    cells = written(cells.select("sid", "shard", "n", F.when(F.col("all") > 0, F.col("target") * F.col("n") / F.col("all")).otherwise(0.0).alias("votes")), "cells")
    cells = sainte_lague(cells, round(total / block_words), order=("sid", "shard"))
    words = F.least(F.col("quota") * block_words, F.col("n") * most)
    blocks = F.greatest(F.ceil(F.col("n") / block_words), F.lit(1))
    cells = cells.select("sid", "shard", "n", words.alias("words"), (F.pmod(F.xxhash64(F.lit(seed), "sid", "shard"), blocks) * block_words).alias("begin"))

    order = W.partitionBy("sid", "shard").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(cells, ["sid", "shard"]).withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    whole = F.when(F.col("n") > 0, F.floor(F.col("words") / F.col("n"))).otherwise(0).cast("long")
    rest = F.col("words") - whole * F.col("n")
    overlap = lambda a, b: F.greatest(F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a), F.lit(0))
    end = F.col("begin") + rest
    first, second = overlap(F.col("begin"), F.least(end, F.col("n"))), overlap(F.lit(0), end - F.col("n"))
    placed = placed.withColumns({"whole": whole, "first": first, "second": second})
    skip = F.when((F.col("first") > 0) & (F.col("second") == 0), F.greatest(F.col("begin") - F.col("at"), F.lit(0))).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source", "source_size", "target", (F.col("whole") * F.col("size") + F.col("first") + F.col("second")).cast("long").alias("taken"), skip.cast("long").alias("skip"), *[f"keep_{c}" for c in keep])


def mixed_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """The documents of the mix, with the columns of docs: whole copies, and what is taken in part cut to those words.

    A part that wraps round the ring within one document is two parts of it; they stand as one text. Words of
    a part are parted by one space. n_chars, if there, counts the characters of a text that was cut.
    """
    got = mix(docs, keep=tuple(docs.columns), **kwargs)
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") - copies * F.col("size")).cast("int")
    got = got.where("taken > 0").withColumns({"copies": copies, "part": part})
    one = got.withColumn("cut", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("copies")), F.when(F.col("part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    text = kwargs.get("text_col", "text")
    words = F.regexp_extract_all(F.col(f"keep_{text}"), F.lit(f"({WORD})"), F.lit(1))
    ring = F.slice(F.concat(words, words), (F.col("skip") + 1).cast("int"), F.col("part"))
    new = F.when(F.col("cut"), F.array_join(ring, " ")).otherwise(F.col(f"keep_{text}"))
    one = one.withColumn("new_text", new)
    changed = {text: F.col("new_text"), "n_chars": F.when(F.col("cut"), F.length("new_text").cast("long")).otherwise(F.col("keep_n_chars")) if "n_chars" in docs.columns else None}
    return one.select(*[(changed[c] if c in changed else F.col(f"keep_{c}")).alias(c) for c in docs.columns])
