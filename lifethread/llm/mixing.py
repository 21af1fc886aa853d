"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame functions only.

Documents fall into blocks by a hash of their id. A source is taken in whole passes and one partial pass: the partial pass draws blocks in permuted
order until the target is met, the last block document by document, the last document cut at the word. How many blocks of each source an output
shard gets is drawn by halving the list of shards again and again: a node's left half draws its share of the node's blocks without replacement, so
the counts of all shards together are exactly the quotas. The blocks of a source, in another permuted order, are dealt to the shards by these
counts; inside a shard documents are ordered by a hash. All draws come from hashes of ``seed``, so reruns agree.

What is held in one row is one number per source, or per source and shard; a source's window runs over its blocks, never over its documents.

Defined results: null texts have size 0; a null source is a source and stands last; null ids share a block; rows that repeat an id are rows of
their own; a source without words has target 0; an empty table gives an empty result; extra columns are passed through by ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifethread.llm.arrays import BLANKS, free_names
from lifethread.runtime import materialize

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) * F.lit(2.0**-53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked ones among ``drawn`` of ``total`` of which ``marked`` are marked, by inversion at ``u``.

    The sum runs over 12 standard deviations on both sides of the mode, beyond which nothing is left in double precision.
    """
    n, g, d = (c.cast("double") for c in (total, marked, drawn))
    spread = F.ceil(12 * F.sqrt(d * g * (n - g) * (n - d) / (F.greatest(n, F.lit(1.0)) ** 2 * F.greatest(n - 1, F.lit(1.0))))) + 2
    mode = F.floor((d + 1) * (g + 1) / (n + 2))
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), mode - spread).cast("long")
    high = F.least(drawn, marked, mode + spread).cast("long")

    def pick(b: Column) -> Column:
        def grow(acc: Column, k: Column) -> Column:
            x = k.cast("double")
            return F.struct((acc.w * (g - x) * (d - x) / ((x + 1) * (n - g - d + x + 1))).alias("w"), (acc.sum + acc.w).alias("sum"))

        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        steps = F.sequence(b.low, b.high)
        whole = F.aggregate(steps, start, grow, lambda acc: acc["sum"])

        def seek(target: Column) -> Column:
            def step(acc: Column, k: Column) -> Column:
                x = k.cast("double")
                return F.struct(
                    (acc.w * (g - x) * (d - x) / ((x + 1) * (n - g - d + x + 1))).alias("w"), (acc.sum + acc.w).alias("sum"),
                    (acc.below + F.when(acc.sum + acc.w <= target, 1).otherwise(0)).cast("long").alias("below"))

            first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
            return F.least(b.high, b.low + F.aggregate(steps, first, step, lambda acc: acc["below"]))

        return _let(whole * u, seek)

    return F.when(low >= high, low).otherwise(_let(F.struct(low.alias("low"), high.alias("high")), pick))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, quotas) from the one row (quotas array of blocks by source): the splitting tree, ``shards`` a power of two."""
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "quotas")
    for _ in range(shards.bit_length() - 1):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)

        def draw(acc: Column, q: Column) -> Column:
            u = uniform(F.lit(seed), F.col("node"), F.size(acc.out))
            return _let(hypergeometric(acc.total, q, acc.drawn, u), lambda x: F.struct(
                (acc.total - q).alias("total"), (acc.drawn - x).alias("drawn"), F.concat(acc.out, F.array(x)).alias("out")))

        start = F.struct(total.alias("total"), F.floor((total + (F.col("node") % 2)) / 2).cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("out"))
        left = F.aggregate("quotas", start, draw, lambda acc: acc["out"])
        nodes = nodes.withColumn("left", left).select("node", "quotas", "left")
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))).alias("x")).select("x.node", "x.quotas")
    return nodes.select((F.col("node") - shards).alias("shard"), "quotas")


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """(source, source_size, at, target) from (source, source_size): weights by code point order with null last; no target is above ``most`` sizes."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    whole, before = Window.partitionBy(), by_cap.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.select("*", weight.alias("weight"), cap.alias("cap")).select(
        "*", (F.sum("source_size").over(whole) * share).alias("goal"), F.sum("weight").over(whole).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    full = (F.col("goal") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * (F.col("weights") - F.col("weight_before"))
    marked = sums.withColumn("full", full)
    level = F.try_divide(F.col("goal") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole),
                         F.col("weights") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(whole))
    return marked.select("source", "source_size", "at", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0, shards: int = 16, block_words: int = 1 << 16, seed: int = 17) -> DataFrame:
    """Each row of ``docs`` as doc_id, source, size, source_size, target, passes, rest, taken, shards.

    ``passes`` times the whole document, ``rest`` words of it (from its start) once more; ``shards`` has the output shard of each of these copies.
    """
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    words = rows.agg(F.sum("size")).first()[0] or 0
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(max(1, -(-words // block_words))))
    rows = rows.withColumn("block", key)
    blocks = materialize(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), share, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("passes", passes).withColumn("wanted", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    targets = materialize(targets.withColumnRenamed("source", "of"), "mix-targets")
    drawn = blocks.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(order), F.lit(0))
    room = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("wanted") - F.col("before")))
    drawn = drawn.withColumn("before", before).withColumn("room", room)
    drawn = drawn.withColumn("copies", F.col("passes") + F.when(F.col("room") > 0, 1).otherwise(0))
    quotas = drawn.groupBy("at").agg(F.sum("copies").alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x.n).alias("quotas"))
    tree = split_quotas(quotas, shards, seed + 2)
    ends = tree.select("shard", F.posexplode("quotas").alias("at", "n")).groupBy("at").agg(
        F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("each"))
    sums = F.aggregate("each", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x.n)))
    ends = materialize(ends.select(F.col("at").alias("end_at"), sums.alias("ends")), "mix-ends")
    deal = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 3), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    dealt = drawn.join(ends, F.col("at") == F.col("end_at")).withColumn("first", F.coalesce(F.sum("copies").over(deal), F.lit(0)))
    shard = lambda i: F.size(F.filter("ends", lambda e: e <= F.col("first") + i))
    dealt = dealt.withColumn("shards", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), shard)).otherwise(F.array().cast("array<int>")))
    dealt = materialize(dealt.select(F.col("source").alias("of"), F.col("block").alias("of_block"), "words", "source_size", "target", "passes", "room", "shards"), "mix-dealt")
    both = rows.join(dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    cut = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 4), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = both.filter(cut).withColumn("rest", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("room") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    whole = both.filter(~cut).withColumn("rest", F.when(F.col("room") > 0, F.col("size")).otherwise(0).cast("long"))
    return whole.unionByName(part).select(
        "doc_id", "source", "size", "source_size", "target", "passes", "rest", (F.col("size") * F.col("passes") + F.col("rest")).alias("taken"),
        F.slice("shards", 1, (F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int")).alias("shards"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` once per copy, with ``mix_copy``, ``mix_words`` (words of the text that the copy uses, from its
    start), ``mix_shard`` and ``mix_order`` (its place inside the shard, ascending). Columns of these names that ``docs`` has are replaced."""
    docs = docs.drop("mix_copy", "mix_words", "mix_shard", "mix_order")
    of_id, of_source, of_size, held, many, at = free_names(docs, "of_id", "of_source", "of_size", "held", "many", "at")
    drawn = mix(docs, seed=seed, **options).select(
        F.col("doc_id").alias(of_id), F.col("source").alias(of_source), F.col("size").alias(of_size), "passes", "rest", "shards").filter(F.size("shards") > 0)
    drawn = drawn.groupBy(of_id, of_source, of_size).agg(F.flatten(F.collect_list(F.transform("shards", lambda s, i: F.struct(
        s.alias("shard"), F.when(i < F.col("passes"), F.col(of_size)).otherwise(F.col("rest")).alias("words"))))).alias(held), F.count("*").alias(many))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & F.col("source").eqNullSafe(F.col(of_source)) & (word_count(F.col("text")) == F.col(of_size))
    number = Window.partitionBy(of_id, of_source, of_size).orderBy(F.lit(0))
    rows = docs.join(drawn, same)
    repeated = rows.filter(F.col(many) > 1).withColumn(held, F.filter(held, lambda c, i: i % F.col(many) == F.row_number().over(number) - 1))
    columns = [f"`{c}`" for c in docs.columns]
    copies = rows.filter(F.col(many) == 1).unionByName(repeated).select(*columns, F.posexplode(held).alias("mix_copy", at))
    return copies.select(*columns, "mix_copy", F.col(f"{at}.words").alias("mix_words"), F.col(f"{at}.shard").alias("mix_shard"),
                         F.xxhash64(F.lit(seed + 5), "doc_id", "mix_copy").alias("mix_order"))
