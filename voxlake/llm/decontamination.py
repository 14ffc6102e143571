"""Benchmark decontamination on SimHash windows, in DataFrame functions only.

A document's words are cut into five-word shingles. A document and an item are compared if either of two ways finds them:

* SimHash: for every shingle that a benchmark item also has, the window of the item's size that lines both up gets a
  64-bit SimHash of its shingles, in which a shingle votes with its weight (1 / number of items that hold it). Items are
  indexed by BLOCKS blocks of their fingerprint with every value within BLOCK_RADIUS bits: two fingerprints within
  RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1 bits agree within BLOCK_RADIUS in some block, so the index returns all items
  within the radius.
* The exact overlap bound, whatever the fingerprints say: the shingles that the whole document shares with the item must
  weigh `similar` times the item. Only an item's witnesses look for documents: its shingles without the most common ones
  that weigh less than that together, since sharing only these cannot do. So no pair is lost to the radius or to windows
  that line nothing up.

For every pair found, the weighted Jaccard similarity of the shingle multisets is taken over all windows of the item's
size: it changes only where a shared shingle enters or leaves the window, so running sums over these places give it
everywhere. A shingle of the item weighs 1 / (number of items that hold it), any other 1. A document shorter than the
item is one window.

The index of items is broadcast in blocks of at most ITEM_ROWS shingles; a larger benchmark takes more passes over the
documents. Words are runs of letters and digits, lower-cased.

Defined results: null, empty and short texts and rows without doc_id match nothing; whole texts are read, however long; items
of fewer than five words name nothing and match nothing; rows that repeat an item_id are texts of one item, rows that repeat
a doc_id texts of one document; one row for each document and item (best window, then least start); empty tables give no
rows; other columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import docs_of, staged

SHINGLE, SIMILAR = 5, 0.75
#: 137 of 65,536 values of a block are within its radius: 0.8 % of unrelated items pass the index.
BLOCKS, BLOCK_RADIUS = 4, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_BITS = [16, 16, 16, 16]
#: What sums of weights may lose to rounding, as a share of an item.
SLACK = 1e-6
#: Shingles of items that are broadcast at once: about 40 MB.
ITEM_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: str) -> Column:
    """64-bit hashes of the shingles of an array column, in order; none for fewer words than a shingle has."""
    at = lambda i, j: F.get(F.col(words), i + j)
    every = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(at(i, j) for j in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, every).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """Bit b is set if shingles (s, w) that have it weigh more than those that do not."""
    bit = lambda x, b: F.call_function("shiftright", x, b).bitwiseAND(F.lit(1).cast("long"))
    votes = lambda b: F.aggregate(shingles, F.lit(0.0), lambda acc, x: acc + x["w"] * (2 * bit(x["s"], b) - 1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(votes(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def block_values(fingerprint: Column) -> list[Column]:
    out, low = [], 0
    for bits in BLOCK_BITS:
        out.append(F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        low += bits
    return out


def _probes(bits: int) -> list[int]:
    """Masks of at most BLOCK_RADIUS bits."""
    return [sum(1 << b for b in chosen) for k in range(BLOCK_RADIUS + 1) for chosen in combinations(range(bits), k)]


def contamination(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words) of every document and benchmark item with a similar window.

    docs: (doc_id, text); items: (item_id, text).
    """
    docs = docs_of(docs).where(F.col("doc_id").isNotNull()).withColumn("row", F.xxhash64("doc_id", "text"))
    shingled = docs.select("row", "doc_id", words_of(F.col("text")).alias("w")).select("row", "doc_id", shingles_of("w").alias("h"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.dropDuplicates(["item_id", "text"]).withColumn("key", F.xxhash64("item_id", "text"))
    names = staged(items.select("item_id", "key"))
    items = items.withColumn("w", words_of(F.col("text"))).select(F.col("key").alias("item_id"), shingles_of("w").alias("h")).where(F.size("h") > 0)
    items = staged(items.withColumn("m", F.size("h")))

    # what each item weighs: (shingle, times, weight), its mass, and whether the shingle is a witness
    held = items.select("item_id", "m", F.posexplode("h").alias("off", "s"))
    held_by = held.groupBy("s").agg((1 / F.count_distinct("item_id")).alias("w"))
    item = Window.partitionBy("item_id")
    common_first = item.orderBy("w", "s").rowsBetween(Window.unboundedPreceding, 0)
    weighed = held.groupBy("item_id", "m", "s").agg(F.count("*").alias("tf")).join(held_by, "s").withColumn("mass", F.sum(F.col("w") * F.col("tf")).over(item))
    weighed = staged(weighed.withColumn("witness", F.sum(F.col("w") * F.col("tf")).over(common_first) >= (similar - SLACK) * F.col("mass")))
    voted = held.join(held_by, "s").groupBy("item_id", "m").agg(F.sort_array(F.collect_list(F.struct("off", "s", "w"))).alias("h"))
    prints = staged(voted.select("item_id", "m", simhash(F.col("h")).alias("print")))
    lookup = held.select("s", "off", "m").distinct()  # items of one size share windows
    passes = max(1, -(-held.count() // ITEM_ROWS))

    def block(side: DataFrame, k: int) -> DataFrame:
        return side.where(F.pmod(F.xxhash64("s"), F.lit(passes)) == k) if passes > 1 else side

    def meet(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
        """rows with what side, of at most as many rows as the items have shingles, says of them."""
        return reduce(DataFrame.unionAll, [block(rows, k).join(F.broadcast(block(side, k)), on) for k in range(passes)])

    # where documents hold shingles of items
    # (outer explodes: the optimizer would repeat the shingles in a filter for the others, once for each word)
    every = shingled.select("row", "doc_id", F.size("h").alias("n"), F.posexplode_outer("h").alias("pos", "s"))
    hits = staged(meet(every, held_by, ["s"]).groupBy("row", "doc_id", "n", "s", "w").agg(F.sort_array(F.collect_set("pos")).alias("at")))

    # aligned windows
    starts = meet(hits, lookup, ["s"]).select("row", "n", "m", "off", F.explode("at").alias("pos"))
    starts = starts.select("row", "m", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("off"), F.col("n") - F.col("m"))).alias("start"))
    starts = staged(starts.groupBy("row").agg(F.collect_set(F.struct("m", "start")).alias("starts")))
    weights = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("s", "w"))).alias("weights"))
    texts = docs.join(starts.join(weights, "row"), "row").select("row", "starts", "weights", words_of(F.col("text")).alias("w")).select("row", "starts", "weights", shingles_of("w").alias("h"))
    weigh = F.transform("h", lambda x: F.struct(x.alias("s"), F.coalesce(F.col("weights")[x], F.lit(1.0)).alias("w")))
    texts = texts.select("row", "starts", weigh.alias("h"))
    windows = texts.select("row", "h", F.explode_outer("starts").alias("x")).select("row", "x.m", F.slice("h", F.col("x.start") + 1, F.col("x.m")).alias("win"))
    windows = staged(windows.select("row", "m", simhash(F.col("win")).alias("print")).distinct())

    # items within the radius
    def probed(number: int, bits: int, value: Column) -> DataFrame:
        every = F.transform(F.array(*map(F.lit, _probes(bits))), lambda mask: value.bitwiseXOR(mask.cast("long")))
        return prints.select("item_id", "m", F.lit(number).alias("block"), F.explode(every).alias("value"))

    index = reduce(DataFrame.unionAll, [probed(i, bits, v) for i, (bits, v) in enumerate(zip(BLOCK_BITS, block_values(F.col("print"))))])
    asked = windows.select("row", "m", "print", F.posexplode(F.array(*block_values(F.col("print")))).alias("block", "value"))
    index = index.join(prints.select("item_id", F.col("print").alias("item_print")), "item_id")
    near = asked.join(index, ["m", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = near.select("row", "item_id")

    # pairs that the overlap bound allows
    pairs = meet(hits.select("row", "s"), weighed.where("witness").select("s", "item_id"), ["s"]).select("row", "item_id").distinct()
    both = meet(pairs.join(hits.drop("w"), "row"), weighed, ["item_id", "s"]).groupBy("row", "item_id")
    bound = both.agg(F.sum(F.col("w") * F.least("tf", F.size("at"))).alias("both"), F.first("mass").alias("mass"))
    bound = bound.where(F.col("both") >= (similar - SLACK) * F.col("mass")).select("row", "item_id")
    pairs = staged(near.unionAll(bound).distinct())

    # exact weighted similarity of all windows: an occurrence is inside for the starts lo to hi, and counts for the item up
    # to `top`, from where on the window has as many later ones as the item
    met = meet(pairs.join(hits.drop("w"), "row"), weighed, ["item_id", "s"]).withColumn("size", F.least("n", "m"))
    last = F.col("n") - F.col("size")
    spans = met.select(
        "row", "doc_id", "item_id", "m", "size", "mass", "w", last.alias("last"),
        F.explode(F.transform("at", lambda p, i: F.struct(p.alias("p"), F.get("at", (i + F.col("tf")).cast("int")).alias("next")))).alias("x"),
    )
    lo, hi = F.greatest(F.lit(0), F.col("x.p") - F.col("size") + 1), F.least(F.col("x.p"), F.col("last"))
    spans = spans.withColumn("lo", lo).withColumn("hi", hi).withColumn("top", F.least(hi, F.coalesce(F.col("x.next") - F.col("size"), hi)))
    shares = F.when(F.col("top") >= F.col("lo"), F.col("w")).otherwise(0.0)
    event = lambda at, both, inside, n: F.struct(at.alias("start"), both.alias("both"), inside.alias("inside"), F.lit(n).alias("own"))
    events = F.array(event(F.col("lo"), shares, F.col("w"), 1), event(F.col("top") + 1, -shares, F.lit(0.0), 0), event(F.col("hi") + 1, F.lit(0.0), -F.col("w"), -1))
    events = spans.select("row", "doc_id", "item_id", "m", "size", "mass", "last", F.explode(events).alias("e")).where("e.start between 0 and last")
    events = events.groupBy("row", "doc_id", "item_id", "m", "size", "mass", "last", "e.start").agg(*(F.sum(f"e.{c}").alias(c) for c in ("both", "inside", "own")))
    so_far = Window.partitionBy("row", "item_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    events = events.select("doc_id", "item_id", "m", "size", "mass", "start", *(F.sum(c).over(so_far).alias(c) for c in ("both", "inside", "own")))
    similarity = F.col("both") / (F.col("size") - F.col("own") + F.col("inside") + F.col("mass") - F.col("both"))
    # (rounded, since the order of a sum shows in the last digits)
    scored = events.select("doc_id", "item_id", "start", "m", F.round(similarity, 9).alias("similarity")).where(F.col("similarity") >= similar - 1e-9)
    scored = scored.withColumnRenamed("item_id", "key").join(names, "key")
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "m")).alias("b"))
    return best.select("doc_id", "item_id", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.back")).cast("long").alias("start_word"), (F.col("b.m") + SHINGLE - 1).cast("long").alias("n_words"))
