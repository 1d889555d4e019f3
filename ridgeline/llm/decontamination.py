"""Benchmark decontamination by spaced seeds.

A mask of 1s and 0s laid on consecutive words hashes those under 1s only, so a substituted word under a 0 changes
nothing. Hashes of all benchmark items are joined with those at every position of every document. Each hit fixes an
alignment; equal ones count once, and along each the words of the item are compared with those that the document has
there. The hashes are broadcast, in a few blocks if need be; more than these are joined by a shuffle. The texts of
documents are never shuffled unless very many have hits. SQL functions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, as_row, back, small_or_not, staged, text_or_empty, with_value

MASKS = ["1101011", "1011101"]
#: An item is in a document if of so many aligned consecutive words (all, if it has fewer) this share is equal.
OVERLAP = 25
SIMILARITY = 0.8
#: Masks beside MASKS, and the numbers of words of the items that they are for. With at most a fifth of its words
#: substituted, no item's masks are all broken: tests enumerate this. Up to 4 words none may be, so all are under 1s.
SHORT_MASKS = {"1111": [*range(5, OVERLAP), 30], "11011": [5, 6, 7, 10, 11], "10111": [5], "11101": [5]}
#: From so many words on, all items have the same masks.
LONG = 31
#: Benchmark items in a block, at most; with BROADCAST_ROWS hashes this bounds what is broadcast.
BLOCK_ITEMS = 5_000
#: Reads of the documents, one for each block, at most; hashes of more blocks are shuffled with one read.
MOST_READS = 4


def words(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters and digits, in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def item_masks(n: int) -> list[str]:
    """The masks for items of n words."""
    if n < 5:
        return ["1" * n]
    return (MASKS if n >= OVERLAP or n == 15 else []) + [m for m, of in SHORT_MASKS.items() if n in of]


def seeds(hashes: str, masks: list[str]) -> Column:
    """For each mask a hash at each position, one mask's after the other's."""

    def by(mask: str) -> Column:
        at = [k for k, x in enumerate(mask) if x == "1"]
        return F.transform(hashes, lambda h, i: F.xxhash64(F.lit(mask), h, *[F.get(hashes, i + k) for k in at[1:]]))

    return F.concat(*map(by, masks))


def hit_rows(docs: DataFrame, hashes: DataFrame, masks: list[str]) -> DataFrame:
    """doc_id, text_key, item, n, offset (of the item's first word in the document) of the hits; a row for each alignment."""
    hashed = docs.select("doc_id", "text_key", words(F.col("text")).alias("w"))
    # The number of words is taken before the explode: after it, every row would carry the array that it is taken from.
    # An outer explode, as for others Spark sets a filter on the array's size before the scan, with all of w in each element;
    # the null that an empty text gives joins nothing.
    hashed = hashed.select("doc_id", "text_key", F.size("w").alias("size"), seeds("w", masks).alias("seeds"))
    at = hashed.select("doc_id", "text_key", "size", F.posexplode_outer("seeds").alias("p", "seed"))
    return at.join(hashes, "seed").select("doc_id", "text_key", "item", "n", (F.col("p") % F.col("size") - F.col("q")).alias("offset")).distinct()


def compared(docs: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, id, n, matched of the hits that hold. Of a document only the words along its alignments go on."""
    of = hits.groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).agg(F.collect_list(F.struct("item", "n", "offset")).alias("hits"))
    of = F.broadcast(of) if hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else of
    own = docs.join(of, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")))

    def along(w: Column, h: Column) -> Column:
        inside = F.slice(w, F.greatest(h["offset"], F.lit(0)) + 1, h["n"] + F.least(h["offset"], F.lit(0)))
        return F.struct(h["item"].alias("item"), F.greatest(-h["offset"], F.lit(0)).alias("skip"), inside.alias("said"))

    own = own.select("doc_id", "text_key", F.explode(with_value(words(F.col("text")), lambda w: F.transform("hits", lambda h: along(w, h)))).alias("x"))
    rows = own.select("doc_id", "text_key", "x.*").join(items, "item").withColumn("n", F.size("v"))
    rows = rows.withColumn("equal", F.transform("v", lambda x, k: F.when((k >= F.col("skip")) & (F.get("said", F.greatest(k - F.col("skip"), F.lit(0))) == x), 1).otherwise(0)))
    rows = rows.withColumn("matched", F.aggregate("equal", F.lit(0), lambda acc, x: acc + x))
    span = F.least(F.col("n"), F.lit(OVERLAP))
    windows = F.exists(F.sequence(F.lit(1), F.col("n") - span + 1), lambda s: F.aggregate(F.slice("equal", s, span), F.lit(0), lambda acc, x: acc + x) >= SIMILARITY * span)
    verified = F.when(F.col("matched") >= SIMILARITY * F.col("n"), True).when(F.col("matched") < SIMILARITY * span, False).otherwise(windows)
    return rows.where(verified).select("doc_id", "text_key", "id", "n", "matched")


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """doc_id, text_key, item_id, item_words, matched, similarity: a row for each document and item that it contains.

    Null and empty texts contain nothing, and items without words are in nothing. Items have masks by
    their number of words. Repeated rows, and repeated items of one id, give one row. matched is the most along one
    alignment. Other columns are not read, whatever their names. Empty tables give no rows.
    """
    docs = df.select("doc_id", text_or_empty(text).alias("text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("text_key"))
    items = benchmark.select(F.col("item_id").alias("id"), words(text_or_empty(item_text)).alias("v")).where(F.size("v") > 0).distinct()
    items = staged(items.withColumn("item", F.xxhash64("id", "v")), "items")
    count, total = items.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    sizes = [r.n for r in items.select(F.least(F.size("v"), F.lit(LONG)).alias("n")).distinct().collect()]
    of = {n: item_masks(n) for n in sizes}
    masks = sorted({m for x in of.values() for m in x}) or MASKS
    fits = F.create_map(*[F.lit(x) for n in sizes for x in (n, ",".join(of[n]))]) if sizes else F.create_map(F.lit(0), F.lit(""))
    # Each mask of the item where it fits: the last word under it lies in the item.
    hashes = items.select("item", F.size("v").alias("n"), F.posexplode(seeds("v", masks)).alias("p", "seed"))
    hashes = hashes.select("item", "n", "seed", (F.col("p") % F.col("n")).alias("q"), F.get(F.array(*map(F.lit, masks)), F.floor(F.col("p") / F.col("n")).cast("int")).alias("mask"))
    hashes = hashes.where((F.col("q") + F.char_length("mask") <= F.col("n")) & F.array_contains(F.split(fits[F.least("n", F.lit(LONG))], ","), F.col("mask"))).select("item", "n", "seed", "q")
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-total * len(masks) // BROADCAST_ROWS))
    if blocks > MOST_READS:
        found = hit_rows(docs, hashes, masks)
    else:
        own = [hashes.where(F.pmod("item", F.lit(blocks)) == k) for k in range(blocks)]
        found = reduce(DataFrame.unionByName, [hit_rows(docs, F.broadcast(x), masks) for x in own])
    found = compared(docs, staged(found, "hits"), F.broadcast(items) if blocks == 1 else items)
    best = found.groupBy("doc_id", "text_key", F.col("id").alias("item_id")).agg(F.max(F.struct("matched", "n")).alias("best"))
    return best.select("doc_id", "text_key", "item_id", F.col("best.n").cast("long").alias("item_words"), F.col("best.matched").cast("long").alias("matched"), (F.col("best.matched") / F.col("best.n")).alias("similarity"))


def without_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df, all columns, that contain no item of the benchmark.

    Null and empty texts contain nothing and stay. Repeated rows stay or go together; rows with one id, or none, are
    told apart by their texts. Other columns keep their values, whatever their names. An empty table stays empty, and
    an empty benchmark takes nothing away.
    """
    found = staged(contaminated(df, benchmark, text).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).distinct(), "contaminated")
    rows = df.select(as_row(df), F.col("doc_id").alias("own_id"), F.xxhash64("doc_id", text_or_empty(text)).alias("own_key"))
    return rows.join(small_or_not(found), F.col("own_id").eqNullSafe(F.col("i")) & (F.col("own_key") == F.col("k")), "left_anti").select(back(df))
