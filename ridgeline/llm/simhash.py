"""Near-duplicates by 64-bit SimHash, with pigeonring filtering of candidate pairs.

A fingerprint's 64 bits form a ring of 8 segments. If two fingerprints differ in at most 3 bits, some segment starts
a chain in which the first l segments differ in at most 3 * l / 8 bits, for every l: the first two segments are
equal, the next three differ in one bit at most, and so on. Of those three at least two are equal, so the pair shares
one of 3 keys of 32 bits at that start, 24 keys in all. Fingerprints that share a key are compared along the chain,
then in full. Exact copies share a fingerprint and count once. Where many fingerprints share a key, the four segments
outside it hold at most 3 differing bits, so one of them is equal: the key is split by each of the four. In what still
are many, a search from each one reached finds what links them without comparing all pairs of a dense group. Components of the links come from
alternating star contraction; nothing of this goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, as_row, back, importable, row_key, staged, text_or_empty

SEED = 42
SHINGLE = 3
DISTANCE = 3
SEGMENTS = 8
#: Bits that the first l segments of a chain may differ in.
BUDGET = [DISTANCE * (k + 1) // SEGMENTS for k in range(SEGMENTS)]
#: Of the segments 2, 3 and 4 of a chain, the two that a key holds.
PAIRS = [(2, 3), (2, 4), (3, 4)]
#: In runs of at most so many fingerprints with one key all pairs are compared at once.
SHORT_RUN = 16
#: Keys of more fingerprints than this are split.
HOT_KEY = 2_000


def fingerprint(text: str | None) -> int:
    """Of the word 3-shingles of a text with A-Z in lower case; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > hashes.size, bitorder="little").view(np.uint64)[0])


def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64))


def turned(x: np.ndarray, start: int) -> np.ndarray:
    """x with segment `start` in its top byte."""
    k = np.uint64(8 * start)
    return x if not start else (x << k) | (x >> (np.uint64(64) - k))


def segment(x: np.ndarray, i: int) -> np.ndarray:
    return (x >> np.uint64(56 - 8 * i)) & np.uint64(0xFF)


#: A key, from the top: its start and pair (5 bits), which further segment is split by (3 bits; WHOLE: none), its four
#: segments, the further one.
WHOLE = 4


def start_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> 43) // len(PAIRS)


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> key, fp: 24 rows each."""
    for batch in batches:
        fp = batch["fp"].to_numpy().view(np.uint64)
        for start in range(SEGMENTS):
            x = turned(fp, start)
            head = (segment(x, 0) << np.uint64(32)) | (segment(x, 1) << np.uint64(24))
            for v, (a, b) in enumerate(PAIRS):
                code = ((start * len(PAIRS) + v) << 43) | (WHOLE << 40)
                key = head | (segment(x, a) << np.uint64(16)) | segment(x, b) << np.uint64(8) | np.uint64(code)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])


def split_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, fp -> key, fp: 4 rows each, one for each segment outside the key."""
    rest = np.array([[i for i in range(2, SEGMENTS) if i not in pair] for pair in PAIRS], np.uint64)
    for batch in batches:
        key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
        k = (start_of(key) * 8).astype(np.uint64)
        x = np.where(k == 0, fp, (fp << k) | (fp >> ((np.uint64(64) - k) & np.uint64(63))))
        for i in range(WHOLE):
            place = rest[(key >> 43) % len(PAIRS), i]
            own = (key & ~np.int64(7 << 40)) | np.int64(i << 40) | ((x >> (np.uint64(56) - np.uint64(8) * place)) & np.uint64(0xFF)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch["fp"]], ["key", "fp"])


def chained(x: np.ndarray, y: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether x and y keep every budget along the chain from `start`; the last budget is the full Hamming check."""
    d = x ^ y
    k = np.asarray(start, np.uint64) * np.uint64(8)
    d = np.where(k == 0, d, (d << k) | (d >> ((np.uint64(64) - k) & np.uint64(63))))
    ok = np.ones(d.shape, bool)
    for i, most in enumerate(BUDGET):
        ok &= np.bitwise_count(d >> np.uint64(56 - 8 * i)) <= most
    return ok


def forest(fps: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever chains from `start` connect among fps, one for each fingerprint that is reached."""
    out, rest = [], fps
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            x = queue.pop()
            ok = chained(x, rest, start)
            if ok.any():
                found, rest = rest[ok], rest[~ok]
                out.append((np.full(found.size, x), found))
                queue.extend(found)
    return out


def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints with one key; keys are sorted."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, keys.size])
    found = []
    short = np.repeat((size > 1) & (size <= SHORT_RUN), size)
    k, f = keys[short], fps[short]
    for d in range(1, SHORT_RUN):
        if d >= k.size:
            break
        at = np.flatnonzero(k[d:] == k[:-d])
        if not at.size:
            break
        a, b = f[at], f[at + d]
        ok = chained(a, b, start_of(k[at])) & (a != b)
        found.append((a[ok], b[ok]))
    for i in np.flatnonzero(size > SHORT_RUN):
        run = slice(start[i], start[i] + size[i])
        found += forest(np.unique(fps[run]), int(start_of(keys[start[i]])))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def links_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, fp in order of key -> u, v. The last run of a batch waits for the next one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = linked(keys, fps)
        both = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both.max(axis=0)), pa.array(both.min(axis=0))], ["u", "v"])

    for batch in batches:
        keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
        if not keys.size:
            continue
        if not held or held[-1][0][-1] != keys[-1] or keys[0] != keys[-1]:
            keys, fps = (np.concatenate(x) for x in zip(*held, (keys, fps), strict=True))
            last = np.searchsorted(keys, keys[-1])
            if last:
                yield links(keys[:last], fps[:last])
            held = [(keys[last:], fps[last:])]
        else:
            held.append((keys, fps))
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (u, v), u > v; root: the smallest node of its component, roots included."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = staged(links.distinct(), "links")
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        edges = staged(small.distinct(), "stars")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def dealt_keys(fps: DataFrame, hot_key: int) -> DataFrame:
    """key, fp: the 24 keys of each fingerprint, those of more than hot_key fingerprints split."""
    keys, kinds = fps.mapInArrow(keyed, "key long, fp long"), "key long, fp long"
    hot = staged(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select(F.col("key").alias("hot")), "hot")
    many = hot.limit(BROADCAST_ROWS + 1).count()
    if not many:
        return keys
    own = keys.join(F.broadcast(hot) if many <= BROADCAST_ROWS else hot, F.col("key") == F.col("hot"), "left")
    return own.where("hot IS NULL").select("key", "fp").unionByName(own.where("hot IS NOT NULL").select("key", "fp").mapInArrow(split_keys, kinds))


def near_duplicates(df: DataFrame, text: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """doc_id, k1 and k2 (see row_key), fp, root (the smallest fingerprint of the component, both as signed longs), component_id.

    A row for each row of df. Texts without words, null included, share fingerprint 0. Repeated rows are all in one
    component. component_id is the smallest doc_id of the component, null if none of its rows has one. Other columns
    are not read, whatever their names. An empty table gives an empty one.
    """
    importable(df.sparkSession)
    marks = staged(df.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(text_or_empty(text)).alias("key"), F.arrow_udf(fingerprints, "long")(F.col(text)).alias("fp")).select("doc_id", "key.*", "fp"), "fingerprints")
    classes = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    keys = dealt_keys(classes.select("fp"), hot_key).repartition("key").sortWithinPartitions("key", "fp")
    roots = components(keys.mapInArrow(links_of_runs, "u long, v long"))
    member = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.select("fp", "root").join(named, "root")
    whole = classes.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    whole = staged(whole, "whole")  # Spark splits the partitions of frequent fingerprints where both sides are tables.
    return marks.join(whole, "fp").select("doc_id", "k1", "k2", "fp", "root", "component_id")


def without_near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """One row of df for each component, all columns: that of the smallest doc_id (no id: last).

    Ties: of rows with one id, that of the smallest hash of id and text; of rows with one id and text, that whose other
    columns have the smallest hash. Null and empty texts, and all without words, are one component with what links to
    fingerprint 0. Of repeated rows one stays. Other columns keep their values, whatever their names. An empty table
    stays empty.
    """
    found = near_duplicates(df, text)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "k1", "k2")).alias("best"))
    best = best.select(F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"))
    others = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    rows = df.select(as_row(df), row_key(text_or_empty(text)).alias("key"), others.alias("others"))
    rows = rows.join(best, (F.col("key.k1") == F.col("b1")) & (F.col("key.k2") == F.col("b2")))
    return rows.groupBy("b1", "b2").agg(F.min_by("row", "others").alias("row")).select(back(df))
