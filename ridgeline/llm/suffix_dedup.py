"""Exact removal of long repeated substrings, and of passages of words that repeat, by suffix arrays over shards.

Two kinds of strings are sought at once: those of 400 bytes, and those of 50 words, whatever white space stands between
the words. Every string has one minimizer, the smallest hash of its 128-byte (16-word) substrings (ties: the first).
Runs of neighbouring strings with one minimizer form a piece, and equal strings lie in pieces with equal minimizer
hashes. So pieces are dealt to shards by that hash, and strings need not be compared across shards. Pieces whose hash
occurs once are dropped, equal pieces are counted and one of each goes on, and only where different pieces share a
hash their bytes are fetched. A shard's suffix array comes from Larsson-Sadakane refinement, its common prefixes from
Kasai's algorithm, run in lanes. A string is repeated if the longer common prefix with its neighbours in the array
covers it. The arrays of passages are over words, each one number (its 64-bit hash), not over their bytes.

A passage in very many texts gives very many different pieces with one hash, one or two for each text, most strings of
which occur once. Of such frequent hashes only the runs of strings go on whose own hash occurs twice; they are mostly
equal and count as one. If one hash still has more bytes than a shard may hold, they are split over several suffix
arrays, which are merged by binary search of each one's strings in the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, row_key, staged, text_or_empty

LENGTH = 400
#: Words of a passage, and of the substrings of passages that are hashed.
PASSAGE = 50
GRAM_WORDS = 16
#: Bytes of the shortest strings that can be sought, and of the shortest substrings that are hashed.
LEAST_GRAM = 16
#: Bytes of texts whose minimizers are found at once, and of pieces under one suffix array.
CHUNK = 2_000_000
SHARD = 1_000_000
LANES = 8192
#: A hash with more different pieces than this is frequent.
FREQUENT = 1000
SEPARATOR = b"\xff"

#: The sign of h tells what a piece's strings are made of: bytes (0 or more) or words (below 0).
PIECES_TYPE = "k1 long, k2 long, h long, digest long, at long, n long"


def gram_size(length: int) -> int:
    """The power of two up to a third of length: long enough that few texts share one by chance."""
    return max(LEAST_GRAM, 1 << (length // 3).bit_length() - 1)


def doubled(x: np.ndarray, k: int, size: int) -> np.ndarray:
    """Of hashes of the k units at each position, those of `size` units (k times a power of two), from neighbouring halves."""
    while k < size:
        y = x[:-k] * np.uint64(0x9E3779B97F4A7C15)
        y ^= (y >> np.uint64(29)) ^ x[k:] * np.uint64(0xC2B2AE3D27D4EB4F)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(32)
        x, k = y, 2 * k
    return x


def byte_grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes (a power of two) at each position."""
    return doubled(np.ndarray(raw.size - 7, "<u8", raw, 0, (1,)).astype(np.uint64), 8, size)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = x.size
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def pieces(hashes: np.ndarray, gram: int, sizes: np.ndarray, length: int, raw: memoryview, words: bool) -> tuple[np.ndarray, ...]:
    """Text, signed minimizer hash, digest, first string and number of strings of each piece.

    hashes: of `gram` units at each position of the texts put together; sizes: units of each text; raw: their bytes, or
    the hashes of their words.
    """
    ends = np.cumsum(sizes)
    least = sliding_least((hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(hashes.size, dtype=np.uint64), length - gram + 1)
    text = np.repeat(np.arange(sizes.size), sizes)[: least.size]
    inside = np.arange(least.size) + length <= ends[text]
    starts = inside & np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(starts)
    stops = np.flatnonzero(inside & np.r_[(least[1:] != least[:-1]) | ~inside[1:] | (text[1:] != text[:-1]), True]) + 1
    digest, width = xxhash.xxh3_64_intdigest, 8 if words else 1
    digests = np.array([digest(raw[a * width : (b + length - 1) * width]) for a, b in zip(at.tolist(), stops.tolist())], np.uint64)
    h = (hashes[(least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)] >> np.uint64(1)) | np.uint64(words << 63)
    return text[at], h.view(np.int64), digests.view(np.int64), at - (ends - sizes)[text[at]], stops - at


def byte_pieces(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """See pieces(); texts have `length` bytes or more."""
    joined, size = b"".join(texts), gram_size(length)
    return pieces(byte_grams(np.frombuffer(joined, np.uint8), size), size, np.array([len(x) for x in texts], np.int64), length, memoryview(joined), False)


def word_pieces(texts: list[list[bytes]], passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """See pieces(); texts have `passage` words or more."""
    x = np.concatenate([word_hashes(words) for words in texts])
    size = min(GRAM_WORDS, 1 << passage.bit_length() - 1)
    return pieces(doubled(x, 1, size), size, np.array([len(words) for words in texts], np.int64), passage, memoryview(x).cast("B"), True)


def piece_rows(length: int, passage: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: tuple[np.ndarray, ...], keys: list[tuple[int, int]]) -> pa.RecordBatch:
            text, *columns = found
            own = np.array(keys, np.int64)[text]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (own[:, 0], own[:, 1], *columns)], [x.split(" ")[0] for x in PIECES_TYPE.split(", ")])

        def both(held: list[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
            if long := [x for x in held if len(x[0]) >= length]:
                yield rows(byte_pieces([x[0] for x in long], length), [x[1:] for x in long])
            split = [(x[0].split(), x[1:]) for x in held]
            if long := [x for x in split if len(x[0]) >= passage]:
                yield rows(word_pieces([x[0] for x in long], passage), [x[1] for x in long])

        for batch in batches:
            held, size = [], 0
            for row in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["k1"].to_pylist(), batch["k2"].to_pylist()):
                held.append(row)
                size += len(row[0])
                if size >= CHUNK:
                    yield from both(held)
                    held, size = [], 0
            yield from both(held)

    return cut


class Shard:
    """The suffix array of pieces put together, and what it says about strings of `length` units, bytes or hashes of words."""

    def __init__(self, parts: list[bytes], counts: list[int], length: int, words: bool = False):
        self.length = length
        # A unit's key holds `reach` units: a byte and the seven after it, or a word alone.
        self.reach, width, separator = (1, 8, b"\xff" * 8) if words else (8, 1, SEPARATOR)
        text = separator.join(parts) + separator
        self.n = len(text) // width
        padded = text + b"\0" * (width * length + 16)
        self.keys = (np.frombuffer(padded, "<u8") if words else np.ndarray(len(padded) - 7, ">u8", padded, 0, (1,))).astype(np.uint64)
        begins = np.cumsum([0, *[len(x) // width + 1 for x in parts[:-1]]])
        self.starts = np.concatenate([np.arange(a, a + n) for a, n in zip(begins.tolist(), counts)])
        self.of = np.repeat(np.arange(len(parts)), counts)
        self.rank, self.suffixes = self.sorted()
        common = self.prefixes()
        self.repeated = (np.maximum(common, np.r_[common[1:], 0]) >= length)[self.rank[self.starts]]

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by the first 8 bytes (the first word), then doubled for the groups that are not yet single (Larsson and Sadakane)."""
        n, k = self.n, self.reach
        order = np.argsort(self.keys[:n], kind="stable")
        first = self.keys[order]
        start = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        size = np.diff(np.r_[start, n])
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(start, size)
        active = order[np.repeat(size > 1, size)]
        while active.size:
            after = active + k
            second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(rank[active] * (n + 1) + second, kind="stable")
            active, second = active[by], second[by]
            old, at = rank[active], np.arange(active.size)
            group = np.r_[True, old[1:] != old[:-1]]
            begins = group | np.r_[True, second[1:] != second[:-1]]
            slot = old + at - np.maximum.accumulate(np.where(group, at, 0))
            rank[active] = slot[np.maximum.accumulate(np.where(begins, at, 0))]
            size = np.diff(np.r_[np.flatnonzero(begins), active.size])
            active = active[np.repeat(size > 1, size)]
            k *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        return rank, suffixes

    def extended(self, i: np.ndarray, other: np.ndarray, j: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Common prefixes, up to length, of suffixes i here and j of other keys, of which `common` units are known to be equal."""
        common = common.copy()
        active = np.flatnonzero(common < self.length)
        while active.size:
            x = self.keys[np.minimum(i[active] + common[active], self.keys.size - 1)] ^ other[np.minimum(j[active] + common[active], other.size - 1)]
            same = x == 0
            lead = np.zeros(x.size, np.int64)
            for half in (32, 16, 8) if self.reach > 1 else ():
                upper = x >> np.uint64(half)
                zero = upper == 0
                lead += zero * (half // 8)
                x = np.where(zero, x, upper)
            common[active] += np.where(same, self.reach, lead)
            active = active[same]
            active = active[common[active] < self.length]
        return np.minimum(common, self.length)

    def prefixes(self) -> np.ndarray:
        """By rank, the common prefix with the suffix before, up to length (Kasai): a position's is at least its predecessor's less one."""
        out = np.zeros(self.n, np.int64)
        step = -(-self.n // LANES)
        at = np.arange(0, self.n, step)
        common = np.zeros(at.size, np.int64)
        for _ in range(step):
            live = at < self.n
            at, common = at[live], np.maximum(common[live] - 1, 0)
            rank = self.rank[at]
            before = self.suffixes[np.maximum(rank - 1, 0)]
            common = np.where(rank > 0, self.extended(at, self.keys, before, common), 0)
            limit = np.minimum(self.n - at, self.n - before)
            common = np.minimum(common, limit)
            out[rank] = common
            at = at + 1
        return out

    def merge(self, other: Shard) -> None:
        """Marks the strings here that occur in the other shard, by binary search in its suffix array."""
        left = np.flatnonzero(~self.repeated)
        i = self.starts[left]
        low, high = np.zeros(i.size, np.int64), np.full(i.size, other.n, np.int64)
        none = np.zeros(i.size, np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            j = other.suffixes[np.minimum(middle, other.n - 1)]
            common = self.extended(i, other.keys, j, none)
            theirs, mine = other.keys[np.minimum(j + common, other.keys.size - 1)], self.keys[np.minimum(i + common, self.keys.size - 1)]
            less = (common < self.length) & (theirs < mine)
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        found = low < other.n
        j = other.suffixes[np.minimum(low, other.n - 1)]
        self.repeated[left] |= found & (self.extended(i, other.keys, j, none) >= self.length)


def repeated_spans(batches: Iterator[pa.RecordBatch], length: int, passage: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """h, digest, n, bytes in order of h and digest -> h, digest, low, high: maximal ranges of strings that occur in other pieces too."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    begin = 0  # of held, where the last row's hash begins
    hot: list[tuple[list, Shard]] = []

    def shard_of(rows: list) -> Shard:
        words = rows[0][0] < 0
        return Shard([r[3] for r in rows], [r[2] for r in rows], passage if words else length, words)

    def spans(rows: list, shard: Shard) -> pa.RecordBatch:
        counts = np.array([r[2] for r in rows], np.int64)
        string = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        edge = np.r_[True, shard.of[1:] != shard.of[:-1]]
        low = np.flatnonzero(shard.repeated & (edge | np.r_[True, ~shard.repeated[:-1]]))
        high = np.flatnonzero(shard.repeated & np.r_[edge[1:] | ~shard.repeated[1:], True])
        of = shard.of[low]
        columns = [np.array([r[0] for r in rows], np.int64)[of], np.array([r[1] for r in rows], np.int64)[of], string[low], string[high] + 1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "digest", "low", "high"])

    def close() -> Iterator[pa.RecordBatch]:
        """Ends the shards held. Several of them are of one hash."""
        nonlocal held, size, hot
        if held:
            hot.append((held, shard_of(held)))
        for i, (_, shard) in enumerate(hot):
            for k, (_, other) in enumerate(hot):
                if i != k:
                    shard.merge(other)
        for rows, shard in hot:
            yield spans(rows, shard)
        held, size, hot = [], 0, []

    last = None
    for batch in batches:
        for row in zip(*(batch[x].to_pylist() for x in ("h", "digest", "n", "bytes"))):
            if last is not None and row[0] != last[0] and (size >= shard_bytes or hot or (row[0] < 0) != (last[0] < 0)):
                yield from close()  # bytes and words never meet
            elif last is not None and row[:2] == last[:2]:
                continue  # a repeated row's piece
            elif last is not None and row[0] == last[0] and size >= shard_bytes:
                if begin:  # the hashes before are whole
                    own, held = held[begin:], held[:begin]
                    yield from close()
                    held, size, begin = own, sum(len(r[3]) for r in own), 0
                if size >= shard_bytes:
                    hot.append((held, shard_of(held)))
                    held, size = [], 0
            if last is None or row[0] != last[0]:
                begin = len(held)
            held.append(row)
            size += len(row[3])
            last = row
    yield from close()


def string_keys(hashes: np.ndarray, gram: int, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` units at each position, from those of `gram` units."""
    n = hashes.size + gram - length
    out = np.zeros(n, np.uint64)
    for at in [*range(0, length - gram, gram), length - gram]:
        out = (out ^ hashes[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def string_rows(length: int, passage: int):
    """h, digest, n, bytes -> h, digest, i, w: the hash of each of a piece's strings."""

    def keys(part: bytes, words: bool) -> np.ndarray:
        if not words:
            return string_keys(byte_grams(np.frombuffer(part, np.uint8), gram_size(length)), gram_size(length), length)
        size = min(GRAM_WORDS, 1 << passage.bit_length() - 1)
        return string_keys(doubled(np.frombuffer(part, "<u8"), 1, size), size, passage) ^ np.uint64(1 << 63)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy()
            if not n.size:
                continue
            w = np.concatenate([keys(part, h < 0) for part, h in zip(batch["bytes"].to_pylist(), batch["h"].to_pylist())])
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.repeat(batch["h"].to_numpy(), n), np.repeat(batch["digest"].to_numpy(), n), i, w.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "digest", "i", "w"])

    return key


def cut_rows(length: int, passage: int):
    """h, digest, bytes, strings -> h, digest, part (a hash), low, n, bytes: the runs of neighbouring strings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([*((x, pa.int64()) for x in ("h", "digest", "part", "low", "n")), ("bytes", pa.binary())])
        for batch in batches:
            rows = []
            for h, digest, text, strings in zip(*(batch[x].to_pylist() for x in ("h", "digest", "bytes", "strings"))):
                width, size = (8, passage) if h < 0 else (1, length)
                at = np.array(sorted(strings), np.int64)
                edge = np.flatnonzero(np.diff(at) != 1)
                for low, high in zip(at[np.r_[0, edge + 1]].tolist(), at[np.r_[edge, at.size - 1]].tolist()):
                    part = text[low * width : (high + size) * width]
                    rows.append((h, digest, int(np.uint64(xxhash.xxh3_64_intdigest(part)).view(np.int64)), low, high + 1 - low, part))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k.type) for x, k in zip(zip(*rows), kinds)], schema=kinds) if rows else pa.RecordBatch.from_pylist([], kinds)

    return cut


def spans_of(pieces_: DataFrame, length: int, passage: int, shard_bytes: int) -> DataFrame:
    """h, digest, low, high of pieces (h, digest, n, bytes): see repeated_spans()."""
    dealt = pieces_.select("h", "digest", "n", "bytes").repartition("h").sortWithinPartitions("h", "digest")
    return dealt.mapInArrow(lambda batches: repeated_spans(batches, length, passage, shard_bytes), "h long, digest long, low long, high long")


def frequent_spans(pieces_: DataFrame, length: int, passage: int, shard_bytes: int) -> DataFrame:
    """The same for pieces of frequent hashes."""
    strings = pieces_.mapInArrow(string_rows(length, passage), "h long, digest long, i long, w long")
    twice = staged(strings.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w"), "strings")
    kept = strings.join(twice, "w").groupBy("h", "digest").agg(F.collect_list("i").alias("strings"))
    parts = pieces_.join(kept, ["h", "digest"]).select("h", "digest", "bytes", "strings").mapInArrow(cut_rows(length, passage), "h long, digest long, part long, low long, n long, bytes binary")
    parts = staged(parts, "parts")
    kinds = staged(parts.groupBy("h", F.col("part").alias("digest")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("bytes").alias("bytes")), "kinds")
    single = kinds.where("c = 1").select("h", "digest").join(spans_of(kinds, length, passage, shard_bytes), ["h", "digest"])
    found = kinds.where("c > 1").select("h", "digest", F.lit(0).cast("long").alias("low"), F.col("n").alias("high")).unionByName(single)
    found = staged(found.select("h", F.col("digest").alias("part"), F.col("low").alias("from"), F.col("high").alias("to")), "found")
    return parts.select("h", "digest", "part", "low").join(found, ["h", "part"]).select("h", "digest", (F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to")).alias("high"))


def sliced(length: int, passage: int):
    """text, wanted (at, n, h, digest, frequent) -> h, digest, frequent, n, bytes (of words: their hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text, wanted in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["wanted"].to_pylist()):
                words = word_hashes(text.split()) if any(x["h"] < 0 for x in wanted) else np.empty(0, np.uint64)
                for x in wanted:
                    at, n = x["at"], x["n"]
                    part = text[at : at + n + length - 1] if x["h"] >= 0 else words[at : at + n + passage - 1].tobytes()
                    for column, value in zip(rows, (x["h"], x["digest"], x["frequent"], n, part), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["h", "digest", "frequent", "n", "bytes"])

    return cut


def united(spans: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Of lists of spans (low, high, words): list, words, low and high of what they make put together, where they overlap or touch; in order."""
    flat = spans.flatten()
    low, high, words = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("low", "high", "words"))
    group = 2 * np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy()) + words
    order = np.lexsort((low, group))
    low, high, group = low[order], high[order], group[order]
    apart = int(high.max(initial=0)) + 1
    upto = np.maximum.accumulate(high + group * apart) - group * apart
    begins = np.r_[True, (group[1:] != group[:-1]) | (low[1:] > upto[:-1])][: low.size]
    at = np.flatnonzero(begins)
    return group[at] // 2, group[at] % 2 == 1, low[at], upto[np.r_[at[1:], low.size] - 1] if at.size else upto


#: What kept_rows() makes of a text and its spans.
KEPT_TYPE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long, passages array<struct<low:long,high:long>>"


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans (low, high, words) -> KEPT_TYPE."""
    for batch in batches:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        of, words, low, high = united(batch["spans"])
        gone = [x.tolist() for x in (of[~words], low[~words], high[~words])]
        kept, at = [], 0
        for i, text in enumerate(texts):
            parts, end = [], 0
            while at < len(gone[0]) and gone[0][at] == i:
                parts.append(text[end : gone[1][at]])
                end, at = gone[2][at], at + 1
            kept.append(b"".join(parts) + text[end:] if parts else text)
        n_bytes, left = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (texts, kept))
        passages = pa.StructArray.from_arrays([pa.array(low[words]), pa.array(high[words])], ["low", "high"])
        ends = np.r_[0, np.cumsum(np.bincount(of[words], minlength=len(texts)))].astype(np.int32)
        columns = [n_bytes, n_bytes - left, np.bincount(of[~words], minlength=len(texts))]
        covered = np.bincount(of[words], (high - low)[words], len(texts)).astype(np.int64)
        columns = [*map(pa.array, columns), pa.array(kept, pa.binary()), pa.array(covered), pa.ListArray.from_arrays(pa.array(ends), passages)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], [x.split(" ")[0] for x in KEPT_TYPE.split(", ")])


def without_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD, frequent: int = FREQUENT, passage: int = PASSAGE) -> DataFrame:
    """KEPT_TYPE, a row for each row of df.

    A byte goes if a string of `length` bytes that covers it also starts elsewhere, in any row, its own included. passages
    are the words, numbered from 0, that a string of `passage` words covers which also starts elsewhere, with whatever
    white space between its words; they are reported, not removed, as they may have fewer bytes than `length`.
    Null and empty texts have 0 bytes and words and lose nothing; texts shorter than length lose no bytes, those of fewer words than
    passage have no passages. Repeated rows count as
    occurrences each, so they lose all their bytes if long enough. Rows with one id and different texts, or no id,
    are told apart by a hash of the text. Other columns are not read, whatever their names. An empty table gives an
    empty one.
    """
    if length < LEAST_GRAM:
        raise ValueError(f"length must be at least {LEAST_GRAM}")
    if passage < 1:
        raise ValueError("passage must be at least 1")
    least = min(length, 2 * passage - 1)
    importable(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    docs = docs.select("doc_id", "text", row_key(F.col("text")).alias("key")).select("doc_id", "text", "key.*")
    long = docs.where(F.octet_length("text") >= least)
    runs = staged(long.select("k1", "k2", "text").mapInArrow(piece_rows(length, passage), PIECES_TYPE), "pieces")
    # Tables to join with are staged first: Spark then splits the partitions of frequent keys.
    shared = staged(runs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
    suspects = staged(runs.join(shared, "h", "left_semi"), "suspects")
    classes = staged(suspects.groupBy("h", "digest").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "at", "n")).alias("one")).select("h", "digest", "c", "one.*"), "classes")
    several = staged(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h", (F.col("k") > frequent).alias("frequent")), "several")
    contested = classes.join(several, "h")
    wanted = contested.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(F.collect_list(F.struct("at", "n", "h", "digest", "frequent")).alias("wanted"))
    bytes_of = long.join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("text", "wanted").mapInArrow(sliced(length, passage), "h long, digest long, frequent boolean, n long, bytes binary")
    bytes_of = staged(bytes_of, "bytes")
    found = spans_of(bytes_of.where("NOT frequent"), length, passage, shard_bytes).unionByName(frequent_spans(bytes_of.where("frequent"), length, passage, shard_bytes))
    single = classes.where("c = 1").select("h", "digest").join(found, ["h", "digest"])
    marked = staged(classes.where("c > 1").select("h", "digest", F.lit(0).cast("long").alias("low"), F.col("n").alias("high")).unionByName(single), "marked")
    spans = suspects.join(marked, ["h", "digest"]).select("k1", "k2", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high") - 1 + F.when(F.col("h") < 0, passage).otherwise(length)).alias("high"), (F.col("h") < 0).alias("words"))
    spans = spans.groupBy(F.col("k1").alias("s1"), F.col("k2").alias("s2")).agg(F.collect_set(F.struct("low", "high", "words")).alias("spans"))
    whole = long.join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select("doc_id", "text", "spans")
    short = docs.where(F.octet_length("text") < least).select("doc_id", "text", F.array().cast("array<struct<low:bigint,high:bigint,words:boolean>>").alias("spans"))
    return whole.unionByName(short).mapInArrow(kept_rows, KEPT_TYPE)
