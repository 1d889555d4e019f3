"""Packing documents into fixed windows, each with a target mixture of sources.

Every source is a queue, the token stream of its documents, and windows are filled by deficit round-robin with one
token as the unit of service. The queues are the leaves of a binary tree. Of the first n tokens that a node is to
serve, its left side gives floor(n * weight(left) / weight(node)), the right side the others, and what a side lacks
the other side gives. So each side's count grows by 0 or 1 with each token, rounding is made good by the tokens that
follow, and no source is ever more tokens off its target than the tree is deep, until it runs out. By default weights
are the sources' token counts, the mixture that uses up all queues together.

That makes a closed form: how many tokens of a source the first j windows hold follows from j and the source's path in
the tree. Deficits so carry over windows and partitions without any state passing between tasks, and a document's
place needs only the number of its source's tokens before it, which per-partition sums give.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, slices, small_or_not, staged
from .token_counts import LONGEST_KEY, ODD, load

#: Punctuation that may close a word, what letters the short way is not taken for, and the splitting pattern that it is right for.
CLOSING = ".,;:!?"
BEYOND = "[\u0130\u0300-\U0010ffff]"
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stems of words, and whole words, that a worker keeps in each of two generations.
CACHE = 250_000
#: Bytes of texts worked on at once.
SLICE = 4_000_000
WINDOW = 4096
END_ID = 2
PIECES_TYPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Cache:
    """A bounded dict: what was not asked for while CACHE new entries came in is forgotten."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def found(self, words: list[str]) -> list[bytes | None]:
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        known = list(map(self.young.get, words))
        if self.old and None in known:
            for i, x in enumerate(known):
                if x is None and (x := self.old.get(words[i])) is not None:
                    known[i] = self.young[words[i]] = x
        return known


def id_kind(path: str, *others: int) -> str:
    """The numpy type that holds every id of a tokenizer, and other ids."""
    return "<u2" if max(load(path).get_vocab_size(with_added_tokens=True) - 1, *others, 0) < 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def encoder(path: str, kind: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, kind)


class Encoder:
    """Ids of whole texts as numbers of 16 bits, or of 32 where the vocabulary (or least, an id that is needed) is larger.

    The tokenizer drops white space and never joins words across it, so it is asked once for each different word. A
    word is letters and a closing sign most times; ids of such stems are cached in lower case. Letters below U+0300 are already composed, so what the
    tokenizer does to them before its merges is to lower-case them and write their bytes as characters; the merges
    alone then take less than half the time. Every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, kind: str | None = None):
        self.tokenizer = load(path)
        self.words, self.stems = Cache(), Cache()
        self.kind = np.dtype(kind or id_kind(path))
        self.merges = type(self.tokenizer)(self.tokenizer.model)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.plain = pre_tokenized_letters(self.tokenizer)

    def ids(self, tokenizer, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def looked_up(self, cache: Cache, tokenizer, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache or the tokenizer."""
        known = cache.found(words)
        if missed := [i for i, x in enumerate(known) if x is None]:
            new = [words[i] for i in missed]
            if tokenizer is self.merges:
                new = [w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode())) for w in new]
            for i, x in zip(missed, self.ids(tokenizer, new), strict=True):
                known[i] = x
                if len(words[i]) <= LONGEST_KEY:
                    cache.young[words[i]] = x
        return known

    def of_distinct(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: all ids, and for each word where its ids begin there and how many they are."""
        stems = pc.utf8_rtrim(words, CLOSING)
        closed = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
        plain = pc.and_not(pc.utf8_is_alpha(stems), pc.match_substring_regex(stems, BEYOND)).to_numpy(zero_copy_only=False) & (closed < 2) & self.plain
        numbered = pc.utf8_lower(stems.filter(pa.array(plain))).dictionary_encode()
        atoms = self.looked_up(self.stems, self.merges, numbered.dictionary.to_pylist())
        part = np.empty((len(words), 2), np.int64)
        part[plain, 0] = numbered.indices.to_numpy()
        part[~plain, 0] = len(atoms) + np.arange((~plain).sum())
        atoms += self.looked_up(self.words, self.tokenizer, words.filter(pa.array(~plain)).to_pylist())
        ends = words.offsets.to_numpy()[1:] if hasattr(words, "offsets") else np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + 1 + len(words)]
        last = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)[np.maximum(ends - 1, 0)]
        signs = np.zeros(256, np.int64)
        signs[list(CLOSING.encode())] = 1 + np.arange(len(CLOSING))
        part[:, 1] = len(atoms) + np.where(plain & (closed == 1), signs[last], 0)
        atoms += [b"", *self.looked_up(self.words, self.tokenizer, list(CLOSING))]
        sizes = np.fromiter(map(len, atoms), np.int64, len(atoms)) // self.kind.itemsize
        flat, size = ragged(np.frombuffer(b"".join(atoms), self.kind), np.cumsum(sizes) - sizes, sizes, part.ravel())
        size = size.reshape(-1, 2).sum(axis=1)
        return flat, np.cumsum(size) - size, size

    def of(self, texts: pa.LargeStringArray) -> list[bytes]:
        """The words of all texts (no nulls) are numbered together; ids are found once for each different word and then laid out by number."""
        strange = pc.match_substring_regex(texts, ODD.pattern)
        odd = {i: self.ids(self.tokenizer, [texts[i].as_py()])[0] for i in np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()}
        lists = pc.utf8_split_whitespace(pc.if_else(strange, "", texts) if odd else texts)
        numbered = lists.flatten().dictionary_encode()
        laid, size = ragged(*self.of_distinct(numbered.dictionary), numbered.indices.to_numpy())
        border = np.r_[0, np.cumsum(size)][lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [odd[i] if i in odd else laid[a:b].tobytes() for i, (a, b) in enumerate(zip(border, border[1:]))]


def ragged(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that `of` names, one after the other, and their sizes."""
    size = sizes[of]
    ends = np.cumsum(size)
    return flat[np.repeat(begins[of] - ends + size, size) + np.arange(ends[-1] if ends.size else 0)], size


def pre_tokenized_letters(tokenizer) -> bool:
    """Whether the tokenizer composes and lower-cases, takes runs of letters and of punctuation apart, and no more."""
    first, second = (json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    normalizers = [x["type"] for x in first.get("normalizers", [])]
    steps = second.get("pretokenizers", [])
    return normalizers == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == LETTER_RUNS and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]


def encoded_rows(path: str, end_id: int, kind: str):
    """doc_id, source, text -> doc_id, source, part, before (tokens of the same source earlier in this partition), ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), {}
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = [x + end for piece in slices(batch["text"], SLICE) for x in encoder(path, kind).of(pc.fill_null(piece.cast(pa.large_string()), ""))]
            before = []
            for source, x in zip(batch["source"].to_pylist(), ids, strict=True):
                before.append(so_far.get(source, 0))
                so_far[source] = before[-1] + len(x) // len(end)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "before", "ids"])

    return encode


def tree_paths(sources: list[tuple[str | None, int, int]]) -> list[list[tuple[int, int, int, int, int]]]:
    """For each source (name, tokens, weight), in order: (weight left, weight of node, tokens left, tokens right, 1 if right) from the root down."""
    tokens, weight = (np.concatenate([[0], np.cumsum([x[k] for x in sources], dtype=object)]) for k in (1, 2))
    paths: list[list[tuple[int, int, int, int, int]]] = []
    for i in range(len(sources)):
        path, low, high = [], 0, len(sources)
        while high - low > 1:
            middle = (low + high) // 2
            right = i >= middle
            path.append((int(weight[middle] - weight[low]), int(weight[high] - weight[low]), int(tokens[middle] - tokens[low]), int(tokens[high] - tokens[middle]), int(right)))
            low, high = (middle, high) if right else (low, middle)
        paths.append(path)
    return paths


def served(n: int, path: list[tuple[int, int, int, int, int]]) -> tuple[int, int]:
    """Of the first n tokens: how many are of the sources before the one at the end of path, and of that one."""
    before = 0
    for weight, weights, left, right, turn in path:
        m = n * weight // weights if weights else n * left // (left + right)
        m = min(left, max(n - right, m))
        if turn:
            before += m
            n -= m
        else:
            n = m
    return before, n


def cut(start: int, count: int, path: list[tuple[int, int, int, int, int]], mine: int, total: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of a document at `start` of its source's stream: from, to (both in the document), sequence, offset there.

    mine: tokens of the source; total: of all.
    """

    def upto(j: int) -> tuple[int, int]:
        return served(min(j * window, total), path)

    windows = -(-total // window)
    guess = start * total // (mine * window)
    low, high = max(0, guess - 2), min(windows, guess + 3)
    if upto(low)[1] > start or upto(high)[1] <= start:
        low, high = 0, windows
    j = low + bisect_right(range(low, high + 1), start, key=lambda i: upto(i)[1]) - 1
    at, end = start, start + count
    (before, mine_before), (next_before, mine_after) = upto(j), upto(j + 1)
    while at < end:
        to = min(end, mine_after)
        if to > at:
            yield at - start, to - start, j, next_before - before + at - mine_before
        at, j = to, j + 1
        before, mine_before = next_before, mine_after
        if at < end:
            next_before, mine_after = upto(j + 1)


def pieces_of(window: int, kind: str):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(x.split(" ")[0], pa.int64()) for x in PIECES_TYPE.split(", ")])
        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            paths: dict[tuple[int, ...], list] = {}
            doc_ids = batch["doc_id"].to_pylist()
            for i, (ids, start, path, mine, total) in enumerate(zip(batch["ids"], *(batch[x].to_pylist() for x in ("start", "path", "mine", "total")), strict=True)):
                steps = paths.setdefault(tuple(path), [tuple(path[k : k + 5]) for k in range(0, len(path), 5)])
                wide = memoryview(np.frombuffer(ids.as_buffer(), kind).astype("<u4")).cast("B")
                n = len(wide) // 4
                for a, b, sequence, offset in cut(start, n, steps, mine, total, window):
                    for column, value in zip(rows, (doc_ids[i], a, b - a, zlib.crc32(wide[4 * a : 4 * b]), n, sequence, offset), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], schema=kinds)

    return place


def path_rows(targets: dict[str | None, float] | None):
    """All sources, s and mine, to s, path (5 numbers a node), mine, total. One task, a row for each source."""

    def lay(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["s"].to_pylist(), table["mine"].to_pylist()), key=lambda x: (x[0] is not None, x[0] or ""))
        weighed = [(name, n, n if targets is None else round(targets.get(name, 0) * 1_000_000)) for name, n in rows]
        paths = [[x for node in path for x in node] for path in tree_paths(weighed)]
        total = sum(n for _, n in rows)
        return pa.table({"s": pa.array([x for x, _ in rows], pa.string()), "path": pa.array(paths, pa.list_(pa.int64())), "mine": [n for _, n in rows], "total": [total] * len(rows)})

    return lay


def packed(df: DataFrame, path: str, source: str = "source", text: str = "text", window: int = WINDOW, end_id: int = END_ID, targets: dict[str | None, float] | None = None) -> DataFrame:
    """A row of PIECES_TYPE for each piece of each document: whole texts, each id in exactly one piece, only the last window short.

    targets: shares of the sources in each window, on any scale; a source that has run out leaves its share to others,
    and one that is not named comes in when those beside it in the tree have run out. None: as in the corpus. A null or empty text
    has the end id alone. A null source is a source of its own. Repeated rows are packed each. Ids take 16 bits, or 32 with
    a vocabulary that needs them.
    Other columns are not read, whatever their names. An empty table gives no pieces. Ids are computed once, written
    to the shared folder, and not shuffled; only sums by partition and source are.
    """
    importable(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    kind = id_kind(path, end_id)
    ids = staged(rows.mapInArrow(encoded_rows(path, end_id, kind), "doc_id long, source string, part long, before long, ids binary"), "ids")
    sums = ids.groupBy("source", "part").agg(F.sum(F.octet_length("ids") / int(kind[-1])).cast("long").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    by_source = sums.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("mine"))
    paths = staged(by_source.groupBy().applyInArrow(path_rows(targets), "s string, path array<long>, mine long, total long"), "paths")
    base = staged(sums.select(F.col("source").alias("b"), F.col("part").alias("p"), "base"), "bases")
    placed = ids.join(small_or_not(base), F.col("source").eqNullSafe(F.col("b")) & (F.col("part") == F.col("p")))
    placed = placed.join(small_or_not(paths), F.col("source").eqNullSafe(F.col("s")))
    return placed.select("doc_id", "ids", (F.col("base") + F.col("before")).alias("start"), "path", "mine", "total").mapInArrow(pieces_of(window, kind), PIECES_TYPE)
