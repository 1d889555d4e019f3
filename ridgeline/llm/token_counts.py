"""Token counts by a two-tier lookup on the map side, without any shuffle of pre-tokens.

The splitting pattern of byte-level BPE never joins characters across the borders of the chunks matched here (a
word with the space before it, or white space), so a text has as many tokens as its chunks together. Tier one is a
broadcast table of the lengths of frequent chunks, fitted on a bounded sample and the vocabulary; tier two is a
cache in each Python worker. What neither holds is encoded by the library. The tables only save time: every text's
count is that of the library.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, slices

CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python takes these for white space, the tokenizer's pattern doesn't: such texts are encoded whole.
ODD = re.compile("[\x1c-\x1f]")
#: Rows of the sample that the frequent table is fitted on, and entries that it has at most.
SAMPLE_ROWS = 2_000
FREQUENT = 65_536
#: Entries of a worker's cache, and characters of a chunk that is kept there; a full cache is emptied.
CACHE = 500_000
LONGEST_KEY = 64
#: Bytes of texts worked on at once.
SLICE = 4_000_000


def load(path: str):
    """A tokenizer without truncation or padding, on one thread: Spark runs one worker for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Counts:
    """Counts tokens of texts; frequent: lengths by chunk."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        self.tokenizer, self.frequent, self.cache = tokenizer, frequent, dict(frequent)
        self.special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache = dict(self.frequent)
        get, counts, waiting, unknown = self.cache.get, [0] * len(texts), [], {}
        for i, text in enumerate(texts):
            if ODD.search(text) or any(x in text for x in self.special):
                counts[i] = self.lengths([text])[0]
                continue
            chunks = CHUNK.findall(text)
            found = list(map(get, chunks))
            if None in found:
                missed = [c for c, n in zip(chunks, found) if n is None]
                unknown.update(dict.fromkeys(missed))
                waiting.append((i, missed))
                counts[i] = sum(filter(None, found))
            else:
                counts[i] = sum(found)
        if unknown:
            unknown = dict(zip(unknown, self.lengths(list(unknown)), strict=True))
            for i, missed in waiting:
                counts[i] += sum(map(unknown.__getitem__, missed))
            self.cache.update((c, n) for c, n in unknown.items() if len(c) <= LONGEST_KEY)
        return counts


def frequent_table(df: DataFrame, text: str, path: str, rows: int = SAMPLE_ROWS, entries: int = FREQUENT) -> dict[str, int]:
    """Lengths of at most `entries` chunks: the most frequent of `rows` rows' first 4,000 characters. It decides speed only.

    take() reads a few partitions until it has the rows, and shuffles nothing.
    """
    tally: Counter[str] = Counter()
    for row in df.select(F.substring(text, 1, 4000)).take(rows):
        tally.update(CHUNK.findall(row[0] or ""))
    chunks = [c for c, _ in tally.most_common(entries) if len(c) <= LONGEST_KEY]
    return dict(zip(chunks, Counts(load(path), {}).lengths(chunks), strict=True)) if chunks else {}


_counts: dict[str, Counts] = {}


def worker_counts(path: str, frequent) -> Counts:
    """One for all tasks of a worker, so that what one task has met serves the next ones."""
    if path not in _counts:
        _counts.clear()
        _counts[path] = Counts(load(path), frequent.value)
    return _counts[path]


def counted(frequent, path: str) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = worker_counts(path, frequent)
        for texts in batches:
            yield pa.array([n for piece in slices(texts, SLICE) for n in counts.of([x or "" for x in piece.to_pylist()])], pa.int64())

    return count


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens. Repeated rows are counted each. Columns of df with these names are
    replaced. Special strings inside texts count as the library's default has it. An empty table stays empty.
    """
    importable(df.sparkSession)
    frequent = df.sparkSession.sparkContext.broadcast(frequent_table(df, text, path))
    number = F.arrow_udf(counted(frequent, path), "long")
    out = df.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": number(F.col(text))})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
