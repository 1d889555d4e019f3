"""Quality rules on repetition, from suffix arrays over the words of each document.

One suffix array serves all documents of an Arrow batch: the first rank of a word holds its document, so that no
suffixes of two documents are ever equal. Ranks are refined by doubling; groups of one suffix take no further part.
Longest common prefixes of neighbours come from Kasai's algorithm, run in lanes. A position whose longer common
prefix with a neighbour has l words starts a repeated substring of l words; the union of these spans is the text
that maximal repeats cover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, importable, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Repeats of fewer words don't count as covered.
MIN_REPEAT = 8
MAX_COVERED = 0.35
#: The longest repeat may have so many words, or this share of the document if that is more.
MAX_LONGEST = 100
MAX_LONGEST_SHARE = 0.2
#: Words worked on at once; a longer document is worked on alone.
CHUNK_WORDS = 300_000
#: Positions of the suffix array that prefixes are found for side by side.
LANES = 8192
#: Bytes of texts taken from a batch at once.
SLICE = 2_000_000

RULES_TYPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def sorted_suffixes(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and the suffix array of words (numbers). end: where each position's document ends."""
    n, k = first.size, 1
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    size = np.diff(np.r_[start, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    active = order[np.repeat(size > 1, size)]
    while active.size:
        after = active + k
        second = np.where(after < end[active], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(rank[active] * (n + 1) + second, kind="stable")
        active, second = active[by], second[by]
        old = rank[active]
        new_group = np.r_[True, old[1:] != old[:-1]]
        at = np.arange(active.size)
        slot = old + at - np.maximum.accumulate(np.where(new_group, at, 0))
        begins = new_group | np.r_[True, second[1:] != second[:-1]]
        rank[active] = slot[np.maximum.accumulate(np.where(begins, at, 0))]
        k *= 2
        size = np.diff(np.r_[np.flatnonzero(begins), active.size])
        active = active[np.repeat(size > 1, size)]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return rank, suffixes


def neighbour_prefixes(first: np.ndarray, rank: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For each position, the longer of its common prefixes with the suffixes before and after it.

    Words of different documents are never equal, so no prefix reaches over a document's end. A position's prefix is
    at least its predecessor's less one (Kasai); lanes of positions are worked on side by side.
    """
    n = first.size
    common = np.zeros(n + 1, np.int64)  # by rank, with the suffix before
    padded = np.r_[first, -1]
    step = -(-n // LANES) if n else 0
    at = np.arange(0, n, max(step, 1))
    held = np.zeros(at.size, np.int64)
    for _ in range(step):
        live = at < n
        at, held = at[live], np.maximum(held[live] - 1, 0)
        before = suffixes[np.maximum(rank[at] - 1, 0)]
        held[rank[at] == 0] = 0
        active = np.flatnonzero(rank[at] > 0)
        while active.size:
            # At the last word's end one of the two, never both, reads the number that no word has.
            x, y = at[active] + held[active], before[active] + held[active]
            active = active[padded[np.minimum(x, n)] == padded[np.minimum(y, n)]]
            held[active] += 1
        common[rank[at]] = held
        at = at + 1
    return np.maximum(common[:-1], common[1:])[rank]


def covered(longest: np.ndarray, least: int, length: np.ndarray | int) -> np.ndarray:
    """Marks the positions inside [p, p + length) of every p whose repeat has at least `least` words."""
    n = longest.size
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + (length[at] if isinstance(length, np.ndarray) else length), n), 1)
    return np.cumsum(edge[:n]) > 0


def repetition(documents: list[list[str]]) -> np.ndarray:
    """For each document's words: words in repeated 3-word windows, words covered by long repeats, longest repeat."""
    out = np.zeros((len(documents), 3), np.int64)
    sizes = np.array([len(x) for x in documents], np.int64)
    total = int(sizes.sum())
    if not total:
        return out
    ids: dict[str, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for words in documents for w in words), np.int64, total)
    doc = np.repeat(np.arange(len(documents)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    first = doc * len(ids) + word
    longest = neighbour_prefixes(first, *sorted_suffixes(first, end))
    out[:, 0] = np.bincount(doc, covered(longest, 3, 3), len(documents))
    out[:, 1] = np.bincount(doc, covered(longest, MIN_REPEAT, longest), len(documents))
    np.maximum.at(out[:, 2], doc, longest)
    return out


def rules_of(texts: list[str | None]) -> list[dict]:
    """The columns of RULES_TYPE for each text."""
    rows, held, held_words, found = [], [], 0, []
    for text in texts:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")] if "\n" in text else []
        rows.append({"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines))})
        if held and held_words + len(words) > CHUNK_WORDS:
            found.append(repetition(held))
            held, held_words = [], 0
        held.append(words)
        held_words += len(words)
    if held:
        found.append(repetition(held))
    for row, (repeat_words, covered_words, longest) in zip(rows, np.concatenate(found).tolist() if found else [], strict=True):
        n = row["n_words"]
        failed = n < 50 or 100 * repeat_words > 50 * n
        row |= {"n_repeat_words": repeat_words, "covered_words": covered_words, "longest_repeat": longest, "base_failed": failed}
        row["kept"] = not failed and covered_words <= MAX_COVERED * n and longest <= max(MAX_LONGEST, MAX_LONGEST_SHARE * n)
    return rows


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of RULES_TYPE, one task per input split, no shuffle.

    Null and empty texts have no words, so all counts are 0 and kept is false. Repeated rows each get the same
    columns. Columns of df with these names are replaced, at the end; all others stay. An empty table stays empty.
    """

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"boolean": pa.bool_(), "long": pa.int64()}
        fields = [(name, kinds[kind]) for name, kind in (x.split(" ") for x in RULES_TYPE.split(", "))]
        for texts in batches:
            rows = [row for piece in slices(texts, SLICE) for row in rules_of(piece.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in fields], [name for name, _ in fields])

    importable(df.sparkSession)
    judged = F.arrow_udf(judge, RULES_TYPE)
    names = [x.split(" ")[0] for x in RULES_TYPE.split(", ")]
    out = df.select(as_row(df), judged(F.col(text)).alias("rules"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in names], *[F.col(f"rules.{name}").alias(name) for name in names])

