"""Token counts, packing and quality rules against the library and brute force."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from ridgeline.llm.packing import Encoder, packed, served, tree_paths
from ridgeline.llm.quality_rules import WORD, quality_rules, repetition, rules_of
from ridgeline.llm.token_counts import Counts, load, token_counts

ODDS = ["", " ", "a", "Über", "naïve's", "é", "é", "́", "İ", "Σας ΣΑΣ", "don't  stop", "\n\n", "\t", "\r\n", " \n ", "\x1c", "\x85", " ", " ", "　", "​", "﻿", "<|endoftext|>", " <|endoftext|>", "<|startoftext|>", "12345", "x1y2", "...", "🙂👍🏽", "中文字", "'LL", "\x00", "ß", "ﬁ", "#*$"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts(n: int) -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(ODDS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), 1) for i, t in enumerate(texts)]


def test_counts_are_the_librarys():
    tokenizer = load(path("byte_bpe_50k.json"))
    texts = odd_texts(4000)
    counts = Counts(tokenizer, {})
    assert counts.of(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counts.of(texts[::-1]) == counts.of(texts)[::-1]


def test_ids_are_the_librarys():
    encoder = Encoder(path("word_bpe_49k.json"))
    texts = odd_texts(4000)
    letters = [chr(c) for c in range(33, 0x250)] + ["a", "E", "É", ".", ",", "!?"]
    r = random.Random(8)
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(6000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.of(pa.array(texts, pa.large_string()))] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, None), (1, "a b"), (1, "a b"), (None, ""), (2, "word " * 3000)], "doc_id long, text string").selectExpr("*", "'x' n_tokens")
    got = {(r.doc_id, r.text): (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, path("byte_bpe_50k.json")).collect()}
    assert got[1, None] == (0, 0, False) and got[None, ""] == (0, 0, False) and got[1, "a b"] == (3, 2, False)
    assert got[2, "word " * 3000][0] == 15000 and got[2, "word " * 3000][2]
    assert token_counts(df.limit(0), path("byte_bpe_50k.json")).count() == 0


def held(pieces, texts, window):
    """Checks that the pieces hold each id once, gapless in documents and windows; the windows' tokens by document."""
    tokenizer = load(path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        piece = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length, p.doc_id))
    for parts in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, n, *_ in sorted(parts):
            assert start == at
            at += n
    assert all(sum(n for _, n in by_doc[i]) == len(x) for i, x in ids.items())
    total = sum(map(len, ids.values()))
    assert sorted(by_sequence) == list(range(-(-total // window)))
    assert all(sum(n for _, n, _ in by_sequence[j]) == window for j in range(total // window))
    return ids, by_sequence


def shares(by_sequence, source):
    """After each window, the tokens of each source so far."""
    so_far, out = {}, []
    for j in sorted(by_sequence):
        for _, n, i in by_sequence[j]:
            so_far[source(i)] = so_far.get(source(i), 0) + n
        out.append(dict(so_far))
    return out


@pytest.mark.parametrize("window", [64, 100])
@pytest.mark.parametrize("tiny", [False, True])
def test_packing_round_trip(spark, window, tiny):
    texts = [None, "", *odd_texts(150), "hello world " * 400, "same", "same"]
    source = (lambda i: "hot" if i % 4 else f"s{i}") if tiny else (lambda i: None if i % 7 == 0 else "hot" if i % 2 else f"s{i % 5}")
    df = spark.createDataFrame(rows(texts, source), SCHEMA).repartition(5)
    ids, by_sequence = held(packed(df, path("word_bpe_49k.json"), window=window).collect(), texts, window)
    total = sum(map(len, ids.values()))
    share = {}
    for i, x in ids.items():
        share[source(i)] = share.get(source(i), 0) + len(x) / total
    deep = math.ceil(math.log2(len(share)))
    for j, so_far in enumerate(shares(by_sequence, source)):
        n = min((j + 1) * window, total)
        assert all(abs(so_far.get(s, 0) - w * n) <= deep for s, w in share.items())


def test_packing_to_targets(spark):
    texts = ["a b c d e f g h i j " * 20] * 30
    source = lambda i: f"s{i % 3}"
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(4)
    ids, by_sequence = held(packed(df, path("word_bpe_49k.json"), window=100, targets={"s0": 0.6, "s1": 0.3, "s2": 0.1}).collect(), texts, 100)
    each = 10 * len(ids[0])
    for j, so_far in enumerate(shares(by_sequence, source)):
        if (j + 1) * 60 <= each:
            assert all(abs(so_far.get(s, 0) - w * (j + 1)) <= 2 for s, w in (("s0", 60), ("s1", 30), ("s2", 10)))
    held(packed(df, path("word_bpe_49k.json"), window=128, targets={"s1": 1}).collect(), texts, 128)


def test_packing_empty(spark):
    assert packed(spark.createDataFrame([], SCHEMA), path("word_bpe_49k.json")).count() == 0


def test_counts_of_sources_never_fall():
    r = random.Random(3)
    for _ in range(40):
        sources = [(str(i), r.choice([1, 2, 30, 500]), r.choice([0, 1, 5, 100])) for i in range(r.randint(1, 9))]
        paths, total = tree_paths(sources), sum(n for _, n, _ in sources)
        before = [0] * len(sources)
        for n in range(total + 1):
            now = [served(n, p) for p in paths]
            assert sum(x for _, x in now) == n and [b for b, _ in now] == [sum(x for _, x in now[:i]) for i in range(len(now))]
            assert all(0 <= x - b <= 1 for (_, x), b in zip(now, before))
            before = [x for _, x in now]
        assert before == [n for _, n, _ in sources]


def brute_rules(text):
    words = WORD.findall(text or "")
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    three, eight = set(), set()
    for i, k in enumerate(longest):
        if k >= 3:
            three.update(range(i, i + 3))
        if k >= 8:
            eight.update(range(i, i + k))
    return n, len(three), len(eight), max(longest, default=0)


def test_rules_against_brute_force():
    r = random.Random(3)
    texts = [None, "", " \n\t", "one", *[" ".join(r.choice("abcd") for _ in range(r.randint(1, 90))) for _ in range(60)], "x " * 120, ("p q r s t u v w x y " * 4 + "tail ") * 2]
    texts += [" ".join(f"w{r.randint(0, 400)}" for _ in range(200)) for _ in range(5)]
    for text, got in zip(texts, rules_of(texts), strict=True):
        assert (got["n_words"], got["n_repeat_words"], got["covered_words"], got["longest_repeat"]) == brute_rules(text)


def test_rules_lines_symbols_and_table(spark):
    df = spark.createDataFrame([(1, "a b\n\na b\n \na b\nc #*"), (2, None), (2, None)], "doc_id long, text string").selectExpr("*", "1 kept")
    got = quality_rules(df).orderBy("doc_id").collect()
    assert (got[0].n_dup_lines, got[0].n_symbols, got[0].n_words, got[0].word_chars) == (2, 2, 8, 9)
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and len(got) == 3
    assert quality_rules(df.limit(0)).count() == 0


def round_robin(sources):
    """Literal deficit round-robin, one token at a time, over a tree of queues: the sources served, in order."""

    def tree(low, high):
        if high - low == 1:
            return {"left": None, "rest": sources[low][1], "name": low}
        middle = (low + high) // 2
        a, b = tree(low, middle), tree(middle, high)
        weight, weights = sum(x[2] for x in sources[low:middle]), sum(x[2] for x in sources[low:high])
        if not weights:
            weight, weights = a["rest"], a["rest"] + b["rest"]
        return {"left": a, "right": b, "rest": a["rest"] + b["rest"], "quantum": weight, "round": weights, "deficit": 0}

    def serve(node):
        node["rest"] -= 1
        if node["left"] is None:
            return node["name"]
        node["deficit"] += node["quantum"]
        turn = "left" if node["deficit"] >= node["round"] else "right"
        if turn == "left":
            node["deficit"] -= node["round"]
        if not node[turn]["rest"]:
            turn = "right" if turn == "left" else "left"
        return serve(node[turn])

    root = tree(0, len(sources))
    return [serve(root) for _ in range(root["rest"])]


def test_the_closed_form_is_deficit_round_robin():
    r = random.Random(4)
    for _ in range(60):
        sources = [(str(i), r.choice([1, 2, 30, 300]), r.choice([0, 1, 5, 100])) for i in range(r.randint(1, 9))]
        paths, so_far = tree_paths(sources), [0] * len(sources)
        for n, of in enumerate(round_robin(sources), 1):
            so_far[of] += 1
            assert [served(n, p)[1] for p in paths] == so_far


def test_ids_of_32_bits(spark, tmp_path):
    from tokenizers import AddedToken

    tokenizer = load(path("word_bpe_49k.json"))
    tokenizer.add_tokens([AddedToken(f"zq{i}", normalized=False) for i in range(20_000)])
    tokenizer.save(large := str(tmp_path / "large.json"))
    texts = [None, "some words zq19999, and zq7 zq18000", "plain words here. " * 50]
    got = packed(spark.createDataFrame(rows(texts), SCHEMA).repartition(2), large, window=64).collect()
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert max(map(max, ids)) >= 1 << 16
    assert sum(p.length for p in got) == sum(map(len, ids))
    assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) for p in got)
    narrow = packed(spark.createDataFrame(rows(["a"]), SCHEMA), path("word_bpe_49k.json"), end_id=70_000).first()
    assert narrow.ids_crc32 == zlib.crc32(np.array([*load(path("word_bpe_49k.json")).encode("a", add_special_tokens=False).ids, 70_000], "<u4").tobytes())


def test_very_long_texts(spark):
    r = random.Random(6)
    words = [f"w{r.randint(0, 5000)}" for _ in range(150_000)]
    texts = [" ".join(words), " ".join(words[:60_000] * 2), "same " * 100_000, "x" * 400_000]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    tokenizer = load(path("byte_bpe_50k.json"))
    assert [x.n_tokens for x in token_counts(df, path("byte_bpe_50k.json")).orderBy("doc_id").collect()] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    held(packed(df, path("word_bpe_49k.json")).collect(), texts, 4096)
    got = quality_rules(df).orderBy("doc_id").collect()
    assert [(x.n_words, x.longest_repeat) for x in got] == [(150_000, got[0].longest_repeat), (120_000, 60_000), (100_000, 99_999), (1, 0)]
    assert got[1].covered_words == 120_000 and got[2].n_repeat_words == 100_000 and got[0].longest_repeat < 8


def test_prefixes_stop_at_the_ends_of_documents():
    same = ["a", "b", "a", "b", "a"]
    assert repetition([same, same, [], ["a"], ["a", "a"]]).tolist() == [[5, 0, 3], [5, 0, 3], [0, 0, 0], [0, 0, 0], [0, 0, 1]]
