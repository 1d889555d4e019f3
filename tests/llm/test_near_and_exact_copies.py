"""SimHash and suffix-array deduplication against brute force."""

import hashlib
import random

import numpy as np
import xxhash

from ridgeline.llm import simhash, suffix_dedup
from ridgeline.llm.simhash import components, dealt_keys, fingerprint, links_of_runs, near_duplicates
from ridgeline.llm.suffix_dedup import Shard, without_repeats

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint():
    r = random.Random(1)
    texts = [None, "", " \t", "One", "one Two", "É é A\x0bb\x85c", *[" ".join(r.choice("aBcDé") * r.randint(1, 3) for _ in range(r.randint(1, 80))) for _ in range(200)]]
    assert [fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_components_against_brute_force(spark):
    r = random.Random(4)
    base = " ".join(f"w{r.randint(0, 5000)}" for _ in range(300)).split()
    texts = [None, "", " ", "same text of ours", "same text of ours", "Same TEXT of ours"]
    for _ in range(260):
        words = list(base if r.random() < 0.7 else [f"x{r.randint(0, 400)}" for _ in range(r.randint(1, 40))])
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"y{r.randint(0, 99)}"
        texts.append(" ".join(words))
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, "same text of ours"), (5000, "entirely on its own"), (5000, "entirely on its own"), (None, "no id anywhere near this")]
    got = near_duplicates(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 fp", "2 root")).collect()
    assert len(got) == len(rows)
    fps = {x: brute_fingerprint(x) for _, x in rows}
    root = brute_components(set(fps.values()))
    first = {}
    for i, t in rows:
        if i is not None:
            first[root[fps[t]]] = min(i, first.get(root[fps[t]], i))
    want = sorted((-1 if i is None else i, fps[t], first.get(root[fps[t]], -1)) for i, t in rows)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.fp % 2**64, -1 if x.component_id is None else x.component_id) for x in got) == want
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_no_link_is_lost_in_dense_and_split_runs():
    r = random.Random(6)
    centre = r.getrandbits(64)
    fps = {centre}
    for _ in range(1500):
        x = r.choice([centre, r.getrandbits(64)])
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    import pyarrow as pa

    fps = np.array(sorted(fps), np.uint64)
    keys = list(simhash.keyed([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])]))
    key, fp = (np.concatenate([b[c].to_numpy() for b in keys]) for c in ("key", "fp"))
    order = np.lexsort((fp, key))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[order][i : i + 700]), pa.array(fp[order][i : i + 700])], ["key", "fp"]) for i in range(0, key.size, 700)]
    links = {(u % 2**64, v % 2**64) for b in simhash.links_of_runs(iter(batches)) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist())}
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {f: f for f in fps.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {f: find(f) for f in root} == brute_components(fps.tolist())


def test_split_keys_lose_no_links(spark):
    r = random.Random(14)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = set(base)
    for _ in range(700):
        x = r.choice(base)
        for _ in range(r.randint(0, 9)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(fps)
    for hot_key in (5, 60, 2_000):
        keys = dealt_keys(df, hot_key)
        found = components(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(links_of_runs, "u long, v long")).collect()
        root = {x: x for x in signed} | {x.node: x.root for x in found}
        groups, wanted = {}, {}
        for x in signed:
            groups.setdefault(root[x], set()).add(x % 2**64)
            wanted.setdefault(want[x % 2**64], set()).add(x % 2**64)
        assert set(map(frozenset, groups.values())) == set(map(frozenset, wanted.values())) and 3 <= len(groups) < len(fps)
    assert keys.count() == 24 * len(fps) < dealt_keys(df, 5).count()


def test_very_long_texts(spark):
    r = random.Random(15)
    words = [f"w{r.randint(0, 9000)}" for _ in range(150_000)]
    texts = [" ".join(words), " ".join(words) + " more", "same " * 200_000, " ".join(words[40_000:90_000]), "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {x.doc_id: (x.fp % 2**64, x.component_id) for x in near_duplicates(df).collect()}
    assert [got[i][0] for i in range(5)] == list(map(brute_fingerprint, texts))
    root = brute_components({x for x, _ in got.values()})
    assert [got[i][1] for i in range(5)] == [min(j for j in range(5) if root[got[j][0]] == root[got[i][0]]) for i in range(5)]
    kept = {x.doc_id: x for x in without_repeats(df).collect()}
    assert [kept[i].n_removed for i in (1, 2, 3, 4)] == [len(texts[0]), len(texts[2]), len(texts[3]), len(texts[4])]
    assert [kept[i].n_passage_words for i in range(5)] == [150_000, 150_000, 200_000, 50_000, 0]


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(r):
    noise = lambda n: "".join(r.choice("abé ") for _ in range(n))
    passages = [noise(r.randint(60, 200)) for _ in range(4)]
    texts = [None, "", "short", "a" * 500, "ab" * 300, noise(3000)]
    for _ in range(60):
        texts.append("".join(r.choice([*passages, noise(r.randint(0, 120))]) for _ in range(r.randint(1, 7))))
    return [*texts, texts[-1], texts[-2]]


def test_repeats_against_brute_force(spark):
    for seed, length, shard, frequent in ((1, 40, 4_000_000, 1000), (2, 64, 3_000, 1000), (3, 16, 2_000, 3), (4, 100, 9_000, 1), (5, 60, 2_000, 5)):
        texts = made_texts(random.Random(seed))
        df = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "1 k1", "2 spans")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in without_repeats(df, length=length, shard_bytes=shard, frequent=frequent).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def brute_passages(texts, passage):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - passage + 1):
            seen[tuple(w[i : i + passage])] = seen.get(tuple(w[i : i + passage]), 0) + 1
    return [sorted({k for i in range(len(w) - passage + 1) if seen[tuple(w[i : i + passage])] > 1 for k in range(i, i + passage)}) for w in words]


def made_passages(r):
    """Passages of short and long words, whole and changed, among words that few texts share."""
    word = lambda: r.choice(["a", "b", "é", "on", "of", "thing", "x" * r.randint(1, 30)])
    passages = [[word() for _ in range(r.randint(8, 60))] for _ in range(5)]
    texts = [None, "", "few words", "la " * 90, "x" * 2000, " \n".join(passages[0]), "\t".join(passages[0]), " ".join(["same"] * 40 + ["x" * 5000] + ["same"] * 40)]
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 6)):
            part = list(r.choice([*passages, [word() + str(r.random()) for _ in range(r.randint(0, 30))]]))
            if part and r.random() < 0.3:
                part[r.randrange(len(part))] = "changed"
            words += part
        texts.append("".join(w + r.choice([" ", "  ", "\n"]) for w in words))
    return texts


def test_passages_of_words_against_brute_force(spark):
    for seed, passage, shard, frequent in ((1, 10, 4_000_000, 1000), (2, 25, 1_500, 2), (3, 50, 9_000, 1), (4, 1, 1_500, 5)):
        texts = made_passages(random.Random(seed))
        df = spark.createDataFrame(list(enumerate(texts)), DOCS)
        got = {r.doc_id: r for r in without_repeats(df, length=90, shard_bytes=shard, frequent=frequent, passage=passage).collect()}
        covered = [[k for x in got[i].passages for k in range(x.low, x.high)] for i in range(len(texts))]
        assert covered == brute_passages(texts, passage) and any(covered)
        assert [got[i].n_passage_words for i in range(len(texts))] == list(map(len, covered))
        assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, hashlib.sha256(got[i].kept).hexdigest()) for i in range(len(texts))] == brute_repeats(texts, 90)


def test_a_passage_shorter_than_the_bytes_that_go(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(55)]
    texts = [" ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))]) for _ in range(3)] + [" ".join(word() for _ in range(120))]
    got = without_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id").collect()
    assert [(x.n_removed, x.n_passage_words, [tuple(y) for y in x.passages]) for x in got] == [(0, 55, [(40, 95)])] * 3 + [(0, 0, [])]


def test_repeated_rows_and_missing_ids(spark):
    text = "one and the same text of some length, " * 20
    other = " ".join(map(str, range(300)))
    rows = [(1, text), (1, text), (2, other), (None, other + "x"), (None, "y" + "".join(map(chr, range(33, 900))))]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in without_repeats(spark.createDataFrame(rows, DOCS)).collect()]
    n, m = len(text), len(other)
    assert sorted(got, key=str) == sorted([(1, n, n), (1, n, n), (2, m, m), (None, m + 1, m), (None, len(rows[4][1].encode()), 0)], key=str)
    assert without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_merge_by_binary_search():
    r = random.Random(9)
    passage = bytes(r.choice(b"ab") for _ in range(300))
    parts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 90))) + passage[r.randint(0, 60) : r.randint(150, 300)] for _ in range(40)]
    counts = [len(p) - 49 for p in parts]
    shards = [Shard(parts[i : i + 10], counts[i : i + 10], 50) for i in range(0, 40, 10)]
    for s in shards:
        for t in shards:
            if s is not t:
                s.merge(t)
    seen = {}
    for p in parts:
        for i in range(len(p) - 49):
            seen[p[i : i + 50]] = seen.get(p[i : i + 50], 0) + 1
    want = [seen[p[i : i + 50]] > 1 for p in parts for i in range(len(p) - 49)]
    assert np.concatenate([s.repeated for s in shards]).tolist() == want and any(want) and not all(want)


def test_a_hot_hash_is_split_wherever_it_begins(monkeypatch):
    import pyarrow as pa

    r = random.Random(10)
    passage = bytes(r.choice(b"ab") for _ in range(200))
    sizes = []

    class Sized(Shard):
        def __init__(self, parts, counts, length, words):
            sizes.append(sum(map(len, parts)))
            super().__init__(parts, counts, length, words)

    monkeypatch.setattr(suffix_dedup, "Shard", Sized)
    for before in ([], [1], [1, 1, 2, 3], [1] * 30):
        rows = [(h, k, bytes(r.choice(b"cd") for _ in range(80))) for k, h in enumerate(before)]
        rows += [(5, 100 + k, bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) + passage[r.randint(0, 60) : r.randint(130, 200)]) for k in range(60)]
        rows += [(6, 200, b"ef" * 40)]
        columns = [[h for h, *_ in rows], [d for _, d, _ in rows], [len(x) - 49 for *_, x in rows], [x for *_, x in rows]]
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["h", "digest", "n", "bytes"])
        sizes.clear()
        got = set()
        for out in suffix_dedup.repeated_spans(iter([batch.slice(i, 7) for i in range(0, batch.num_rows, 7)]), 50, 50, 1000):
            got |= {(x["digest"], i) for x in out.to_pylist() for i in range(x["low"], x["high"])}
        seen = {}
        for *_, x in rows:
            for i in range(len(x) - 49):
                seen[x[i : i + 50]] = seen.get(x[i : i + 50], 0) + 1
        assert got == {(d, i) for _, d, x in rows for i in range(len(x) - 49) if seen[x[i : i + 50]] > 1} and got
        assert max(sizes) <= 1000 + 240
