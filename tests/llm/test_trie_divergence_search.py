"""The prefix trie, the divergence audit and the vector search against plain versions, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barline.llm import prefix_trie, source_divergence, vector_search

from . import helpers as H

# 11 conversation prefix trie

TURNS = "conv_id long, turn long, role string, text string"
CLASH = ("depth", "k1", "owned", "len", "block", "share", "words", "n", "doc", "term", "v", "h1", "leaf", "shard")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def conversations():
    rng = random.Random(4)
    say = ["hello there", "", None, "one two  three", "x\ty", "hello there again"]
    rows = []
    for c in [*range(0, 90), 121, 140, 1000, 1003]:
        for t in range(rng.choice([1, 2, 3, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", None]) if t % 2 else "user", say[0] if t == 0 and c % 3 else rng.choice(say)))
    rows += [(7, None, "system", "before all"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "b", "other tie"), (None, 0, "user", "nobody's")]
    rows += [(60, t, "user", "same words" if t % 2 else f"turn {t % 5}") for t in range(10, 60)]
    rows += [(c, t, "user", f"copy {t}") for c in (200, 220, 240, 260) for t in range(5)]
    return rows


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in sorted(paths.items()):
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * len(H.WORD.findall(n[-1][1])) if n else 0
    return [(m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()]


@pytest.mark.parametrize("block", [4096, 3])
def test_trie_equals_the_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations()
    got = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, TURNS).repartition(5))).drop("words").collect()
    want = plain_trie(rows)
    assert H.same(got, want)
    assert {r["conv_id"] for r in got if r["depth"] == 0} == {0} and any(r["n_convs"] > 3 and r["depth"] > 3 for r in got)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], TURNS)).count() == 0


def test_conversation_left_without_turns_is_at_the_root(spark):
    few = next(c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(few, 0, "user", "a b"), (few, 1, "user", "c")], TURNS)).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"], r["ends_sha256"]) for r in got] == [(few, 0, 1, 1, hashlib.sha256(str(few).encode()).hexdigest())]


def test_one_conversation_over_many_ranges(spark):
    rows = [(0, t, "user", f"turn {t} of many") for t in range(3000)] + [(20, t, "user", f"turn {t} of many") for t in range(2500)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(7)).drop("words").collect()
    assert H.same(got, _long_plain())


def _long_plain():
    none, ends = hashlib.sha256(b"").hexdigest(), {2500: b"20", 3000: b"0"}
    return [(0, d, 0 if d else None, 2 if d <= 2500 else 1, int(d < 3000), 1, 4 * min(2500 - d + 1, 2500) if d <= 2500 else 0, hashlib.sha256(ends[d]).hexdigest() if d in ends else none) for d in range(3001)]


def test_ids_are_hashed_over_blocks(monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    ids = list(range(0, 50, 4))
    rows = pa.table({"depth": [1] * len(ids) + [2], "k1": [5] * len(ids) + [0], "k2": [6] * len(ids) + [0], "c": [*ids, 9]})
    blocks = list(prefix_trie._id_blocks(iter(rows.to_batches(max_chunksize=4))))
    got = [r for b in prefix_trie._digests(iter(blocks)) for r in b.to_pylist()]
    want = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), "9")]
    assert [r["ends_sha256"] for r in got] == want and sum(b.num_rows for b in blocks) == -(-len(ids) // 3) + 1


# 12 source divergence audit


def plain_divergence(rows, min_docs, top):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = [((lang or ""), (source or ""), re.findall(source_divergence.TERM, low(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = [t for t, n in df.items() if n >= min_docs]
        count = defaultdict(Counter)
        for x, s, terms in docs:
            if x == lang:
                count[s].update(t for t in terms if df[t] >= min_docs)
        total = Counter()
        for c in count.values():
            total.update(c)
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))
        ps = {s: {t: p(c, t) for t in kept} for s, c in count.items()}
        q = {t: p(total, t) for t in kept}
        for s in count:
            pairs = [(-sum(abs(ps[s][t] - ps[r][t]) for t in kept), r.encode(), r) for r in count if r != s]
            terms = [(q[t] - ps[s][t], t.encode(), t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x, -v, i) for i, (v, _, x) in enumerate(found, 1)]
    return out


def audited():
    rng = random.Random(9)
    vocabulary = ["the", "The", "über", "naïve", "a", "b2b", "zzz", "ﬁ", "日本", "don't", "X-Ray", "rare"]
    rows = [(" ".join(rng.choice(vocabulary[: 4 + 2 * (i % 4)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s2", "s2", None, "ß"])) for i in range(160)]
    return [*rows, (None, "en", "empty"), ("", "en", "empty"), ("only here once", "xx", "s1"), ("only", "xx", "s2"), (None, None, None), rows[0], rows[0], ("the " * 5000, "en", "s1")]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_divergence_equals_the_plain_one(spark, monkeypatch, piece):
    monkeypatch.setattr(source_divergence, "SHARD", 20)
    rows = audited()
    df = clashing(spark.createDataFrame([(t, lang, s) for t, lang, s in rows], "text string, lang string, source string").repartition(4))
    got = source_divergence.source_divergence(df, min_docs=8, top=3).collect()
    want = plain_divergence(rows, 8, 3)
    assert H.same(got, want) and {r["part"] for r in got} == {"pair", "term"}


def test_divergence_without_kept_terms_or_rows(spark):
    schema = "text string, lang string, source string"
    got = source_divergence.source_divergence(spark.createDataFrame([("a b", "en", "x"), (None, "en", None)], schema)).collect()
    assert H.same(got, [("en", "", "pair", "x", 0, 1), ("en", "x", "pair", "", 0, 1)])
    assert source_divergence.source_divergence(spark.createDataFrame([], schema)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(source_divergence, "PIECE", 10)
    text = "aaa bbb ccc dddddddddddddddddddd e f g " * 5
    parts = list(source_divergence.pieces_of(text, 10))
    assert "".join(parts) == text and len(parts) > 5
    assert [t for p in parts for t in re.findall(source_divergence.TERM, p)] == re.findall(source_divergence.TERM, text)
    monkeypatch.setattr(source_divergence, "CHUNK", 30)
    rows = pa.table({"lang": ["en", "en", "de"], "source": ["s", "s", ""], "text": [text, "aaa Aaa", "x" * 99]})
    got = {(r["lang"], r["term"]): (r["n"], r["docs"]) for b in source_divergence._counted(iter(rows.to_batches())) for r in b.to_pylist()}
    assert got["en", "aaa"] == (7, 2) and got["en", "bbb"] == (5, 1) and got["de", "x" * 99] == (1, 1)


# 13 approximate nearest neighbours

VECTORS = "vec_id long, embedding array<float>"


def plain_nearest(rows, k, every):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, x = [i for i, _ in usable], np.array([v for _, v in usable], np.float32).astype(float)
    out = {}
    for i, v in usable:
        if i % every == 0:
            s = np.zeros(len(x))
            for j, c in enumerate(np.float32(v).astype(float)):
                s += c * x[:, j]
            out[i] = sorted((-a, b) for a, b in zip(s.tolist(), ids, strict=True) if b != i)[:k]
    return out


def vectors(n=3000):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 16)) * 0.4).astype(np.float32)
    x[::7] *= 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n + i, rows[5][1]) for i in range(1000)]  # a group of copies
    bad = [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8]
    rows += [(5000 + i, v) for i, v in enumerate(bad)] + [(None, rows[3][1]), rows[40], rows[40], (-20, [-v for v in rows[9][1]])]
    return rows


def test_search_finds_nine_in_ten_and_scores_exactly(spark, monkeypatch):
    for name, value in (("LEAF", 64), ("SHARD", 500), ("QUERIES", 60)):
        monkeypatch.setattr(vector_search, name, value)
    rows = vectors()
    got = vector_search.nearest_vectors(clashing(spark.createDataFrame(rows, VECTORS).repartition(5)), k=10).collect()
    want = plain_nearest(rows, 10, 20)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]]) and r["vec_id"] != r["query_id"]
    assert set(found) == set(want) and all(len(v) == 10 and v == sorted(v) for v in found.values())
    assert sum(len(set(found[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))
    assert all(found[i] == want[i] for i in want if i > 3000)  # copies of one vector: the smallest ids


def test_search_with_few_rows(spark):
    search = lambda rows: [tuple(r) for r in vector_search.nearest_vectors(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect()]
    assert search([]) == [] and search([(0, None), (20, [0.0, 0.0])]) == [] and search([(0, [1.0, 2.0])]) == []
    assert search([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (20, [1.0, 2.0]), (3, [-1.0, 0.0])]) == [(0, 1, 20, 5.0), (0, 2, 1, 1.0), (0, 3, 3, -1.0), (20, 1, 0, 5.0), (20, 2, 1, 1.0), (20, 3, 3, -1.0)]


def test_best_bin_first_opens_every_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    tree = vector_search.fitted(x, 9000, float(np.sqrt((x * x).sum(1).max())))
    leaf = vector_search.leaf_of(tree, x)
    assert set(leaf) <= set(range(tree.leaves)) and tree.leaves > 8
    for found in vector_search.visits(tree, x[:5], tree.leaves):
        assert sorted(found) == list(range(tree.leaves))
    first = np.array([v[0] for v in vector_search.visits(tree, x, 1)])
    assert (first == leaf).mean() > 0.3
