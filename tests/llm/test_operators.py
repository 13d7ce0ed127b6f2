"""Each operator against a plain version, on awkward rows, empty tables and clashing columns."""

import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import exact_dedup, jaccard_join, line_dedup, mixing, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, warc
from barline.llm.components import components

from . import helpers as H

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, BYTE_BPE = (str(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return H.table(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return H.table(spark, [])


# 1 suffix-array dedup


def test_cover_has_every_difference():
    d, m = suffix_dedup.COVER, suffix_dedup.PERIOD
    assert {(a - b) % m for a in d for b in d} == set(range(m))
    for i in range(m):
        for j in range(m):
            o = suffix_dedup.OFFSETS[i, j]
            assert (i + o) % m in d and (j + o) % m in d


def test_windows_at_any_two_places_compare_through_the_cover():
    rng = np.random.default_rng(4)
    n, period = suffix_dedup.LENGTH, suffix_dedup.PERIOD
    data = np.tile(rng.integers(0, 2, 400, dtype=np.uint8), 3)
    data[700:] ^= rng.random(500) < 0.01
    places = np.arange(len(data) - n)
    ranks = suffix_dedup.CoverRanks(data, places[np.isin(places % period, suffix_dedup.COVER)], np.zeros(int(np.isin(places % period, suffix_dedup.COVER).sum()), int))
    raw, seen = data.tobytes(), Counter()
    for x in range(0, 900, 7):
        for y in (x + 400, x + 1, x + 393, x):
            if y + n + period < len(data) and raw[x : x + period] == raw[y : y + period]:
                a, b = raw[x : x + n], raw[y : y + n]
                got = int(ranks.compared(np.array([x]), np.array([y]))[0])
                assert got == (a > b) - (a < b)
                seen[got] += 1
    assert len(seen) == 3


def test_suffix_dedup(docs, rows):
    assert H.same(suffix_dedup.suffix_dedup(docs).collect(), H.suffix_dedup(rows))


def test_suffix_dedup_keeps_the_bytes_it_hashes(docs):
    for r in suffix_dedup.suffix_dedup(docs, keep_bytes=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_blocks_do_not_change_the_marks(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(97, 99, 3000, dtype=np.uint8)
    parts = []
    for doc in range(30):
        text = base.copy()
        text[rng.integers(0, len(text), 12)] = 100
        for w in suffix_dedup.pieces([text.tobytes()]):
            for level in range(suffix_dedup.LEVELS):
                _, key, at, first, last = w.dealt(level)
                parts.append(suffix_dedup.runs_of(text, doc, 0, key, at, first, last))
    whole, marks = suffix_dedup.repeated(suffix_dedup.Runs.joined(parts))
    run, column = whole.windows()
    seen, want = set(), []
    for k, x, c in zip(whole.key[run].tolist(), (whole.begin[run] + column - whole.lo[run]).tolist(), column.tolist(), strict=True):
        w = (k, c, whole.data[x : x + suffix_dedup.LENGTH].tobytes())
        want.append(w in seen)
        seen.add(w)
    assert marks.tolist() == want and 0 < sum(want) < len(want)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    assert (suffix_dedup.repeated(suffix_dedup.Runs.joined(parts))[1] == marks).all()


@pytest.mark.parametrize("hot", [1, 3, 20])
def test_suffix_dedup_of_hot_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 8)
    monkeypatch.setattr(suffix_dedup, "RUNS", 40)
    monkeypatch.setattr(suffix_dedup, "KEYS", 200)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 100, n)))
    shared, base = word(260), word(500)
    rows = [(i, word(int(rng.integers(0, 60))) + shared[i % 4 :] + word(40)) for i in range(40)]
    rows += [(100 + i, base[: 20 * i] + "X" + base[20 * i + 1 :]) for i in range(20)]
    rows += [(200, "z" * 900), (201, "ab" * 300), (None, shared), (202, base), (203, base), (204, None), (200, "z" * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert H.same(suffix_dedup.suffix_dedup(docs, hot=hot).collect(), H.suffix_dedup(rows))


def test_suffix_dedup_of_texts_longer_than_a_block(spark):
    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(97, 123, 400_000)))
    rows = [(1, long), (2, long[1000:300_000] + "x" * 5000), (3, "é" * 300 + long[-200:])]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert H.same(got, H.suffix_dedup(rows))


# 2 packing


def plain_ids(texts):
    tok = tokenizers.Tokenizer.from_file(WORD_BPE)
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for t in texts]


def test_word_ids_equal_the_tokenizer():
    texts = ["The,cat. it's IT'S", "ΑΣ \x1c x\x85y\xa0z é İ ß", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "12 3,4 é!! naïve, Éa. ab%%% x.*** y_-z (q) a-b- é,&&&", "", " 　 "]
    assert [np.frombuffer(x, "<u2").tolist() for x in packing.encode(WORD_BPE, texts)] == [x.tolist() for x in plain_ids(texts)]


def test_packing(docs, rows):
    pieces = packing.packed(docs, WORD_BPE, window=64, span_windows=4).collect()
    want = Counter(x.tobytes() for x in plain_ids([t for _, t in rows]))
    n_tokens = sum(len(x) // 4 * k for x, k in want.items())
    assert sum(p["length"] for p in pieces) == n_tokens
    fills = defaultdict(list)
    for p in pieces:
        fills[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in fills.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at and k > 0
            at += k
        assert at == 64 or at < 64 and at & (at - 1) == 0  # no padding at all
    assert sorted(fills) == list(range(n_tokens // 64 + (n_tokens % 64).bit_count()))  # only the last window is short
    by_doc = defaultdict(list)
    unique = {d: t for d, t in rows if [x for x, _ in rows].count(d) == 1}
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for d, t in unique.items():
        ids, at = plain_ids([t])[0], 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)


@pytest.mark.parametrize(("totals", "weights"), [([701, 202, 93, 14, 3], None), ([1, 1, 1, 1], None), ([5, 0, 300], [1, 1, 1]), ([90, 5, 70, 3, 44], [1, 4, 2, 0, 0]), ([40, 80], [3, 2])])
def test_spans_are_the_order_in_which_tokens_are_due(totals, weights):
    spans, w = packing.Spans(totals, 16, 2, weights), weights or totals
    order = sorted((w[s] == 0, Fraction(2 * j + 1, 2 * (w[s] or t)), s) for s, t in enumerate(totals) for j in range(t))
    for p in range(-(-len(order) // 32) + 1):
        part = Counter(s for *_, s in order[: 32 * p])
        assert spans.before(p) == [part[s] for s in range(len(totals))]
    for s, t in enumerate(totals):
        for at in range(t):
            p = spans.of(s, at)
            assert spans.bound(s, p) <= at < spans.bound(s, p + 1)
    filled = Counter()
    for s, t in enumerate(totals):
        for _, k, seq, _ in spans.pieces(s, 0, t) if t else ():
            filled[seq] += k
    assert sorted(filled) == list(range(len(filled))) and sum(filled.values()) == len(order)
    assert sum(k < 16 for k in filled.values()) == (len(order) % 16).bit_count()


def test_windows_hold_the_target_proportions():
    totals = [70_000, 20_000, 9_000, 1_000, 3]
    spans, share = packing.Spans(totals, 128, 8), np.array(totals) / sum(totals)
    taken = np.zeros(len(totals))
    for p in range(-(-sum(totals) // spans.size)):
        upto, begins = (np.array(x) for x in spans.fill(p))
        takes = np.diff(upto, axis=1)
        assert (takes >= 0).all() and ((begins >= 0) & (begins <= 128)).all()
        full = takes.sum(0) == 128
        assert (abs(takes[:, full] - 128 * share[:, None]) < 3).all()
        taken += takes.sum(1)
        assert (abs(taken - spans.size * (p + 1) * share) < 3).all() or p == -(-sum(totals) // spans.size) - 1
    assert taken.tolist() == totals


@pytest.mark.parametrize(("totals", "weights"), [([4000, 12_000], [1, 1]), ([9000, 500, 7000, 3], [1, 4, 2, 0]), ([5, 0, 3000], [1, 1, 1]), ([100, 200], [0, 0])])
def test_windows_hold_given_proportions_until_a_queue_is_empty(totals, weights):
    spans, window = packing.Spans(totals, 64, 4, weights), 64
    taken = np.zeros(len(totals), int)
    for p in range(-(-sum(totals) // spans.size)):
        takes = np.diff(np.array(spans.fill(p)[0]), axis=1)
        for w in takes.T:
            open_ = [s for s in range(len(totals)) if totals[s] - taken[s] > window + 8 and weights[s]]
            if w.sum() == window and len(open_) == sum(1 for s in range(len(totals)) if totals[s] > taken[s] and weights[s]) and open_:
                share = np.array([weights[s] / sum(weights[k] for k in open_) if s in open_ else 0 for s in range(len(totals))])
                assert (abs(w - window * share) < 4).all()
            taken += w
    assert taken.tolist() == totals
    for s, t in enumerate(totals):
        got = [x for x in spans.pieces(s, 0, t)] if t else []
        assert sum(k for _, k, *_ in got) == t
        for at in range(0, t, 97):
            p = spans.of(s, at)
            assert spans.bound(s, p) <= at < spans.bound(s, p + 1)


def test_packing_by_weights(docs, rows):
    pieces = packing.packed(docs, WORD_BPE, window=64, span_windows=4, weights={"s1": 1, "s2": 1, None: 2}).collect()
    assert sum(p["length"] for p in pieces) == sum(len(x) for x in plain_ids([t for _, t in rows]))
    fills = defaultdict(Counter)
    for p in pieces:
        fills[p["sequence_id"]][p["source"]] += p["length"]
    first = fills[min(fills)]
    assert abs(first["s1"] - 16) < 4 and abs(first["s2"] - 16) < 4 and abs(first[None] - 32) < 4 and not first["s3"]


def test_sequences(docs):
    got = packing.sequences(packing.packed(docs, WORD_BPE, window=256)).collect()
    assert all(sum(x["length"] for x in r["parts"]) == r["n_tokens"] <= 256 for r in got)


# 3 mixing


def test_targets_share_out_the_excess():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450) == pytest.approx([200, 83.333333, 166.666667])
    assert mixing.targets([0, 10], [1, 1], 15) == [0, 15]
    assert mixing.targets([], [], 0) == []


def test_split_tree_is_exact_and_repeatable():
    quotas = (1000, 10, 333, 0)
    trees = [mixing.SplitTree(quotas, 7, 5) for _ in range(2)]
    got = [Counter(t.shard(s, b) for s, q in enumerate(quotas) for b in range(q)) for t in trees]
    total = sum(quotas)
    assert got[0] == got[1] == {j: total * (j + 1) // 7 - total * j // 7 for j in range(7)}


def test_blocks_are_permuted():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(x, n, 9, 1) for x in range(n)) == list(range(n))
    got = [mixing.permuted(x, 1000, 9, 1) for x in range(1000)]
    assert abs(np.corrcoef(range(1000), got)[0, 1]) < 0.1 and got != [mixing.permuted(x, 1000, 9, 2) for x in range(1000)]


def test_mixing_equals_a_plain_walk_of_the_streams(spark, docs):
    block, shard_words, seed = 16, 500, mixing.SEED
    data = docs.withColumn("size", mixing.word_count(mixing.text_of())).withColumn("hash", F.xxhash64(F.lit(seed), F.col("doc_id"))).select("doc_id", "source", "size", "hash").collect()
    order = sorted({r["source"] for r in data}, key=lambda s: (s is None, s))
    sizes = [sum(r["size"] for r in data if r["source"] == s) for s in order]
    quotas = [round(t) for t in mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes))]
    blocks = tuple(-(-q // block) for q in quotas)
    tree = mixing.SplitTree(blocks, max(1, -(-sum(quotas) // shard_words)), seed)
    want = Counter()
    for i, s in enumerate(order):
        mine = sorted((r for r in data if r["source"] == s), key=lambda r: (r["hash"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
        stream = [(r["doc_id"], k, p) for p in range(2) for r in mine for k in range(r["size"])][: quotas[i]]
        for x, (d, k, p) in enumerate(stream):
            shard = tree.shard(i, mixing.permuted(x // block, blocks[i], seed, i))
            want[d, s, p, shard, mixing.hashed(seed, shard, i, x // block) >> 1] += 1
    got = Counter()
    out = mixing.mixed(docs, block_words=block, shard_words=shard_words).collect()
    for r in out:
        got[r["doc_id"], r["source"], r["pass"], r["shard"], r["slot"]] += r["words"]
    assert got == want and len({r["shard"] for r in out}) == tree.shards > 3
    places = [(r["shard"], r["slot"]) for r in out]
    assert places == sorted(places)  # shards in turn, each in its shuffled order
    early = [r["pass"] for r in out if r["shard"] < tree.shards // 2]
    assert 0 < sum(early) < len(early)  # repeats lie in early shards too


def test_mixing(docs, rows):
    got = mixing.drawn(docs, block_words=16, shard_words=500).collect()
    again = mixing.drawn(docs, block_words=16, shard_words=500).collect()
    key = lambda r: str(r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted(len(H.words(t)) for _, t in rows) == sorted(r["size"] for r in got)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        n = sum(p["words"] for p in r["pieces"])
        assert n <= 2 * r["size"]
        taken[r["source"]] += n
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    order = sorted(size, key=lambda s: (s is None, s))
    want = mixing.targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
    assert [target[s] for s in order] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)


# 4 n-gram Jaccard join


def test_jaccard_classes(docs, rows):
    assert H.same(jaccard_join.jaccard_classes(docs).collect(), H.classes(rows))


def test_jaccard_near_the_threshold_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 2)
    w = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w[: 40 - i % 12] + [f"x{i}_{k}" for k in range(i % 12)])) for i in range(40)]
    rows += [(100 + i, " ".join(w[i : i + 30])) for i in range(12)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert H.same(got, H.classes(rows))


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHINGLES", 500)
    size = {k: 40 + k for k in range(60)}
    lists = spark.createDataFrame([(0, k) for k in size if k], "leader long, h long")
    nodes = spark.createDataFrame([(k, k, n) for k, n in size.items()], "h long, node long, n long")
    groups, large = jaccard_join.weighed(lists, nodes)
    for linked, away in ((range(1), 0.3), (range(30), 0.3), (range(30), 0.9), (range(60), 0.3)):
        held, met = Counter(), defaultdict(set)
        known = spark.createDataFrame([(0, k, int(k in linked), 0.1 if k in linked else away) for k in size], "leader long, node long, tied int, away double")
        for r in jaccard_join.blocks(groups, large, known).collect():
            held[r["i"], r["j"], r["side"]] += size[r["node"]]
            met[r["i"], r["j"]].add((r["side"], r["node"]))
        assert max(held.values(), default=0) < 500 + 100
        pairs = {(a, b) for (i, j), x in met.items() for s, a in x for t, b in x if a < b and (i == j or s != t)}
        far = away > 0.5
        assert {(a, b) for a in size for b in size if a < b and not (a in linked and b in linked) and not (far and a in linked)} <= pairs
        if len(linked) == 60:
            assert not met


@pytest.mark.parametrize("first_bytes", [0, jaccard_join.FIRST_BYTES])
def test_near_copies_around_a_first_node(spark, monkeypatch, first_bytes):
    monkeypatch.setattr(jaccard_join, "TIE", 3)
    monkeypatch.setattr(jaccard_join, "FIRST_BYTES", first_bytes)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for k in rng.integers(0, 60, int(rng.integers(0, 6))):
            w[k] = f"x{rng.integers(0, 4)}"
        rows.append((i, " ".join(w[int(rng.integers(0, 9)) :])))
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert H.same(got, H.classes(rows)) and len({r["component_id"] for r in got}) > 1


@pytest.mark.parametrize("cross", [False, True])
def test_forest_spans_the_links(cross):
    rng = np.random.default_rng(9)
    for _ in range(30):
        m = int(rng.integers(2, 60))
        base = rng.choice(1 << 40, 200, replace=False).astype(np.uint64)
        sets = [np.unique(np.append(base[: int(rng.integers(20, 200))], rng.choice(1 << 40, int(rng.integers(1, 40))).astype(np.uint64))) for _ in range(m)]
        sides = rng.integers(0, 2, m)
        found = jaccard_join.forest(sets, sides, cross)
        link = lambda a, b: 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - k)
        root, got = list(range(m)), list(range(m))
        for a in range(m):
            for b in range(a):
                if (not cross or sides[a] != sides[b]) and link(a, b):
                    root = [root[a] if x == root[b] else x for x in root]
        for a, b in found:
            assert link(a, b) and (not cross or sides[a] != sides[b])
            assert got[a] != got[b]
            got = [got[a] if x == got[b] else x for x in got]
        assert len({(x, y) for x, y in zip(root, got, strict=True)}) == len(set(root)) == len(set(got))


def test_screen_keeps_all_that_can_link():
    rng = np.random.default_rng(10)
    base = rng.choice(1 << 60, 3000, replace=False).astype(np.uint64)
    sets = [np.unique(np.append(base[: int(rng.integers(1, 3000))], rng.choice(1 << 60, int(rng.integers(0, 300))).astype(np.uint64))) for _ in range(120)]
    ok = jaccard_join.may_link(np.zeros(120), np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets], False)
    for a in range(120):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                assert ok[a] and ok[b]


def test_jaccard_classes_of_groups_with_many_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHINGLES", 150)
    w = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w[: 40 - i % 12] + [f"x{i}_{k}" for k in range(i % 12)])) for i in range(40)]
    rows += [(100 + i, " ".join(w[i : i + 30])) for i in range(12)] + [(1, rows[5][1])]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert H.same(got, H.classes(rows))


def test_counted_shingles_come_back_from_their_gaps():
    rng = np.random.default_rng(4)
    for slots in (np.empty(0, np.uint32), np.array([0, 0, 65534, 131069, 196605, 2**32 - 1], np.uint32), np.sort(rng.integers(0, 1 << 22, 500).astype(np.uint32))):
        assert jaccard_join.unpacked(jaccard_join.packed(slots)).tolist() == slots.tolist()


def test_passages_of_unlike_documents_make_no_lists(spark):
    """Each passage is in 40 of 400 documents: too few to stand out among many, too many for lists that the input does not lengthen."""
    rng = np.random.default_rng(6)
    passages = [" ".join(f"p{k}_{i}" for i in range(12)) for k in range(60)]
    own = lambda i, n: " ".join(f"o{i}_{n}_{k}" for k in range(10))
    rows = [(i, " ".join(f"{own(i, n)} {passages[k]}" for n, k in enumerate(rng.choice(60, 6, replace=False)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, tables = jaccard_join.count_shingles(df)
    assert found.count() == 400 and [int(np.unpackbits(t).sum()) for t in tables] == [60 * 8, 0]
    assert jaccard_join.prefix_lists(df, tables).count() == 0
    copies = [*rows[:40], *((1000 + i, f"{t} and more") for i, t in rows[:20])]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert H.same(got, H.classes(copies))


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(n + 1)} | {(100, 100), (101, 100)}


# 5 line dedup


def plain_lines(rows, least):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    seen = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add((d, t))
    drop = {k for k, v in seen.items() if k and len(v) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = "\n".join(x for x in lines if key(x) not in drop)
        out.append((d, len(lines), sum(key(x) in drop for x in lines), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(docs, rows, least):
    out = line_dedup.line_dedup(docs.withColumns({c: F.lit("clash") for c in ("dropped", "_id", "th")}), min_docs=least)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert H.same(got, plain_lines(rows, least))
    others = [*H.CLASHING, "dropped", "_id"]
    assert {tuple(r) for r in out.select(*others).distinct().collect()} == {("clash",) * len(others)}


def test_line_bitmaps_beyond_one_word(spark):
    rows = [(d, "\n".join(f"line {i}" if i % 3 else f"own {d} {i}" for i in range(200))) for d in range(12)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert H.same(got, plain_lines(rows, 10))


# 6 quality rules


def plain_measures(text):
    w = H.WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if seen[tuple(w[i : i + 3])] > 1}
    real = [x for x in (text or "").split("\n") if H.WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(real) - len(set(real)), len(covered)


def test_quality_measures(docs, rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.quality_rules(docs)
    assert H.same(got.select("doc_id", *names).collect(), [(d, *plain_measures(t)) for d, t in rows])
    passed_by = [c for c in H.CLASHING if c not in ("n_words", "kept")]
    assert {tuple(r) for r in got.select(*passed_by).distinct().collect()} == {("clash",) * len(passed_by)}


def test_no_repeats_in_a_text_of_many_distinct_words(spark):
    doc = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3_000_000)), lambda i: F.concat(F.lit("w"), F.hex(i))), " ").alias("text"))
    got = quality_rules.quality_rules(doc).first()
    assert (got["n_words"], got["n_repeat_words"]) == (3_000_000, 0)


def test_repeats_are_told_by_words_when_hashes_collide(spark, monkeypatch):
    texts = ["a b c d e f g h", "a b c x a b c y b b c", "one two three", "a b c d a b c d a b c", None]
    hashed = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *cols: hashed(F.length(cols[0])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_rules(docs).collect()}
    assert got == {i: plain_measures(t)[-1] for i, t in enumerate(texts)} == {0: 0, 1: 6, 2: 0, 3: 11, 4: 0}


def test_line_rules(spark):
    good = "This line of plain prose says a thing and ends as it should."
    text = "\n".join([good] + [" ".join(f"word{i}{k}" for k in "abcdefghi") + "." for i in range(9)])
    cases = {
        1: text,
        2: "Home | About | Contact | Help\n" * 30 + good,
        3: text.replace(".", ""),
        4: "We use cookies here today.\n" + text,
        5: "!!?? ## ** " * 40,
        6: text.replace(".", ' 3.5 example.com"') + " it is cut short here",
        7: text.replace(".", '.")'),
        8: "Bake each cookie for ten minutes and " + text.replace("\n", " ") + " read the terms of use with care.",
    }
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in sorted(cases)] == [True, False, False, True, False, False, True, True]
    assert got[4]["n_lost_words"] == 5 and got[7]["n_lost_words"] == got[8]["n_lost_words"] == 0
    clean = quality_rules.clean_text(spark.createDataFrame([(4, cases[4] + "\n \n"), (7, cases[7])], "doc_id long, text string"))
    assert {r["doc_id"]: r["clean_text"] for r in clean.collect()} == {4: text + "\n \n", 7: cases[7]}


# 7 token counts


def test_token_counts(docs, rows):
    tok = tokenizers.Tokenizer.from_file(BYTE_BPE)
    want = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    for chunk in (token_counts.CHUNK_CHARS, 300):
        assert H.same(token_counts.token_counts(docs, BYTE_BPE, chunk).collect(), want)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000, "x <|endoftext|>" * 200, "it's\n\n\tall  one's " * 200, "日本語é" * 400, "!" * 900 + "12 " * 900, ("ab" * 400 + " ") * 5])
def test_long_texts_splice_at_common_starts(text):
    tok = token_counts.tokenizer(BYTE_BPE)
    for chunk, overlap in ((200, 80), (500, 70)):
        assert token_counts.count_long(tok, text, chunk, overlap, 20) == len(tok.encode(text, add_special_tokens=False).ids)


# 8 WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in H.CLASHING}).repartition(3)


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 300_000
    rows = [(5, "http://a/\r\nb", "same"), (2, None, "same"), (9, "u", "same"), (1, "u", None), (3, "u", ""), (4, "u", "é\r\n\r\nWARC/1.1"), (7, "u", long), (8, "u", long), (7, "u", long), (None, "u", "same")]
    got = warc.read_pages(warc.write_pages(pages(spark, rows))).drop("url").collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = p != first[h or ""]
        want.append((p, len(raw), warc.digest(raw), "revisit" if again else "response", first[h or ""] if again else None))
    assert H.same(got, want)


def test_small_payloads_are_never_revisits(spark):
    got = warc.read_pages(warc.write_pages(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3)).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def archive(tmp_path, n=600):
    made = list(warc.write_archives(f"file://{tmp_path}/w", iter([warc.record(i, "http://x/", f"<p>page {i} of many</p>".encode() * 20, None, False) for i in range(n)])))
    assert len(made) == 1 and made[0][1] == n
    return bytearray(open(made[0][0].removeprefix("file://"), "rb").read())


def test_archive_has_a_dictionary_frame_first(tmp_path):
    data = archive(tmp_path)
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    assert [r[0] for r in warc.read_archive(io.BytesIO(data))] == list(range(600))


def test_archives_are_dealt_one_to_a_task(spark):
    parts = [warc.write_pages(spark.createDataFrame([(10 * k + i, "u", f"page {k} {i} " * 50) for i in range(5)], "page_id long, url string, html string")) for k in range(6)]
    archives = parts[0]
    for p in parts[1:]:
        archives = archives.union(p)
    each = warc.read_pages(archives).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(each) == 6 and {r["count"] for r in each} == {5}


def test_broken_archives_are_told(tmp_path):
    data = archive(tmp_path)
    for bad in (data[:-3], data[:6], data[: 8 + 100], data[:3], data + b"\x28"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
    flipped = bytearray(data)
    flipped[-10] ^= 255
    with pytest.raises(Exception):  # noqa: B017  the frame's checksum or the record's digest
        list(warc.read_archive(io.BytesIO(flipped)))
    good = warc.record(1, "u", b"body", None, False)
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good[:-4], good.replace(b"body", b"bodi"), good.replace(b"WARC-Date: ", b"X: ")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


# 9 exact dedup


def plain_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return [(d, keep[t or ""], len(groups[t or ""]), d == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda t: F.length(t).cast("long"), lambda t: F.lit(5).cast("long")])
def test_exact_dedup(docs, rows, hashed):
    assert H.same(exact_dedup.exact_dedup(docs, capacity=4, hashed=hashed).collect(), plain_groups(rows))


def test_buckets_split_until_they_fit(spark):
    cells = spark.createDataFrame([(0, 5), (1, 5), (2, 1), (3, 1), (8, 90), (15, 1)], "cell long, n long")
    got = {r["cell"]: (r["depth"], r["bucket"]) for r in exact_dedup.directory_of(cells, 4, 6).collect()}
    assert got == {0: (4, 0), 1: (4, 1), 2: (3, 2), 3: (3, 2), 8: (4, 8), 15: (2, 12)}


def test_index_is_whole_and_in_buckets(docs, rows):
    index = exact_dedup.build_index(docs, capacity=4)
    entries = index.entries.collect()
    assert sum(r["group_size"] for r in entries) == len(rows) and len(entries) == len({t or "" for _, t in rows})
    held = Counter(r["bucket"] for r in entries)
    depth = {r["bucket"]: r["depth"] for r in index.directory.collect()}
    assert set(held) == set(depth) and all(n <= 4 or depth[b] == index.bits for b, n in held.items())
    assert all(r["links"] == 1 for r in entries) and index.chains.isEmpty()


def test_answers_come_from_the_buckets(docs, rows):
    from dataclasses import replace

    index = exact_dedup.build_index(docs, capacity=4)
    whole = exact_dedup.look_up(docs, index)
    one = index.entries.orderBy("bucket").first()["bucket"]
    lost = index.entries.where(F.col("bucket") == one).agg(F.sum("group_size")).first()[0]
    assert whole.count() == len(rows)
    assert exact_dedup.look_up(docs, replace(index, entries=index.entries.where(F.col("bucket") != one))).count() == len(rows) - lost
    assert exact_dedup.look_up(docs, replace(index, directory=index.directory.withColumn("bucket", F.col("bucket") + 1))).count() < len(rows)
    wrong = replace(index, entries=index.entries.withColumn("keep_id", F.lit(-5).cast("long")))
    assert {r["keep_id"] for r in exact_dedup.look_up(docs, wrong).collect()} == {-5}


# 10 quality classifier


def labelled(spark, n=240):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmno"), rng.integers(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(vocabulary, rng.integers(60, 400))
        bad = i % 3 == 0
        rows.append((i, " ".join(w + "%%%" if bad else w for w in words) + ".", "en", "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    return H.table(spark, rows), spark.createDataFrame([*labels, (10**6, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int"), labels


def test_classifier_learns_and_covers_long_texts(spark):
    docs, labels, known = labelled(spark)
    net = quality_classifier.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, net).collect()}
    test = [(i, q) for i, q, _ in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == q for i, q in test]) > 0.9
    good = "plain words here and more of them " * 30
    assert quality_classifier.score(net, (good * 20 + "ab%%% cd%%% ef%%% " * 2000).encode()) < quality_classifier.score(net, (good * 20).encode())


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 1024, 1025, 5000):
        starts = quality_classifier.chunk_starts(n)
        x, own = quality_classifier.chunks_at(bytes(i % 251 for i in range(n)), starts)
        assert (x != quality_classifier.PAD).any() == (n > 0) and len(x) == max(1, math.ceil((n - 64) / 960)) and len(own) == len(x)
        if n:
            assert x[0, 0] == 0 and (n - 1) % 251 in x[-1] and own.sum() >= n - 64


def test_score_equals_a_plain_convolution():
    rng = np.random.default_rng(7)
    net = quality_classifier.Network.fresh(rng)
    net.b2 = 0.3
    for n in (0, 3, 700, 5000, 40_000):
        raw = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        logit = weight = 0.0
        for at in quality_classifier.chunk_starts(n):
            chunk = [*raw[at : at + quality_classifier.CHUNK]]
            fill, own = len(chunk) / quality_classifier.CHUNK, max(1, min(n - at, quality_classifier.CHUNK - quality_classifier.OVERLAP))
            chunk += [quality_classifier.PAD] * (quality_classifier.CHUNK - len(chunk))
            best = np.full(quality_classifier.FILTERS, -np.inf)
            for i in range(len(chunk) - quality_classifier.WIDTH + 1):
                best = np.maximum(best, sum(net.filters[k, chunk[i + k]] for k in range(quality_classifier.WIDTH)))
            hidden = np.maximum(np.append(best, fill) @ net.w1 + net.b1, 0)
            logit += float(hidden @ net.w2 + net.b2) * own
            weight += own
        assert quality_classifier.score(net, raw) == pytest.approx(1 / (1 + math.exp(-logit / weight)), abs=1e-4)


def test_awkward_documents_score(spark, docs, rows):
    _, labels, _ = labelled(spark, 30)
    got = quality_classifier.scored(docs, quality_classifier.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_classifier.scored(docs, None).collect()} == {0.5}


# all


def test_empty_tables(spark, nothing):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        suffix_dedup.suffix_dedup(nothing), packing.packed(nothing, WORD_BPE), mixing.drawn(nothing), mixing.mixed(nothing), jaccard_join.jaccard_classes(nothing),
        line_dedup.line_dedup(nothing), quality_rules.quality_rules(nothing), token_counts.token_counts(nothing, BYTE_BPE), warc.read_pages(warc.write_pages(pages(spark, []))),
        exact_dedup.exact_dedup(nothing), quality_classifier.scored(nothing, quality_classifier.train(nothing, empty)),
    ]
    assert [df.count() for df in made] == [0] * len(made)
