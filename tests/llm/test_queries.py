"""Registered queries against their SQL on the smallest tables, where they are at hand."""

import os
import zlib
from collections import Counter, defaultdict

import pytest

from barline.llm import mixing, queries

from . import helpers as H
from .test_operators import BYTE_BPE, plain_ids, tokenizers

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    want = sorted(str(r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1_equals_brute_force(spark, documents):
    got = [tuple(r)[:5] for r in run(spark, "op1_suffix_dedup")]
    assert H.same(got, H.suffix_dedup([r[:2] for r in documents])) and sum(r[2] for r in got) > 0


def test_op2_packs_every_token_once(spark, documents):
    pieces, fills = defaultdict(list), defaultdict(list)
    for r in run(spark, "op2_packing"):
        pieces[r["doc_id"]].append(r)
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc, *_), ids in zip(documents, plain_ids([t for _, t, _ in documents]), strict=True):
        at = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    assert not pieces
    for parts in fills.values():
        end = 0
        for o, k in sorted(parts):
            assert o == end
            end += k
        assert end <= 2048 and (end == 2048 or end & (end - 1) == 0)


def test_op3_takes_its_targets(spark, documents):
    size = Counter()
    for _, t, s in documents:
        size[s] += len(H.words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, mixing.targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values())), strict=True))
    known, taken = {d: (len(H.words(t)), s) for d, t, s in documents}, Counter()
    got = run(spark, "op3_mixing")
    for r in got:
        n, s = known[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, size[s]) and r["target"] == pytest.approx(goal[s]) and 0 <= r["taken"] <= 2 * n
        assert sum(x["words"] for x in r["pieces"]) == r["taken"]
        taken[s] += r["taken"]
    assert len(got) == len(documents) and all(abs(taken[s] - goal[s]) <= 0.5 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, "op3_mixing")))


def test_op7_counts_as_the_tokenizer(spark, documents):
    tok = tokenizers.Tokenizer.from_file(BYTE_BPE)
    want = [(d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, _ in documents]
    assert H.same([tuple(r) for r in run(spark, "op7_token_counts")], want)


def test_op10_scores_every_row_and_holds_its_fold_out(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op10_quality_classifier")}
    assert set(got) == {d for d, *_ in documents}
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_rows_without_an_id_cost_what_others_do(spark):
    """Many different texts under one id, or none, are one row each in every join."""
    from barline.llm.jaccard_join import texts_of

    texts = [f"{i} words of a text number {i}" for i in range(300)]
    for own in (None, 7):
        docs = spark.createDataFrame([(own, t) for t in texts], "doc_id long, text string")
        some = spark.sql(f"SELECT {2**63 - 1 if own is None else own}L AS doc_id, xxhash64('{texts[5]}') AS th, 'node' AS node")
        assert [(r["node"], bytes(r["raw"]).decode()) for r in texts_of(docs, some).collect()] == [("node", texts[5])]
