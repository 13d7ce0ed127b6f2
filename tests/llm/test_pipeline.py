"""Each stage of the pipeline against a plain version of what it decides, and all of them together."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")

from barline.llm import mixing, quality_classifier  # noqa: E402

from . import helpers as H  # noqa: E402
from .test_operators import labelled, plain_ids, plain_lines  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs, labels, _ = labelled(spark, 120)
    line = "the same closing line stands here"
    more = [(1000 + i, f"own words number {i} {' '.join(f'w{i}x{k}' for k in range(40))}.\n{line}", "en", "t", 1) for i in range(12)]
    more += [(2000, more[0][1].replace("w0x3", "other"), "en", "t", 1), (2001, None, "en", None, None), (2002, "", None, "u", 0), (2003, line, "en", "u", 1)]
    docs.select(*cp.COLUMNS).unionByName(spark.createDataFrame(more, H.SCHEMA)).write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


def rows(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {name: None for name, _ in cp.STAGES}
    for name, stage in cp.STAGES:
        out = cp.written(stage(spark, docs, sf_dir), name)
        seen[name] = (docs, out)
        docs = out
        if name != "packing":
            assert out.columns == list(cp.COLUMNS)

    before, after = seen["quality_classifier"]
    net = quality_classifier.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = Counter(r for r in rows(before) if quality_classifier.score(net, (r[1] or "").encode()) >= quality_classifier.THRESHOLD)
    assert Counter(rows(after)) == want and 0 < sum(want.values()) < before.count()

    before, after = seen["line_dedup"]
    plain = {d: h for d, *_, h in plain_lines([r[:2] for r in rows(before)], 10)}
    got = {r["doc_id"]: r["h"] for r in after.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()}
    assert got == {d: plain[d] for d in got} and {r[0] for r in rows(before)} - set(got) <= {2003}

    before, after = seen["jaccard_join"]
    want = {d for d, _, c in H.classes([r[:2] for r in rows(before)]) if d == c}
    assert sorted(r[0] for r in rows(after)) == sorted(want)
    whole = dict((r[0], r) for r in rows(before))
    assert all(r == whole[r[0]] for r in rows(after))

    before, after = seen["mixing"]
    size, taken, text = Counter(), Counter(), {}
    for d, t, _, s, _ in rows(before):
        size[s] += len(H.words(t))
        text[d] = H.words(t)
    copies = defaultdict(int)
    for d, t, _, s, n in rows(after):
        taken[s] += len(H.words(t))
        copies[d] += 1
        assert H.words(t) == text[d][: len(H.words(t))] and n == len(t)
    order = sorted(size, key=lambda s: (s is None, s))
    goal = mixing.targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
    assert max(copies.values()) <= 2 and all(abs(taken[s] - g) <= 0.5 for s, g in zip(order, goal, strict=True))

    before, after = seen["packing"]
    assert sum(r["length"] for r in after.collect()) == sum(len(x) for x in plain_ids([r[1] for r in rows(before)]))


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns) and cp.ORACLE_SQL is None


def test_run_holds_one_table_of_a_stage_at_a_time(spark, sf_dir, monkeypatch):
    from barline.llm import shared

    from .test_shared import _tables

    before, held = _tables(spark), []

    def watched(stage):
        def run(*a):
            held.append({x.rpartition("-")[0] for x in _tables(spark) - before})
            return stage(*a)

        return run

    monkeypatch.setattr(cp, "STAGES", [(name, watched(stage)) for name, stage in cp.STAGES])
    assert cp.run(spark, sf_dir).count() > 0
    assert held == [set(), *({f"stage-{name}"} for name, _ in cp.STAGES[:-1])] and not shared._open.made


def test_null_and_repeated_ids_keep_their_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30 + k))
    data = [(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(4) + " tail"), (None, text(3) + " tail"), (9, text(5)), (9, text(5)), (None, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in data], H.SCHEMA)
    after = cp.written(cp.near_duplicates(spark, docs, ""), "null-ids")
    want = [(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5)), (None, ""), (None, None)]
    assert Counter((d, t) for d, t, *_ in rows(after)) == Counter(want)

    of, taken = {t: d for d, t in want}, 0
    passes = Counter()
    for d, t, *_ in rows(cp.mixture(spark, after, "")):
        whole = next(x for x in of if x and x.startswith(t))
        assert of[whole] == d
        passes[whole] += 1
        taken += len(H.words(t))
    size = sum(len(H.words(t)) for _, t in want)
    assert taken == round(1.5 * size) and len(passes) == 6 and max(passes.values()) <= 2


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], H.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_pass_over_columns_with_clashing_names(spark, sf_dir):
    docs = H.table(spark)
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(cp.COLUMNS) and out.count() > 0
    assert cp.packing(spark, docs, sf_dir).count() > 0 and cp.quality(spark, docs, sf_dir).columns == list(cp.COLUMNS)


def test_the_mix_shares_its_takes_among_repeated_rows(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in [(1, text(1)), (1, text(1)), (1, text(1)), (None, text(2)), (2, text(3))]], H.SCHEMA)
    out = rows(cp.mixture(spark, docs, ""))
    assert sum(len(H.words(t)) for _, t, *_ in out) == 300 and sum(len(H.words(t)) for d, t, *_ in out if d == 1) <= 240
    assert max(Counter(d for d, *_ in out).values()) <= 6
