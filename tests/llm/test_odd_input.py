"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: each operator and stage has a defined result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, exact_dedup, imatch, jaccard_join, langid, licenses, mixing, secrets, toxicity

CLASH = ["h", "shard", "n", "digest", "place", "_sha", "_m", "_id", "_h", "_epoch", "_key", "_group", "_drop_id", "_drop_h", "_row", "gram"]
ROWS = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (4, "a  b"), (4, "a  b"), (5, "word other " * 30_000), (None, "x y z"), (None, None), (6, "x y z"), (7, "x y z"), (6, "another text of this id")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.when(F.col("doc_id") > 3, "s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


def ids(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)


ALL = sorted(-1 if i is None else i for i, _ in ROWS)


def model():
    texts = [f"fine words number {i} and {i * 7 % 31} more of them" for i in range(60)] + [f"you grumpflesnort number {i} and wibblezark of {i * 3 % 17}" for i in range(40)]
    return toxicity.fit(texts, np.arange(100) >= 60)


def operators(docs):
    import public_tokenizers

    return {
        "toxicity": lambda: toxicity.toxicity(docs, model()),
        "language": lambda: langid.identify(docs, langid.fit({"aa": ["kal mer tiv ban"], "bb": ["xo quy zin wup"]})),
        "fingerprints": lambda: imatch.edited_fingerprints(docs),
        "bpe": lambda: bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "secrets": lambda: secrets.secrets(docs),
        "exact": lambda: exact_dedup.exact_duplicates(docs),
        "jaccard": lambda: jaccard_join.jaccard_components(docs),
        "mixing": lambda: mixing.mix(docs).taken(),
        "licenses": lambda: licenses.licenses(docs),
    }


@pytest.mark.parametrize("name", ["toxicity", "language", "fingerprints", "bpe", "secrets", "exact", "jaccard", "mixing", "licenses"])
def test_operator(odd, name):
    got = operators(odd)[name]().collect()
    assert ids(got) == ALL
    assert operators(odd.limit(0))[name]().count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if name == "toxicity":
        assert all(0 <= r.score <= 1 for r in got) and by[0][0].score == by[1][0].score and by[4][0] == by[4][1]
    if name == "language":
        assert {r.lang_pred for i in (0, 1, 2) for r in by[i]} == {"und"} and all(0 <= r.score <= 1 for r in got) and by[3][0].lang_pred in ("aa", "bb")
    if name == "fingerprints":
        assert by[0][0].n_chars == 0 and by[0][0].fingerprint == by[1][0].fingerprint and by[4][0].fingerprint == by[4][1].fingerprint
    if name == "bpe":
        assert by[0][0].n_tokens == 0 and by[5][0].decoded == "word other " * 30_000
    if name in ("secrets", "licenses"):
        assert all((r.spans if name == "secrets" else r.licenses) == "" for r in got)
    if name == "exact":
        assert sum(r.kept for r in got) == 6 and {(r.keep_id, r.group_size) for r in by[None]} == {(0, 3), (6, 3)}
    if name == "jaccard":
        assert all(r.component_id is None for r in by[None]) and {r.component_id for r in by[6] + by[7]} == {6} and {r.component_id for i in (3, 4) for r in by[i]} == {3}
        assert sorted(r.n_shingles for r in by[None]) == [0, 1] and by[0][0].component_id == 0
    if name == "mixing":
        assert all(r.taken <= 3 * r.size for r in got) and sum(r.taken for r in got) > 0 and by[0][0].taken == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, loss_from int"
    rows = [(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "a" * 300_000, "x", 1), (1, 1, "assistant", "a" * 300_000, "x", 1), (None, None, None, None, None, None), (2, 0, "assistant", "", "x", 1)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 600_000 and got[None].n_turns == 1 and got[2].loss_chars == 0
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], schema))).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, odd, tmp_path, empty):
    import corpus_pipeline as p

    docs = odd.limit(0) if empty else odd
    spark.createDataFrame([(3, 0, 1), (6, 1, 0), (6, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "tokens" or after.columns == docs.columns
        if empty:
            assert after.count() == 0
        elif name == "exact_dedup":
            assert after.count() == 6
        docs = after


def test_a_second_run_leaves_the_first_ones_tables(spark, tmp_path):
    import corpus_pipeline as p

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(60).write.parquet(f"{tmp_path}/{name}.parquet")
    first = p.run(spark, str(tmp_path))
    second = p.run(spark, str(tmp_path))
    assert first.count() == second.count() > 0


def test_the_pipeline_releases_the_drivers_memory(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p
    from tessera.llm import common

    def resident() -> int:
        pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
        with open(f"/proc/{pid}/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("VmRSS")) // 1024

    held, seen = getattr(common, "release", None), []

    def release(s):
        before = resident()
        held(s)
        seen.append((before, resident()))

    monkeypatch.setattr(common, "release", release, raising=False)
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(60).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() > 0
    # at the start of each stage and on the way through the stage of many tables
    assert len(seen) > len(p.STAGES)
    assert sum(b - a for b, a in seen) > 0
