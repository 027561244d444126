"""A corpus pipeline: toxicity, exact duplicates, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written before the
next stage starts, so a stage drops the scratch tables of the one before. All but the last return
the columns of ``documents``. The stages run some hundred queries in one driver, whose unused
memory is given back on the way.

Null ids: the toxicity, exact and near stages keep such rows like others (a null id is the
largest). Empty tables pass through as empty tables. Extra columns pass through unchanged, whatever
their names. Texts may have any length.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from tessera.llm.common import Scratch, free, table

#: The scratch tables of the stage before, by run (stages that are called alone: by folder).
_last: dict[object, Scratch] = {}
_run: ContextVar[object] = ContextVar("run", default=None)


def _fresh(spark: SparkSession, sf_dir: str) -> Scratch:
    key = _run.get() or sf_dir
    if key in _last:
        _last.pop(key).drop()
    _last[key] = Scratch(spark, lean=True)
    return _last[key]


def _without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """docs less the (id, hash) rows of ``drop``."""
    id_, h = free(docs, "_drop_id", "_drop_h")
    marks = drop.select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct()
    return docs.join(marks, docs["doc_id"].eqNullSafe(marks[id_]) & (F.xxhash64(docs["text"]) == marks[h]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches the bar of the toxicity operator go. Rows of one id and text share a score."""
    scratch = _fresh(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    both = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("_row"), "text")
    scores = scratch.keep(toxicity.toxicity(both, model, id_col="_row"))
    return _without(docs, scores.where(F.col("score") >= toxicity.KEEP).select("doc_id.doc_id", "doc_id.h"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space folded) the row with the smallest id stays; of rows that repeat an id and a text, one."""
    scratch = _fresh(spark, sf_dir)
    out = exact_dedup.exact_duplicates(docs, scratch=scratch)
    id_, sha_ = free(docs, "_id", "_sha")
    gone = out.where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_))
    kept = out.where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_))
    # most rows stay, so only those that go are looked up; rows with a twin of the same id are looked at one by one
    twins = scratch.keep(gone.join(kept, gone[id_].eqNullSafe(kept[id_]) & (gone[sha_] == kept[sha_]), "left_semi").distinct())
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), exact_dedup.SPACE, " "), 256)
    gone = gone.join(twins, gone[id_].eqNullSafe(twins[id_]) & (gone[sha_] == twins[sha_]), "left_anti").distinct()
    rest = docs.join(gone, docs["doc_id"].eqNullSafe(gone[id_]) & (sha == gone[sha_]), "left_anti")
    if twins.isEmpty():
        return rest
    is_twin = rest["doc_id"].eqNullSafe(twins[id_]) & (sha == twins[sha_])
    single, several = rest.join(twins, is_twin, "left_anti"), rest.join(twins, is_twin, "left_semi")
    return single.unionByName(several.withColumn(sha_, sha).dropDuplicates(["doc_id", sha_]).drop(sha_))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by similarity of 0.8 on five-word shingles stays, the one with the smallest id. Rows are told apart by id and text."""
    scratch = _fresh(spark, sf_dir)
    key, group = free(docs, "_key", "_group")
    docs = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")))
    groups = scratch.keep(jaccard_join.jaccard_components(docs, id_col=key, words=5, percent=80, scratch=scratch))
    # groups may be large, so rows are joined by their own key only
    linked = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(key), F.col("component_id").alias(group))
    members = scratch.keep(linked.union(linked.select(group, group)).distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("key"))).alias("f")
    stay = docs.select(key, "doc_id").join(members, key).groupBy(group).agg(first).select(F.col("f.key").alias(key))
    gone = scratch.keep(members.select(key).join(stay, key, "left_anti"))
    rest = docs.join(gone, key, "left_anti")
    twins = scratch.keep(groups.where("n_shingles > 0").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key))
    if not twins.isEmpty():
        rest = rest.join(twins, key, "left_anti").unionByName(rest.join(twins, key, "left_semi").dropDuplicates([key]))
    return rest.drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes: a row for each document and epoch."""
    return mixing.mixed_documents(docs, scratch=_fresh(spark, sf_dir))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each row."""
    import public_tokenizers

    _fresh(spark, sf_dir)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: The first stage's classifier is trained, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage returned is kept until the process ends, in the shared folder, with the last stage's scratch tables."""
    docs, kept, token = table(spark, sf_dir, "documents"), Scratch(spark), _run.set(object())
    try:
        for k, (_, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = kept.keep(out)
        return out
    finally:
        _run.reset(token)
