"""Exact duplicates by a tree merge of sorted digest runs. Native: DataFrame functions only.

Each document goes to one of ``runs`` shards by a hash of its id. A shard's run is sorted by digest and holds one
row per digest: the smallest id and the number of documents. In each round ``fan_in`` neighbouring runs become one,
so after log(runs) / log(fan_in) rounds one run is left, spread over the cluster by digest: the runs are exchanged
by (merged run, digest), sorted, and merged from the sorted rows (a sort aggregate: its buffer is a struct, which
Spark can't keep in a hash map, so every round reads sorted runs, on both sides of the exchange). Rows of equal
digest become one that keeps the smallest id. A row's key is the SHA-256 digest together with the length and a
second, independent hash of the text, so an id is only kept for texts that agree in all three, at every level.
The result returns along the runs: a digest held by a third of all documents meets them shard by shard, not in
one task.

Null text is empty text, so null, empty and blank-only texts: the first two are equal, a blank
one is a single space. Rows that repeat an id and a text count each; one of them stays. A null
id is larger than any other. Texts may have any length; an empty table gives an empty result; columns other than
id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, Scratch, text_of

KEY = ["digest", "n_norm", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256) -> DataFrame:
    """(doc_id, shard, digest, n_norm, check): one pass over the texts, no shuffle."""
    norm = F.regexp_replace(text_of(text_col), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("shard"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.length("norm").cast("long").alias("n_norm"),
        F.xxhash64("norm").alias("check"),
    )


def _least(id_: str) -> Column:
    """The smallest id, null last, as a struct."""
    return F.min(F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"))).alias("least")


def merge_runs(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: every ``fan_in`` neighbouring runs are merged into one, sorted by digest."""
    return runs.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int")).groupBy("shard", *KEY).agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = scratch or Scratch(docs.sparkSession)
    each = scratch.keep(digests(docs, id_col, text_col, runs))
    first = each.groupBy("shard", *KEY).agg(_least("doc_id"), F.count(F.lit(1)).alias("group_size"))
    merged, left = first, runs
    while left > 1:
        merged, left = merge_runs(merged, fan_in), -(-left // fan_in)
    merged = merged.select(*KEY, F.col("least.id").alias("keep_id"), "group_size")
    by_run = first.select("shard", *KEY).join(merged, KEY)
    ids = each.groupBy("shard", *KEY, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    out = ids.join(by_run, ["shard", *KEY]).select(
        "doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256"), F.explode(F.expr("sequence(1L, rows)")).alias("copy")
    )
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def op7(spark, sf_dir):
    from tessera.llm.common import table

    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL7 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
