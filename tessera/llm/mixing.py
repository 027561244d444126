"""Mixing sources to target weights. Native: DataFrame functions only.

1. Sizes: words per document, then per source. Targets share all words by weight; a target
   stops at ``most`` times its source's size and the excess is shared again by weight.
2. Packing: a source's documents stand in a fixed pseudorandom order, one after the other, and
   are cut into blocks of ``block`` words; a document lies on one or more blocks.
3. Draws: source s gets K_s = round(target / mean block size) of all N output slots. The counts
   of the output shards are multinomial draws under the condition that they add up to K_s
   (plain multinomial draws would miss the targets by their own noise): slot j takes place
   p(j) of a pseudorandom permutation p of all slots, and the places belong to the sources
   by cumulative K_s. ``shard_counts`` shows the draw of each shard.
4. Indices: the k-th draw of source s is block q(k mod n_s) of epoch k div n_s, where q is a
   pseudorandom permutation of the n_s blocks, another one for each source and epoch. So no
   block is taken a second time before all were taken once, and none more than ``most`` times.
5. Blocks and slots are joined by (source, index).

The permutations are "swap-or-not" shuffles (Hoang, Morris, Rogaway 2012), which need no sort
and work for any number of places. Prefix sums run over buckets of about 4,096 documents, so a
source with a third of all rows is not one task.

Null text has size 0, as have empty and blank texts; those take nothing. Null source is a
source, the last one. Rows that repeat an id are documents of their own. Texts may have any length.
An empty table gives an empty result. Columns other than id, text and source are not read; ``mixed_documents``
passes them through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, free, table, text_of

ROUNDS = 8
CELLS = 4096


def permute(i: str, n: str, key: list[str], seed: int) -> Column:
    """The place of i in a pseudorandom permutation of 0 .. n-1, one for each key.

    One aggregate over the rounds: nested columns would double the plan with every round.
    """
    m = F.greatest(F.col(n).cast("long"), F.lit(1).cast("long"))
    keys = [F.col(c) for c in key]

    def turn(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *keys), m) + m - x, m)
        return F.when(F.xxhash64(F.lit(seed + 1), r, *keys, F.greatest(x, y)) >= 0, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col(i).cast("long"), turn)


@dataclass
class Mix:
    """docs: rid, doc_id, h, source_id, size, start (word offset in its source). sources: one row each.
    draws: shard, slot, source_id, epoch, block. pieces: rid, doc_id, h, source_id, size, block, w_from, w_to (words of the document)."""

    docs: DataFrame
    sources: DataFrame
    draws: DataFrame
    pieces: DataFrame

    def shard_counts(self) -> DataFrame:
        return self.draws.groupBy("shard", "source_id").count()

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per document."""
        times = self.draws.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("times"))
        got = (
            self.pieces.join(times, ["source_id", "block"])
            .groupBy("bucket", "rn")
            .agg(F.sum((F.col("w_to") - F.col("w_from")) * F.col("times")).alias("taken"))
        )
        return (
            self.docs.select("bucket", "rn", "doc_id", "source_id", "size")
            .join(got, ["bucket", "rn"], "left")
            .join(self.sources.select("source_id", "source_size", "target"), "source_id")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
        )


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) to source_id (by code point, null last), weight and target. One row per source, so one window over all is small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("source_id", (F.row_number().over(by_name) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "source_id")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double"))
    share = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("share", share)
    # sources by rising cap per weight: all are at their cap up to the first that the rest's share does not fill
    s = s.withColumn("water", F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "source_id", "share"))).over(Window.partitionBy(F.lit(0))))
    target = F.when(F.col("water").isNull() | (F.struct("level", "source_id") < F.struct("water.level", "water.source_id")), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("water.share"), F.col("cap")))
    return s.select("source", "source_id", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", block: int = 32, most: int = 3, weights=(1, 2, 3), shards: int = 1024, seed: int = 20, scratch: Scratch | None = None) -> Mix:
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    each = scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(text_of(text_col)).alias("h"),
            F.size(F.regexp_extract_all(text_of(text_col), F.lit(WORD), F.lit(0))).cast("long").alias("size"),
        )
    )
    buckets = max(1, each.count() // 4096)
    sources = targets(each.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block))
    draws_of = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * most)).otherwise(F.lit(0).cast("long"))
    by_id = Window.orderBy("source_id")
    sources = sources.withColumn("draws", draws_of).withColumn("draws_to", F.sum("draws").over(by_id)).withColumn("draws_from", F.col("draws_to") - F.col("draws"))
    sources = scratch.keep(sources)

    # offsets: within a bucket, of the bucket in its source
    named = each.join(sources.select(F.col("source").alias("s_source"), "source_id"), F.col("source").eqNullSafe(F.col("s_source")))
    named = named.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h", "size"), F.lit(buckets)))
    order = Window.partitionBy("bucket").orderBy("source_id", "doc_id", "h", "size")
    inner = Window.partitionBy("bucket", "source_id").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("rn", F.row_number().over(order)).withColumn("upto", F.sum("size").over(inner))
    sums = named.groupBy("source_id", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.select("source_id", "bucket", (F.sum("sum").over(Window.partitionBy("source_id").orderBy("bucket")) - F.col("sum")).alias("base"))
    placed = scratch.keep(named.join(sums, ["source_id", "bucket"]).select("bucket", "rn", "doc_id", "h", "source_id", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start")))

    end = F.col("start") + F.col("size")
    pieces = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    pieces = pieces.select(
        "bucket", "rn", "doc_id", "h", "source_id", "size", "block",
        (F.greatest(F.col("block") * block, F.col("start")) - F.col("start")).alias("w_from"),
        (F.least((F.col("block") + 1) * block, end) - F.col("start")).alias("w_to"),
    )

    n = sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    per_shard = max(1, -(-n // shards))
    slots = spark.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / per_shard).alias("shard"), F.lit(n).alias("n"))
    slots = slots.withColumn("place", permute("slot", "n", [], seed))
    # the source of a place: equal cells of places, each joined to the sources that reach into it
    wide = max(1, -(-n // CELLS))
    cells = sources.where("draws > 0").select("source_id", "blocks", "draws_from", "draws_to", F.explode(F.sequence(F.floor(F.col("draws_from") / wide), F.floor((F.col("draws_to") - 1) / wide))).alias("cell"))
    found = slots.withColumn("cell", F.floor(F.col("place") / wide)).join(cells, "cell").where("place >= draws_from AND place < draws_to")
    found = found.withColumn("k", F.col("place") - F.col("draws_from")).withColumn("epoch", F.floor(F.col("k") / F.col("blocks"))).withColumn("within", F.col("k") % F.col("blocks"))
    draws = found.select("shard", "slot", "source_id", "epoch", permute("within", "blocks", ["source_id", "epoch"], seed + 7).alias("block"))
    return Mix(placed, sources, draws, pieces)


def mixed_documents(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """The mix as rows of ``docs`` with doc_id, text and n_chars: one row per document and epoch that takes words of it.

    A row that takes the whole document has its text unchanged; else the taken words, joined by
    single spaces. Rows equal in id and text share what the first of them got.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    m = mix(docs, scratch=scratch, **options)
    span = m.pieces.join(m.draws.select("source_id", "block", "epoch"), ["source_id", "block"])
    spans = span.groupBy("doc_id", "h", "size", "bucket", "rn", "epoch").agg(F.sort_array(F.collect_list(F.struct("w_from", "w_to"))).alias("spans"), F.sum(F.col("w_to") - F.col("w_from")).alias("got"))
    spans = spans.groupBy("doc_id", "h", "epoch").agg(F.min_by(F.struct("spans", "got", "size"), F.struct("bucket", "rn")).alias("_m"))
    id_, h, epoch, m_ = free(docs, "_id", "_h", "_epoch", "_m")
    spans = spans.select(F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("epoch").alias(epoch), F.col("_m").alias(m_))
    # the words are found once for all spans of a row
    words = F.array(F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)))
    cut = F.transform(words, lambda w: F.array_join(F.flatten(F.transform(F.col(f"{m_}.spans"), lambda s: F.slice(w, (s["w_from"] + 1).cast("int"), (s["w_to"] - s["w_from"]).cast("int")))), " "))[0]
    out = docs.join(spans, docs["doc_id"].eqNullSafe(spans[id_]) & (F.xxhash64(text_of()) == spans[h]))
    text = F.when(F.col(f"{m_}.got") == F.col(f"{m_}.size"), F.col("text")).otherwise(cut)
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def op9(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).taken()
