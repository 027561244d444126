"""Secret scans. Native: DataFrame functions only.

Base patterns find assignments, access keys and hex strings. Beyond them, runs of 16 or more
characters of the key alphabet that contain a digit are judged by two character Markov models (one
of random strings, one of ordinary identifiers; first order, add-half smoothing): a run is a span of
kind ``markov`` if its log-likelihood ratio a transition lies above the threshold and it overlaps
no base span.

Both models are trained on labelled samples of bounded size: random strings made from hashes, and
identifiers made of words of ``sample_docs`` documents (those with the smallest hashes). The
threshold is the 99.9 % quantile of the identifiers' ratios, at least 0.

Positions come from matches that are anchored at the end of the one before: lengths of gaps and
hits add up. Code points count; ends are exclusive. Null text is empty. Rows that repeat an id are
scanned each; the result has a row for every row. Texts may have any length; an empty table gives an empty result;
columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of

#: The contract's patterns. Kinds in the order that ties have.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    # kind, guard that any kept match implies, pattern with the kept value as its inner group
    ("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), ASSIGN),
    ("access", ("akia",), r"(AKIA[A-Z0-9]{14,})"),
    ("hex", r"[0-9a-f]{16}", r"([0-9a-f]{16,})"),
    ("markov", None, r"((?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,})"),
)
LEAST = {"assign": 12, "access": 18, "hex": 16, "markov": 16}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def samples(docs: DataFrame, text_col: str = "text", sample_docs: int = 300, size: int = 4000) -> DataFrame:
    """(text, label): size random strings (1) and about 3 x size identifiers (0)."""
    spark = docs.sparkSession
    raw = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    b64 = F.base64(F.unhex(raw))
    random = spark.range(size).select(
        F.when(F.col("id") % 3 == 0, F.substring(raw, 1, 40)).when(F.col("id") % 3 == 1, F.substring(b64, 1, 40)).otherwise(F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 32)).alias("text"), F.lit(1).alias("label")
    )
    # the smallest hashes first; only the texts that have them, a bounded number, travel
    text = text_of(text_col)
    hashes = [r["h"] for r in docs.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(sample_docs).collect()]
    some = docs.select(text.alias("text")).where(F.xxhash64("text").isin(hashes)).distinct()
    words = some.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,12}"), F.lit(0)))).alias("w")).distinct().orderBy(F.xxhash64("w")).limit(size)
    two = words.select("w", F.lead("w").over(Window.orderBy(F.xxhash64("w"))).alias("v"), F.pmod(F.xxhash64("w"), F.lit(2100)).cast("string").alias("n")).where("v IS NOT NULL")
    names = two.select(F.explode(F.array(F.concat_ws("_", "w", "v", "n"), F.concat("w", F.initcap("v"), "n"), F.concat_ws("-", "w", "v", "n"))).alias("text"), F.lit(0).alias("label"))
    return random.union(names)


def _ratio(text: Column, logs: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions."""
    size = len(ALPHABET)
    # a folded constant, so the plan has one literal and not thousands
    table_ = F.split(F.lit(",".join(f"{x:.4f}" for x in logs)), ",").cast("array<double>")
    at = lambda i: F.position(text.substr(i, F.lit(1)), F.lit(ALPHABET)) - 1
    steps = F.sequence(F.lit(1), F.length(text) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.element_at(table_, at(i) * size + at(i + 1) + 1)) / (F.length(text) - 1)


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """The table of log ratios by pair of characters (bounded by the alphabet) and the threshold."""
    good = labelled.where(F.col("text").rlike("^[A-Za-z0-9+/_=-]{2,}$"))
    pairs = good.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))).alias("pair"))
    size, counts = len(ALPHABET), [[0.5] * len(ALPHABET) ** 2 for _ in (0, 1)]
    place = {c: i for i, c in enumerate(ALPHABET)}
    for r in pairs.groupBy("label", "pair").count().collect():
        counts[r["label"]][place[r["pair"][0]] * size + place[r["pair"][1]]] += r["count"]
    rows = [[sum(c[i * size : (i + 1) * size]) for i in range(size)] for c in counts]
    logs = [math.log(counts[1][i] / rows[1][i // size]) - math.log(counts[0][i] / rows[0][i // size]) for i in range(size * size)]
    bar = good.where("label = 0").select(_ratio(F.col("text"), logs).alias("r")).agg(F.percentile_approx("r", 0.999, 10000)).first()[0]
    return logs, max(0.0, bar or 0.0)


def _guard(text: Column, guard, pattern: str) -> Column:
    """A cheap test that all texts with a kept match pass."""
    if isinstance(guard, tuple):
        # the lower-cased text is bound once for all words
        return F.exists(F.array(F.lower(text)), lambda t: functools.reduce(lambda a, b: a | b, [t.contains(w) for w in guard]))
    return text.rlike(guard) if guard else text.rlike("[0-9]") & text.rlike(pattern)


def _row(order: int):
    def row(x: Column, i: Column) -> Column:
        value = x["hit"] if order == 3 else x["value"]
        return F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("n"), (value if order == 3 else F.lit("")).alias("value"), F.length(value).alias("size"))

    return row


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, kind, value, start, stop) of all matches; key columns doc_id, h."""
    text = F.col("text")
    hits = []
    for order, (kind, guard, pattern) in enumerate(KINDS):
        implied = _guard(text, guard, pattern)
        near = rf"(?s)\G(.*?)({pattern})"
        parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(near), F.lit(i)).alias(n) for i, n in ((1, "gap"), (2, "hit"), (3, "value"))])

        hits.append(F.when(implied, F.transform(parts, _row(order))).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,value:string,size:int>>")))
    each = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h"), F.explode(F.concat(*hits)).alias("m")).select("doc_id", "h", "m.*").distinct()
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("n")).over(w)
    least = F.element_at(F.array(*[F.lit(LEAST[k[0]]) for k in KINDS]), F.col("kind") + 1)
    return each.withColumn("stop", stop).where(F.col("size") >= least).select("doc_id", "h", "kind", "value", (F.col("stop") - F.col("n")).alias("start"), "stop")


def secrets(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    logs, bar = train(samples(docs, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    spans = found(rows).where((F.col("kind") < 3) | (_ratio(F.col("value"), logs) > bar))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    spans = spans.withColumn("span", F.struct("start", "kind", "stop", F.concat_ws(":", name, "start", "stop").alias("said")))
    lists = spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("span")).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    # what the models find is kept where no base span overlaps it
    lists = lists.withColumn("base", base)
    lists = lists.withColumn("all", F.filter("all", lambda s: (s["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))
    joined = lambda c: F.array_join(F.transform(c, lambda s: s["said"]), ",")
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), joined("base").alias("base_spans"), joined("all").alias("spans"), *[F.size(F.filter("all", _of_kind(k))).cast("long").alias(f"n_{x[0]}") for k, x in enumerate(KINDS)])
    out = rows.select("doc_id", F.xxhash64("text").alias("h")).join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{x[0]}", F.lit(0).cast("long")).alias(f"n_{x[0]}") for x in KINDS], F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op6(spark, sf_dir):
    return secrets(table(spark, sf_dir, "documents"))
