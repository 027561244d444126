"""I-Match fingerprints. Native: DataFrame functions only.

The lexicon holds the terms (runs of letters and digits, lower case) whose document frequency lies
in a band, so whose inverse document frequency does: in at least ``low`` of all rows and in at most
``high`` of all documents. As every document has a mean of T distinct terms, no more than T / low
terms can have a share of ``low``: that bounds the lexicon, which the plan holds as a set.

For the upper bound each group of copies and near copies counts as one document, however large, so it
can't push its own terms out. A group is the rows whose word triples have the same smallest and largest
hash; only groups of at least 1 / GROUPS of the rows (and two) are told apart from single rows, as no smaller
one can move a share by more than that.

A document keeps its distinct lexicon terms, as hashes, sorted. One with fewer than FEW of them is filled up to
FEW with others of its own: terms below the band first, in an order of hashes that near copies share, then those
above it, the rarest first. ``subsets`` randomised lexicons, each keeping one of 16, 64 or
256 terms by a hash, give one hash of the kept terms each; together they are the fingerprint. Large
subsets tell near copies from similar texts, small ones still agree on texts that share a half.

The likeness of two fingerprints is the share of equal hashes among the lexicons in which either
text has terms. A text of which no lexicon keeps a term (an empty or very short one) has a hash of the
whole text instead, so it is like its copies only. Null text is empty. Rows that repeat an id stand next to each other,
ordered by text; a null id comes last. Texts may have any length; an empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of

SUBSETS, FAN = 24, 256
#: SQL of a text's distinct terms, as hashes; {} is the text. The empty string beside a leading separator is no term.
TERMS = r"array_distinct(transform(filter(split(lower({}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''), w -> xxhash64(w)))"

#: A text with fewer lexicon terms is filled up to so many with other terms of its own.
FEW = 16
#: Copy groups of at least one row in so many are counted as one document; ONE is the weight of a document.
GROUPS, ONE = 10_000, 1 << 30
#: SQL of what near copies have in common; {} is the text.
SKETCH = (
    r"transform(transform(array(filter(split(lower({}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')), w -> CASE WHEN size(w) < 3 THEN array(xxhash64(w)) "
    r"ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END), g -> xxhash64(array_min(g), array_max(g)))[0]"
)


def lexicon(docs: DataFrame, text_col: str = "text", low: float = 0.01, high: float = 0.3) -> tuple[list[int], list[int]]:
    """Hashes of the terms in the band, over all documents; and of those above it, the rarest first."""
    n = docs.count()
    texts = docs.select(text_of(text_col).alias("_t")).select("_t", F.expr(SKETCH.format("_t")).alias("_g"))
    groups = {r["_g"]: r["count"] for r in texts.groupBy("_g").count().where(F.col("count") >= max(2, n / GROUPS)).collect()}
    weights = [(g, round(ONE / k)) for g, k in groups.items()]
    total = ONE * (n - sum(groups.values())) + sum(w * groups[g] for g, w in weights)
    if weights:
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(weights, "_g long, _w long")), "_g", "left")
    weight = F.coalesce("_w", F.lit(ONE)) if weights else F.lit(ONE)
    terms = texts.select(weight.alias("w"), F.explode(F.expr(TERMS.format("_t"))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).where(F.col("n") >= low * n).select("term", "w").collect()
    return sorted(r["term"] for r in counts if r["w"] <= high * total), [h for _, h in sorted((r["w"], r["term"]) for r in counts if r["w"] > high * total)]


def fingerprint(text: str, words: list[int], usual: list[int]) -> Column:
    """Of the column ``text``: one hash for each randomised lexicon (null: no term); where none has a term the text's hash in every place."""
    one_of = lambda hashes: f"h IN ({', '.join(map(str, hashes))})" if hashes else "false"
    rare = f"transform(sort_array(transform(filter(array_except(s.t, s.m), h -> NOT {one_of(usual)}), h -> named_struct('o', xxhash64(7, h), 'h', h))), x -> x.h)"
    often = f"filter(cast(array({', '.join(f'{h}L' for h in usual)}) as array<bigint>), h -> array_contains(s.t, h))"
    marks = f"transform(array({TERMS.format(text)}), t -> named_struct('t', t, 'm', filter(t, h -> {one_of(words)})))"
    marks = F.expr(f"transform({marks}, s -> sort_array(CASE WHEN size(s.m) >= {FEW} THEN s.m ELSE concat(s.m, slice(concat({rare}, {often}), 1, {FEW} - size(s.m))) END))")

    def place(k: int, hashes: Column) -> Column:
        bits = (4, 6, 8)[k % 3]
        some = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 5 * k % 56).bitwiseAND((1 << bits) - 1) == 0)
        return F.when(F.size(some) > 0, F.xxhash64(F.lit(k), some))

    # the marks are bound once and read by all lexicons
    places = F.transform(marks, lambda m: F.array(*[place(k, m) for k in range(SUBSETS)]))
    return F.transform(places, lambda p: F.when(F.exists(p, lambda x: x.isNotNull()), p).otherwise(F.array_repeat(F.xxhash64(F.lit(-1), F.sha2(text, 256)), SUBSETS)))[0]


def likeness(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce(x == y, F.lit(False)).cast("int")))
    used = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(used) == 0, F.lit(0.0)).otherwise(F.aggregate(used, F.lit(0), lambda s, x: s + x) / F.size(used).cast("double"))


def written(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit("-"))), ":")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<c> for each column: the next row's by doc_id, after the last the first's.

    Rows are dealt into ranges of doc_id with bounds from approximate quantiles (ids of the data), and each
    range also gets the first rows of the range after it. One shuffle; no task sees all rows.
    """
    n = docs.count()
    parts = max(1, min(n // 500, FAN * FAN))
    shares = ",".join(str(i / parts) for i in range(parts))
    got = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), 20000)"), F.min("doc_id")).first() if n else (None, None)
    bounds = sorted({got[1], *got[0]}) if got[0] else [0]
    rows_ = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]
    firsts = F.from_json(F.lit(json.dumps([r[0] for r in rows_])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(rows_)), "array<array<bigint>>")
    row = F.greatest(F.size(F.filter(firsts, lambda b: b <= F.col("doc_id"))), F.lit(1))
    inner = F.element_at(fine, F.col("_row"))
    last = len(bounds) - 1
    d = docs.withColumn("_row", row).withColumn("_k", F.greatest(F.size(F.filter(inner, lambda b: b <= F.col("doc_id"))), F.lit(1)))
    d = d.withColumn("_bound", F.element_at(inner, F.col("_k"))).withColumn("_range", F.coalesce((F.col("_row") - 1) * FAN + F.col("_k") - 1, F.lit(last)))
    d = d.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.col("_range")))
    here = F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(bounds))).alias("r"), F.lit(True).alias("ghost"))
    first = F.col("doc_id") == F.col("_bound")
    if got[0] is None:  # no ids: one range, its first rows also its last
        first = F.lit(True)
    d = d.withColumn("_at", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))))
    w = Window.partitionBy("_at.r").orderBy("_at.ghost", F.col("doc_id").asc_nulls_last(), "text")
    out = d.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("_at.ghost")).drop("_row", "_k", "_bound", "_range", "_at")


def edited_fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", low: float = 0.01, high: float = 0.3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    words, usual = lexicon(docs, text_col, low, high)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("print", fingerprint("text", words, usual))
    rows = with_next(rows, ["text", "print"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.col("next_text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print", fingerprint("edited", words, usual).alias("edited_print"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op4(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
