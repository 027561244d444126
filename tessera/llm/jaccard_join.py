"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's row holds the hashes of its distinct word n-grams. Documents with equal rows become
one class, whose smallest id stands for it. Pairs of classes with Jaccard similarity of at least
``percent`` / 100 are found exactly:

1. A count-min sketch of fixed size gives every n-gram a frequency estimate. All rows are sorted
   by (estimate, hash): rare n-grams first.
2. Rows of sizes x and y can only reach the similarity if they overlap in
   ceil(percent * (x + y) / (100 + percent)) n-grams; so they meet in the first
   x - ceil(percent * x / 100) + 1 columns of each. Only these prefixes enter the product.
3. The columns are dealt out in blocks. Within a column, pairs are discarded whose sizes differ
   too much, or whose remaining columns can't reach the overlap any more; and so are single
   entries that no partner of their column could make a pair with.
4. Of the remaining pairs a bitmap of each row, about a bit for each n-gram, bounds the overlap from above;
   the full rows of those that pass are intersected, and pairs below the bound discarded.

A column (of near copies of one text, say) isn't expanded into all pairs at once: as components
are what is asked for, its documents are first compared with the column's leader, the one with the
fewest rarer n-grams; linked documents share a component and need no further comparison, and no
pair is verified twice. Further leaders come from those outside the first one's component. After
``star_rounds`` rounds of this all pairs of different components that are left in any column are
compared, so no link between components is lost whatever the leaders were.

Texts without words have an empty row and no links; texts of fewer than ``words`` words have one
n-gram, all of them. Null text is empty. Rows that share an id are one node and have one component.
Rows without an id have their number of n-grams, no links and a null component. Texts may have any
length; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, ship, table, text_of
from tessera.llm.components import components

WIDTH, PARTS = 1 << 20, 64
U = np.uint64
#: Links between ids, 16 bytes each, that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Bits of the filters of ids, whatever the input's size. They let all wanted documents pass, and few others while the ids are fewer than the bits.
FILTER = 1 << 25
#: Rows of a column that are held at once; a larger column passes through in parts that share its leader.
HELD = 1 << 19


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_TABLE[65:91] = _TABLE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def rows(texts: list[str], words: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct word n-grams."""
    data = [t.encode() for t in texts]
    out: list[np.ndarray] = []
    start, size = 0, 0
    for i in range(len(data) + 1):
        if i == len(data) or size > 400_000:
            out += _rows(data[start:i], words)
            start, size = i, 0
        if i < len(data):
            size += len(data[i])
    return out


def _rows(data: list[bytes], k: int) -> list[np.ndarray]:
    if not data:
        return []
    buf = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in data])
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    start, stop = edge[::2], edge[1::2]
    empty = np.empty(0, np.uint64)
    if not len(start):
        return [empty] * len(data)
    length = stop - start
    first = np.cumsum(length) - length
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(length.max()), U(0x2545F4914F6CDD1D)), dtype=np.uint64)
        word = _mix(np.add.reduceat(_TABLE[buf[at]] * power[place], first) + length.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        n = len(word)
        gram = np.full(max(0, n - k + 1), U(k))
        for j in range(k):
            gram = _mix(gram * U(0xD6E8FEB86659FD93) + word[j : n - k + 1 + j])
        of = np.searchsorted(ends, start, side="right")
        counts = np.bincount(of, minlength=len(data))
        out, base = [], 0
        for c in counts.tolist():
            if c >= k:
                out.append(np.unique(gram[base : base + c - k + 1]))
            elif c:
                h = np.full(1, U(1000 + c))
                for j in range(c):
                    h = _mix(h * U(0xD6E8FEB86659FD93) + word[base + j])
                out.append(h)
            else:
                out.append(empty)
            base += c
    return out


def _cells(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (gram >> U(44)).astype(np.int64), ((gram >> U(20)) & U(WIDTH - 1)).astype(np.int64)


def _texts(batches, words: int):
    step = 256
    for b in batches:
        for i in range(0, len(b), step):
            part = b.slice(i, step)
            yield part.column("doc_id"), rows(part.column("text").to_pylist(), words)


def _packed(s: np.ndarray) -> bytes:
    """Six bytes of each hash: within two documents they tell n-grams apart as well as eight."""
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpacked(b) -> np.ndarray:
    six = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.reshape(-1).view("<u8")


def _bits(s: np.ndarray) -> bytes:
    """A bitmap of a power of two bits, at least one for each n-gram; an n-gram sets the bit of its lowest digits."""
    b = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    out = np.zeros(b, bool)
    out[(s >> U(16)).astype(np.int64) & (b - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """How many n-grams at least are in one row only. The longer bitmap is folded to the length of the other."""
    if len(x) < len(y):
        x, y = y, x
    a, b, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        a = (a >> size) | (a & ((1 << size) - 1))
    return (a ^ b).bit_count()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, digest for each document; and for each task the segments of its sketch (part, counts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        sketch, id_type = np.zeros((2, WIDTH), np.uint32), None
        for ids, sets in _texts(batches, words):
            id_type = ids.type
            if every := [s for s in sets if len(s)]:
                for d, c in enumerate(_cells(np.concatenate(every))):
                    np.add.at(sketch[d], c, 1)
            k = len(ids)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "n", "digest", "part", "counts"])
        if id_type is not None:
            pack = zstandard.ZstdCompressor(1).compress
            parts = [pack(x.tobytes()) for x in sketch.reshape(PARTS, -1)]
            yield pa.record_batch([pa.nulls(PARTS, id_type), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "n", "digest", "part", "counts"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, digest binary, part int, counts binary")


def sketch_of(seen: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: 2 rows of WIDTH counters, whatever the input's size."""

    def add(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(2 * WIDTH // PARTS, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(unpack(x), np.uint32)
        total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.table({"part": t.column("part").slice(0, 1).combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})

    got = seen.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((PARTS, 2 * WIDTH // PARTS), np.uint32)
    for r in got:
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(2, WIDTH)


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the id's place in a filter: a word (w) and a bit in it."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.shiftright(place, 6).alias("w"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("bit"))


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter (one hash) of the column doc_id, of fixed size."""
    words = _marked(ids.withColumn("text", F.lit(""))).select("w", F.expr("shiftleft(1L, cast(bit as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def _passing(batches, filter_: np.ndarray):
    for b in batches:
        yield b.filter(pa.array((filter_[b.column("w").to_numpy()] >> b.column("bit").to_numpy()) & 1 == 1))


def prefixes(docs: DataFrame, words: int, percent: int, shared, wanted) -> DataFrame:
    """doc_id, n and the prefix of its row, rare n-grams first, of the documents that pass the filter ``wanted``."""

    def run(batches):
        sketch = shared.value
        for ids, sets in _texts(_passing(batches, wanted.value), words):
            out = []
            for s in sets:
                a, b = _cells(s)
                order = np.lexsort((s, np.minimum(sketch[0][a], sketch[1][b])))
                out.append(s[order[: _prefix(len(s), percent)]] if len(s) else s)
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.uint64), *out]).view(np.int64))
            yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "n", "prefix"])

    return _marked(docs).mapInArrow(run, "doc_id long, n int, prefix array<long>")


def _runs(batches, names, most: int = HELD):
    """Runs of equal grams, as arrays, from batches sorted by gram; and whether the last run may go on in the next ones."""
    held: list[list[np.ndarray]] = []
    count = 0
    for b in batches:
        if not len(b):
            continue
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in names])
        count += len(b)
        if held[0][0][0] == held[-1][0][-1] and count < most:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [c[:cut] for c in cols], False
        cols = [c[cut:] for c in cols]
        if len(cols[0]) >= most:
            yield cols, True
            held, count = [], 0
        else:
            held, count = [cols], len(cols[0])
    if count:
        yield [np.concatenate(c) for c in zip(*held, strict=True)], False


def shared_columns(entries: DataFrame, percent: int, parts: int) -> DataFrame:
    """The entries that may belong to a similar pair of their column, each with the column's leader.

    Of a pair the smaller document (or both, of equal sizes) needs 2 * percent * n / (100 + percent)
    of its n-grams from its place on; an entry with fewer needs a smaller partner that has them. The
    leader is the document with the fewest rarer n-grams, the one most like the rest. Entries come by
    rising n, so in a column that doesn't fit at once what was seen tells the least n.
    """
    names = ["gram", "doc_id", "n", "place"]

    def run(batches):
        before = None  # of a column that goes on: gram, least n, leader
        for cols, goes_on in _runs(batches, names):
            gram, doc, n, place = (c.astype(np.int64) for c in cols)
            start = np.concatenate([[0], np.flatnonzero(np.diff(gram)) + 1])
            size = np.diff(np.concatenate([start, [len(gram)]]))
            smaller = n - place >= -(-2 * percent * n // (100 + percent))
            least = np.minimum.reduceat(np.where(smaller, n, 1 << 40), start)
            carried = before if before and before[0] == gram[0] else None
            if carried:
                least[0] = min(least[0], carried[1])
            open_least = int(least[-1])
            least = np.repeat(least, size)
            keep = smaller | ((least <= n) & (n - place >= -(-percent * (n + least) // (100 + percent))))
            several = np.add.reduceat(keep.astype(np.int64), start) > 1
            if carried or goes_on:
                several[0 if carried else -1] = True
                several[-1] |= goes_on
            keep &= np.repeat(several, size)
            before = (int(gram[-1]), open_least, carried[2] if carried and len(start) == 1 else None) if goes_on else None
            if not keep.any():
                continue
            gram, doc, n, place = (x[keep] for x in (gram, doc, n, place))
            order = np.lexsort((_mix(doc.astype(np.uint64)), place, gram))
            gram, doc, n, place = (x[order] for x in (gram, doc, n, place))
            start = np.concatenate([[0], np.flatnonzero(np.diff(gram)) + 1])
            size = np.diff(np.concatenate([start, [len(gram)]]))
            out = [gram, doc, n.astype(np.int32), place.astype(np.int32)]
            lead = [x[start] for x in out[1:]]
            if carried and carried[2] and gram[0] == carried[0]:
                for x, v in zip(lead, carried[2], strict=True):
                    x[0] = v
            if before and gram[-1] == before[0]:
                before = (*before[:2], tuple(int(x[-1]) for x in lead))
            out += [np.repeat(x, size) for x in lead]
            yield pa.record_batch([pa.array(x) for x in out], [*names, "lead", "lead_n", "lead_place"])

    return entries.repartition(parts, "gram").sortWithinPartitions("gram", "n").mapInArrow(run, "gram long, doc_id long, n int, place int, lead long, lead_n int, lead_place int")


def _possible(n1, p1, n2, p2, percent: int):
    """Whether documents of n1 and n2 n-grams can reach the similarity if the first they share is at these places."""
    n1, n2 = n1.cast("long"), n2.cast("long")
    need = F.ceil(percent * (n1 + n2) / (100 + percent))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= need)


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def leader_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of each column's leader with the column's other documents."""
    c = F.col
    return _pairs(entries.where((c("doc_id") != c("lead")) & _possible(c("n"), c("place"), c("lead_n"), c("lead_place"), percent)), "doc_id", "lead")


def rest_pairs(entries: DataFrame, roots: DataFrame, percent: int, turn: int | None) -> DataFrame:
    """Pairs a < b of documents of different components that share a column.

    Documents of the leader's component needn't be compared with each other, so each pair has one
    outside it. With a ``turn``, of those outside only one by column, another leader, is compared.
    """
    near = F.broadcast(roots) if 16 * roots.count() <= BROADCAST_BYTES else roots
    own, head = (near.select(F.col("node").alias(f"node{i}"), F.col("root").alias(f"root{i}")) for i in (0, 1))
    named = entries.join(own, F.col("doc_id") == F.col("node0"), "left").join(head, F.col("lead") == F.col("node1"), "left").select(
        "gram", "doc_id", "n", "place", F.coalesce("root0", "doc_id").alias("comp"), F.coalesce("root1", "lead").alias("lead_comp")
    )
    outside = named.where("comp <> lead_comp").select("gram", F.struct("doc_id", "n", "place", "comp").alias("o"))
    if turn is not None:
        first = F.struct(F.lit(0) if turn > 1 else F.col("o.place"), F.xxhash64(F.lit(turn), "o.doc_id"))
        outside = outside.groupBy("gram").agg(F.min_by("o", first).alias("o"))
    c = F.col
    met = named.join(outside, "gram").where((c("comp") != c("o.comp")) & _possible(c("n"), c("place"), c("o.n"), c("o.place"), percent))
    return _pairs(met, "doc_id", "o.doc_id")


def _checked(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose documents' values of a column of ``sets`` pass the test(n of a, n of b, value of a, value of b)."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"set_{x}")) for x in "ab")

    def run(batches):
        for b in batches:
            values = zip(b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), b.column("set_a"), b.column("set_b"), strict=True)
            keep = [test(n, m, x.as_buffer(), y.as_buffer()) for n, m, x, y in values]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def possible_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps allow the similarity."""

    def test(n: int, m: int, x, y) -> bool:
        return n + m - _differ(bytes(x), bytes(y)) >= 2 * -(-percent * (n + m) // (100 + percent))

    return _checked(pairs, sets, "bits", test)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full rows reach the similarity."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def test(n: int, m: int, x, y) -> bool:
        both = np.concatenate([_unpacked(x), _unpacked(y)])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(both) - common)

    # only the rows of documents in pairs travel
    return _checked(pairs, sets.join(ids, "doc_id", "left_semi"), "grams", test)


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 4, percent: int = 85, star_rounds: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    seen = scratch.keep(signatures(docs, words))
    each = seen.where("part IS NULL").select("doc_id", "n", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(256)).cast("int").alias("shard"))

    # classes of equal rows: by shard first, so that a class of a third of all documents is no single task
    by_shard = each.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "shard").agg(F.min("doc_id").alias("least"))
    class_of = by_shard.join(by_shard.groupBy("digest").agg(F.min("least").alias("rep")), "digest").select("digest", "shard", "rep")
    classes = scratch.keep(each.join(class_of, ["digest", "shard"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    reps = classes.where("n > 0 AND rep = doc_id").select("doc_id")
    again = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1 AND doc_id IS NOT NULL").select("doc_id", "a")
    same_id = classes.join(again, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")

    shared = spark.sparkContext.broadcast(sketch_of(seen))
    # one document for each class; the few copies that the filter lets pass do no harm
    one = spark.sparkContext.broadcast(_filter_of(reps))
    prefix = prefixes(docs, words, percent, shared, one).where("n > 0")
    entries = prefix.select("doc_id", "n", F.posexplode("prefix").alias("place", "gram")).select("gram", "doc_id", "n", "place")
    entries = scratch.keep(shared_columns(entries, percent, parts))

    held = spark.sparkContext.broadcast(_filter_of(entries.select("doc_id")))

    def full(batches):
        for ids, sets in _texts(_passing(batches, held.value), words):
            yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_bits(s) for s in sets], pa.binary()), pa.array([_packed(s) for s in sets], pa.binary())], ["doc_id", "n", "bits", "grams"])

    sets = scratch.keep(_marked(docs).mapInArrow(full, "doc_id long, n long, bits binary, grams binary"))

    rows = entries.count()
    links, roots, tested = same_id, None, None
    for turn in range(star_rounds + 1):
        if turn == 0:
            pairs = leader_pairs(entries, percent)
        else:
            pairs = rest_pairs(entries, roots, percent, turn if turn < star_rounds else None)
        pairs = scratch.keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), rows)
        tested = pairs if tested is None else tested.union(pairs)
        likely = scratch.keep(possible_pairs(pairs, sets, percent), rows)
        found = scratch.keep(verified(likely, sets, percent), rows)
        if turn and found.isEmpty():
            continue
        links = links.select("a", "b").union(found) if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)
        roots = components(links, scratch, rows)
    out = classes.join(roots, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op8(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
