"""BPE encoding and decoding through a distinct-word table.

1. Texts are split into words (the byte-level pre-tokenizer's pattern) block by block. A block,
   a run of documents of up to ``block_chars`` characters, becomes one row with the sequence of
   word numbers, and its distinct words, packed by bucket (a hash of the word), one row for each.
2. The packed words of all blocks are dealt out and sorted by bucket: a bucket's rows make its part of the
   distinct-word table. Each distinct word is encoded once.
3. The ids go back by (block, bucket) in the order of the words and are put in place by position.
4. Decoding joins ids to the vocabulary's pieces, whose number the vocabulary bounds.

Only sequences of word numbers travel, not texts; a frequent word is one row per block. Null
text is empty text and has no ids. Longer texts than ``block_chars`` are a block of their own.
Rows that repeat an id are encoded each; an empty table gives an empty result; columns other than id and text are
not read. A block's name is a digest of its contents, so what is computed again after the loss of an executor meets
its own parts only; where an input gives other rows when read again, that is an error. Tokenizers of another kind
are refused. Special tokens in a text count as such, as the
tokenizers library has it by default.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table, text_of

#: The pattern of byte-level pre-tokenizers, and Unicode's White_Space.
BLANK = "\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{blank}{l}{n}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


@lru_cache
def _splitters():
    """The pattern for texts of the basic plane (character sets as bitmaps are fast there) and for all others."""

    def ranges(kind: str) -> str:
        out, start = [], None
        for c in range(0x10001):
            inside = c < 0x10000 and unicodedata.category(chr(c))[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
                start = None
        return "".join(out)

    l, n = ranges("L"), ranges("N")
    fast = re.compile(PATTERN.format(L=f"[{l}]", N=f"[{n}]", l=l, n=n, blank=BLANK))
    full = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}", blank=BLANK))
    return fast, full, re.compile("[\U00010000-\U0010ffff]")


def split_words(text: str, special: re.Pattern | None) -> list[str]:
    fast, full, astral = _splitters()
    find = (full if astral.search(text) else fast).findall
    if special is None or not special.search(text):
        return find(text)
    out: list[str] = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else find(part)
    return out


class Coder:
    """A tokenizer file, opened once in each Python worker. ``spec``: the file's contents, read by the driver."""

    _open: dict[str, "Coder"] = {}

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = max(self.tok.get_vocab(True).values(), default=0) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self._pieces = None

    @classmethod
    def of(cls, key: str, spec: str) -> Coder:
        if key not in cls._open:
            cls._open = {key: cls(spec)}
        return cls._open[key]

    def encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def pieces(self) -> list[bytes]:
        """id to bytes; the byte-level alphabet turns bytes into printable characters."""
        if self._pieces is None:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in set(plain)]
            back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
            special = {i for i, t in self.tok.get_added_tokens_decoder().items()}
            self._pieces = [b""] * self.size
            for piece, i in self.tok.get_vocab(True).items():
                self._pieces[i] = piece.encode() if i in special else bytes(back[c] for c in piece)
        return self._pieces


def _refuse_others(spec: str) -> None:
    """Only byte-level tokenizers with the usual pattern are split right here."""
    parts = json.loads(spec)
    pre = parts.get("pre_tokenizer") or {}
    if parts.get("model", {}).get("type") != "BPE" or parts.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the tokenizer isn't a byte-level BPE without normalizer and with the usual splitting pattern")


def special_pattern(spec: str) -> str:
    from tokenizers import Tokenizer

    found = sorted((t.content for t in Tokenizer.from_str(spec).get_added_tokens_decoder().values()), key=len, reverse=True)
    return "(" + "|".join(map(re.escape, found)) + ")" if found else ""


def _planes(x: np.ndarray) -> bytes:
    """Word numbers, frequent ones small, as compressed bytes of equal weight."""
    x = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(x.T).tobytes())


def _unplanes(b: bytes) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(x.T).reshape(-1).view("<u4")


#: Buckets of the distinct-word table for each shuffle partition, so that a bucket's words fit in memory.
SPREAD = 16
BLOCKS = "block string, bucket int, words binary, ids binary, lens binary, doc binary"
NAMES = ["block", "bucket", "words", "ids", "lens", "doc"]


def _pack(strings: list[str]) -> bytes:
    data = [x.encode("utf-8", "surrogatepass") for x in strings]
    return zstandard.ZstdCompressor(3).compress(np.array([len(data), *map(len, data)], "<u4").tobytes() + b"".join(data))


def _unpack(b: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int.from_bytes(raw[:4], "little")
    at = 4 * (n + 1)
    out = []
    for k in np.frombuffer(raw, "<u4", n, 4).tolist():
        out.append(raw[at : at + k].decode("utf-8", "surrogatepass"))
        at += k
    return out


def blocks(docs: DataFrame, special: str, block_chars: int, buckets: int) -> DataFrame:
    """Of each block: a row of bucket -1 with word numbers (ids), words per document (lens) and document ids (doc); a row of words for each bucket.

    Word numbers count the block's words bucket by bucket, and in the bucket's order.
    """
    names = docs.columns

    def run(batches):
        spec = re.compile(special) if special else None
        seen: dict[str, int] = {}
        seq: list[np.ndarray] = []
        lens: list[int] = []
        ids: list[pa.Array] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal chars
            words = list(seen)
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            x = np.concatenate(seq) if seq else np.empty(0, np.uint32)
            # sorted within the bucket: packs better
            order = np.array(sorted(order.tolist(), key=lambda i: (bucket[i], words[i])), np.int64)
            number_of = np.empty(len(words), np.uint32)
            number_of[order] = np.arange(len(words))
            rank_of = np.empty(len(words), np.uint32)
            by_count = np.argsort(-np.bincount(x, minlength=len(words)), kind="stable")
            rank_of[by_count] = np.arange(len(words))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            packed = [_pack([words[i] for i in order[cut[k] : cut[k + 1]].tolist()]) for k in some.tolist()]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids[0].type)])) as w:
                for i in ids:
                    w.write_batch(pa.record_batch([i], ["id"]))
            n = len(some)
            # the sequence holds ranks by frequency (small numbers); the table of ranks leads to word numbers
            head = _planes(np.concatenate([np.array([len(words)], np.uint32), number_of[by_count], rank_of[x]]))
            # the name says what is in the block: parts of another one never pass for this one's, whatever is computed again
            sums, docs_ = np.array(lens, "<i8").tobytes(), sink.getvalue().to_pybytes()
            name = hashlib.blake2b(digest_size=16)
            for x in (head, sums, docs_, *packed):
                name.update(len(x).to_bytes(8, "little") + x)
            at = name.hexdigest()
            out = pa.record_batch(
                [
                    pa.array([at] * (n + 1), pa.string()), pa.array([-1, *some.tolist()], pa.int32()), pa.array([None, *packed], pa.binary()),
                    pa.array([head, *[None] * n], pa.binary()), pa.array([sums, *[None] * n], pa.binary()), pa.array([docs_, *[None] * n], pa.binary()),
                ],
                NAMES,
            )
            for held in (seen, seq, lens, ids):
                held.clear()
            chars = 0
            return out

        for b in batches:
            texts, doc_ids = b.column(names.index("text")).to_pylist(), b.column(names.index("doc_id"))
            start = 0
            for i, t in enumerate(texts):
                if chars and chars + len(t) > block_chars:
                    if i > start:
                        ids.append(doc_ids.slice(start, i - start))
                    yield flush()
                    start = i
                words = split_words(t, spec)
                lens.append(len(words))
                put = seen.setdefault
                seq.append(np.fromiter((put(w, len(seen)) for w in words), np.uint32, len(words)))
                chars += len(t) + 1
            if len(texts) > start:
                ids.append(doc_ids.slice(start))
        if lens:
            yield flush()

    return docs.mapInArrow(run, BLOCKS)


def encode_words(rows: DataFrame, key: str, spec, parts: int) -> DataFrame:
    """(block, bucket, ids) for each pack of words; a bucket's packs stand together and each of its distinct words is encoded once."""

    def pick(batches):
        for b in batches:
            yield b.filter(pa.compute.greater_equal(b.column("bucket"), 0)).select(["block", "bucket", "words"])

    def run(batches):
        coder, bucket, known = Coder.of(key, spec.value), None, {}
        for b in batches:
            out = []
            for at, pack in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist(), strict=True):
                if at != bucket:
                    bucket, known = at, {}
                words = _unpack(pack)
                new = [w for w in words if w not in known]
                known.update(zip(new, coder.encode(new), strict=True))
                ids = [known[w] for w in words]
                out.append(zstandard.ZstdCompressor(3).compress(np.array([len(ids), *map(len, ids)], "<u4").tobytes() + b"".join(ids)))
            yield pa.record_batch([b.column("block"), b.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    words = rows.mapInArrow(pick, "block string, bucket int, words binary")
    return words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "block string, bucket int, ids binary")


def encode(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", digests: bool = False, block_chars: int = 24_000_000, parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids array<int>, decoded string; with ``digests`` their SHA-256 instead."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:  # a file of the driver, bounded by the vocabulary; workers get its contents
        spec = f.read()
    _refuse_others(spec)
    key, special = hashlib.sha256(spec.encode()).hexdigest(), special_pattern(spec)
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shared = spark.sparkContext.broadcast(spec)
    whole = blocks(docs, special, block_chars, SPREAD * parts).repartition(parts, "block")

    words = encode_words(whole, key, shared, parts)
    out = f"doc_id {id_type}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    types = [pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        coder = Coder.of(key, shared.value)
        left = left.filter(pa.compute.equal(left.column("bucket"), -1))
        ids: list[list[int]] = []
        if not left.num_rows:
            raise RuntimeError("words of a block that isn't there: the input gave other rows when it was read again; write it first")
        # blocks that are equal in all, down to the document ids, have equal words: one set of them serves
        once = dict(zip(right.column("bucket").to_pylist(), range(right.num_rows), strict=True))
        right = right.take(pa.array(once.values(), pa.int64()))
        for _, pack in sorted(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True)):
            raw = zstandard.ZstdDecompressor().decompress(pack)
            n = int.from_bytes(raw[:4], "little")
            all_, sizes = np.frombuffer(raw, coder.kind, offset=4 * (n + 1)).tolist(), (np.frombuffer(raw, "<u4", n, 4) // np.dtype(coder.kind).itemsize).tolist()
            upto = 0
            for k in sizes:
                ids.append(all_[upto : upto + k])
                upto += k
        piece = coder.pieces()
        plain = [b"".join([piece[i] for i in x]) for x in ids]
        count = np.array([len(x) for x in ids], np.int64)
        marks = [",".join(map(str, x)) for x in ids] if digests else ids
        doc_ids, rows = [], []
        for seq, lens, doc in zip(*(left.column(c).to_pylist() for c in ("ids", "lens", "doc")), strict=True):
            doc_ids += pa.ipc.open_stream(doc).read_all().column("id").chunks
            x, upto = _unplanes(seq), 0
            k = int(x[0])
            if k != len(ids):
                raise RuntimeError("a block's words are missing: the input gave other rows when it was read again; write it first")
            x = x[1 : k + 1][x[k + 1 :]]
            for k in np.frombuffer(lens, "<i8").tolist():
                at = x[upto : upto + k]
                upto += k
                n, at = int(count[at].sum()) if k else 0, at.tolist()
                text = b"".join([plain[i] for i in at])
                if digests:
                    rows.append((n, hashlib.sha256(",".join([marks[i] for i in at]).encode()).hexdigest(), hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest()))
                else:
                    rows.append((n, [t for i in at for t in marks[i]], text.decode("utf-8", "replace")))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.chunked_array(doc_ids), pa.array(columns[0], pa.int64()), *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names)

    return whole.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assemble, out)


def op5(spark, sf_dir):
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
