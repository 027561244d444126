r"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn role="ROLE">TEXT</turn>\n``. In roles and texts a backslash, ``<``, ``>`` and
``"`` are written as ``\\``, ``\l``, ``\g`` and ``\q``, so no control string of the template can
occur inside, and the text comes back exactly. The segments of a batch of turns (header, role,
middle, text, tail) get their lengths as numpy arrays; cumulative sums give each segment's place
and the bytes are scattered into one preallocated Arrow buffer. The loss mask covers the text of
assistant turns, as a byte span of the turn.

Turns of a conversation stand in order of turn, then role, then text; its formatted text is
their concatenation. A null text or role is empty; a null conv_id is a conversation of its own;
repeated rows are turns. A conversation of any length passes through as a stream of batches; its digests need its
turns in order, so it is one task's, sorted with spilling. An empty table gives an empty result; columns other than
the four are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table

HEAD, MIDDLE, TAIL = b'<turn role="', b'">', b"</turn>\n"
ESCAPES = (("\\", r"\\"), ("<", r"\l"), (">", r"\g"), ('"', r"\q"))
BACK = {"\\": "\\", "l": "<", "g": ">", "q": '"'}
TURN = re.compile(r'<turn role="([^"<]*)">([^<]*)</turn>\n')


def escape(column: pa.Array) -> pa.Array:
    for a, b in ESCAPES:
        column = pc.replace_substring(column, a, b)
    return column


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text, flags=re.S) if "\\" in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value starts and how long it is."""
    column = pa.concat_arrays([column]).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, and the byte span of each text in its turn."""
    n = len(role)
    parts = [_bytes(escape(c)) for c in (role, text)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(HEAD), len(MIDDLE), len(TAIL)
    lengths[:, 1], lengths[:, 3] = parts[0][2], parts[1][2]
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    total = int(ends[-1, -1]) if n else 0
    out = np.empty(total, np.uint8)
    for k, fixed in ((0, HEAD), (2, MIDDLE), (4, TAIL)):
        out[(starts[:, k, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
    for k, (data, source, size) in ((1, parts[0]), (3, parts[1])):
        run = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(starts[:, k], size) + run] = data[np.repeat(source, size) + run]
    offsets = np.append(starts[:, 0], total).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out))
    return formatted.cast(pa.string()), starts[:, 3] - starts[:, 0], ends[:, 3] - starts[:, 0]


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_from, loss_to: sorted by conversation and turn within partitions.

    loss_from and loss_to are null where the turn has no loss.
    """
    ship(turns.sparkSession)
    turns = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in turns.schema}

    def run(batches):
        for b in batches:
            formatted, start, end = assemble(b.column("role"), b.column("text"))
            learn = ~pc.equal(b.column("role"), "assistant").to_numpy(zero_copy_only=False)
            yield pa.record_batch([b.column("conv_id"), b.column("turn"), formatted, pa.array(start, mask=learn), pa.array(end, mask=learn)], ["conv_id", "turn", "formatted", "loss_from", "loss_to"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {types['conv_id']}, turn {types['turn']}, formatted string, loss_from long, loss_to long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, state, rows, id_type = None, None, [], None

        def end():
            if state:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
            rows.clear()
            return out

        for b in batches:
            id_type = b.column("conv_id").type
            for conv, text, start, stop in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if state is None or conv != now:
                    end()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in TURN.finditer(text):
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                state[4] += len(text)
                if start is not None:
                    plain = unescape(text.encode()[start:stop].decode())
                    state[2] += len(plain)
                    state[3].update(plain.encode())
            yield flush()
        if state:
            end()
            yield flush()

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(more)))


SQL2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(text) + length(role)
      + length(regexp_replace(text, '[^\\<>"]', '', 'g')) + length(regexp_replace(role, '[^\\<>"]', '', 'g')) - 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
