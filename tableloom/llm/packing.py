"""Packing tokenised documents into sequences of fixed length by bounded-space best fit.

Documents are cut into pieces of at most one sequence; only the first piece of a long one may be shorter, so at most one
piece per document leaves a gap. Pieces are dealt evenly to streams. A stream keeps a fixed number of open sequences in
stacks by free space and one bitset with a bit for each free space that occurs: the best fit for a piece is the lowest
set bit at or above its length. When no open sequence fits and all places are taken, the fullest is closed. Pieces arrive
in windows as long as the number of places, each sorted from long to short, so short ones fill what long ones leave.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import free_name
from tableloom.llm.bpe import read_definition
from tableloom.llm.common import named
from tableloom.session import materialise

#: Documents taken out of a batch at once; results leave in batches of as many.
ROWS_AT_ONCE = 128
#: Sequence numbers: the stream's number in front, the place within the stream in the low bits.
STREAM_BITS = 32

# The pieces that a byte-level tokenizer cuts texts into, and the characters it writes for bytes.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Ids of whole texts for one tokenizer file, given as its text.

    A byte-level file whose ids follow its merges is handled by ``tiktoken`` with the file's own vocabulary, several
    times faster with the same ids; any other file by ``tokenizers``.
    """

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        ranks = byte_ranks(parsed)
        if ranks is None:
            from tokenizers import Tokenizer

            tool = Tokenizer.from_str(definition)
            tool.no_truncation()
            tool.no_padding()
            self.ids = lambda text: np.array(tool.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return
        import tiktoken

        special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        known = set(special)
        self.ids = lambda text: fast.encode_to_numpy(text, allowed_special=known, disallowed_special=())


def byte_ranks(parsed: dict) -> dict[bytes, int] | None:
    """Byte strings of a byte-level vocabulary with their ids, if the ids alone tell which merge comes first."""
    model, cutter = parsed["model"], parsed.get("pre_tokenizer") or {}
    plain = (
        model.get("type", "BPE") == "BPE" and parsed.get("normalizer") is None and cutter.get("type") == "ByteLevel"
        and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(t[k] for t in parsed["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    )
    if not plain:
        return None
    hidden = [b for b in range(256) if b not in SHOWN_BYTES]
    byte_of = {chr(b): b for b in SHOWN_BYTES} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary, special = model["vocab"], {t["content"] for t in parsed["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    singles = [i for t, i in vocabulary.items() if len(t) == 1]
    ordered = all(x < y for x, y in zip(made, made[1:])) and made[:1] > [max(singles, default=0)]
    if not ordered or len(made) + len(singles) + len(special & set(vocabulary)) != len(vocabulary):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}


def pieces(
    df: DataFrame, path: str, text: str = "text", end_id: int = 2, capacity: int = 1024, ids: str | None = "ids"
) -> DataFrame:
    """Replaces the text column by the pieces of its tokens: ``piece`` (from 0), ``start``, ``length``, ``ids_crc32``
    and, unless ``ids`` is None, the token ids themselves as little-endian unsigned 32-bit integers.

    A document is its ids followed by ``end_id``. One longer than ``capacity`` is cut so that all pieces but the first
    are full. A null text counts as empty and gives one piece of one token; repeated rows are cut each; all other columns
    stay, those named like the new ones are replaced; an empty table gives an empty table.
    """
    definition = df.sparkSession.sparkContext.broadcast(read_definition(path))
    new = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    kinds = ["int", "bigint", "bigint", "bigint"]
    if ids is not None:
        new[ids] = pa.binary()
        kinds.append("binary")
    taken = {text.lower(), *(n.lower() for n in new)}
    others = [c for c in df.columns if c.lower() not in taken]
    names = [f"c{i}" for i in range(len(others) + len(new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # kept next to the broadcast value, which a Python worker holds for all its tasks
        encoder = getattr(definition, "encoder", None) or Encoder(definition.value)
        definition.encoder, encode = encoder, encoder.ids
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                row, made = [], []
                for i, value in enumerate(batch.column(len(others)).to_pylist()):
                    found = np.append(encode(value or ""), np.uint32(end_id)).astype("<u4")
                    first = (len(found) - 1) % capacity + 1
                    cuts = [0, *range(first, len(found) + 1, capacity)]
                    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = found[a:b].tobytes()
                        row.append(i)
                        made.append((number, a, b - a, zlib.crc32(part), part))
                columns = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(len(others))]
                columns += [pa.array([m[i] for m in made], type=kind) for i, kind in enumerate(new.values())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = df.select(*map(named, others), named(text).cast("string")).toDF(*names[: len(others)], "text")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    fields += [f"{n} {kind}" for n, kind in zip(names[len(others) :], kinds)]
    return chosen.mapInArrow(run, ", ".join(fields)).toDF(*others, *new)


class OpenSequences:
    """The open sequences of one stream."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        self.open -= 1
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        """Sequence and offset of the next piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self.take(free)
        else:
            if self.open == self.places and length < self.capacity:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            sequence, free = self.made, self.capacity
            self.made += 1
        if free > length:
            self.by_free[free - length].append(sequence)
            self.bits |= 1 << (free - length)
            self.open += 1
        return sequence, self.capacity - free


def pack(
    df: DataFrame,
    length: str = "length",
    capacity: int = 1024,
    places: int = 4096,
    stream_rows: int = 32_768,
    sequence: str = "sequence_id",
    offset: str = "offset",
) -> DataFrame:
    """Adds ``sequence`` and ``offset`` to pieces of known ``length``.

    Streams take about ``stream_rows`` pieces each, dealt round robin, so no key decides where a piece goes. Pieces whose
    length is null, below 1 or above ``capacity`` get neither sequence nor offset. Repeated rows are packed each; all
    other columns stay, those named like the new ones are replaced; an empty table stays empty.
    """
    others = [c for c in df.columns if c.lower() not in (sequence.lower(), offset.lower())]
    stored = materialise(df.select(*map(named, others)).toDF(*(f"c{i}" for i in range(len(others)))))
    streams = max(1, math.ceil(stored.count() / stream_rows))
    size, order, stream = f"c{others.index(length)}", free_name(stored, "order"), free_name(stored, "stream")
    # the order within a stream must not depend on which shuffle block came first
    dealt = (
        stored.withColumn(order, F.xxhash64(*stored.columns))
        .repartition(streams)
        .sortWithinPartitions(order, *[c for c in stored.columns if not stored.schema[c].dataType.simpleString().startswith("map")])
        .drop(order)
        .withColumn(stream, F.spark_partition_id().cast("bigint"))
    )
    width = len(stored.columns)
    names = [*stored.columns, "s", "o"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenSequences(capacity, places)
        for whole in batches:
            for at in range(0, whole.num_rows, places):
                batch = whole.slice(at, places)
                lengths = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype("float64")
                first = int(batch.column(batch.num_columns - 1)[0].as_py()) << STREAM_BITS
                found = [None] * len(lengths)
                for i in np.argsort(-lengths, kind="stable").tolist():
                    if 1 <= lengths[i] <= capacity:
                        found[i] = bins.put(int(lengths[i]))
                columns = [batch.column(i) for i in range(width)]
                columns.append(pa.array([None if f is None else first + f[0] for f in found], pa.int64()))
                columns.append(pa.array([None if f is None else f[1] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields]
    packed = dealt.mapInArrow(run, ", ".join([*fields, "s bigint", "o bigint"]))
    return packed.toDF(*others, sequence, offset)


def sequences(packed: DataFrame, ids: str = "ids", sequence: str = "sequence_id", offset: str = "offset") -> DataFrame:
    """The sequences themselves: ``sequence``, ``n_pieces`` and their joined ``ids``. A sequence has at most as many
    pieces as tokens. Pieces without a sequence are left out."""
    parts = packed.filter(named(sequence).isNotNull()).select(
        named(sequence).alias("s"), F.struct(named(offset).alias("o"), named(ids).alias("i")).alias("p")
    )
    gathered = parts.groupBy("s").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.expr("concat_ws('', transform(p, x -> hex(x.i)))")
    return gathered.select(
        F.col("s").alias(sequence), F.size("p").cast("bigint").alias("n_pieces"), F.unhex(joined).alias(ids)
    )
