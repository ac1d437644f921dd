"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that occur together inside no token can never end up in one token, so a cut between them is
certain. A word falls into fragments at these cuts; every fragment is encoded by itself and the ids are concatenated.
Invented and compound words share most of their fragments, so a small memory of fragments replaces most merging.

The result equals that of the tokenizer file: special tokens are taken out of the raw text first, each rest is
normalised, split into pieces and mapped to byte symbols by the file's own rules, and merged by rank, leftmost first.
Words between white space are independent of each other under these rules, so their ids are remembered too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableloom.llm.common import Cache, named

#: Control characters that Python's ``str.split`` takes for white space and the tokenizer does not.
SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: White space as the tokenizer's normaliser sees it.
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The pieces of a printable ASCII word in lower case; the same rules as in the tokenizer file.
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class BytePairs:
    """Encoder and decoder for one tokenizer file, given as its text."""

    def __init__(self, definition: str, cached: int = 200_000):
        from tokenizers import Tokenizer

        parsed = json.loads(definition)
        model = parsed["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ranks = {
            tuple(m if isinstance(m, list) else m.split(" ", 1)): rank for rank, m in enumerate(model["merges"])
        }
        tool = Tokenizer.from_str(definition)
        self.normalize = tool.normalizer.normalize_str
        self.pieces = tool.pre_tokenizer.pre_tokenize_str
        self.plain_pieces = PLAIN_PIECES.findall
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, reverse=True))) + ")")
        self.tokens = [""] * (1 + max([*self.vocabulary.values(), *self.special.values()]))
        for token, number in [*self.vocabulary.items(), *self.special.items()]:
            self.tokens[number] = token
        #: pairs of neighbouring byte symbols that some token holds; between all others a cut is certain
        self.inside: set[str] = set()
        for token in self.vocabulary:
            bare = token.removesuffix(self.suffix) if self.suffix else token
            self.inside.update(bare[i : i + 2] for i in range(len(bare) - 1))
        self.fragments = Cache(self.merge, cached)
        self.words = Cache(self.encode_word, cached)

    def cut(self, piece: str) -> list[str]:
        """The piece's fragments; the last one carries the end-of-word mark."""
        found, start, inside = [], 0, self.inside
        for i, pair in enumerate(map(str.__add__, piece, piece[1:]), 1):
            if pair not in inside:
                found.append(piece[start:i])
                start = i
        found.append(piece[start:] + self.suffix)
        return found

    def merge(self, fragment: str) -> bytes:
        """Ids of one fragment as little-endian unsigned 32-bit integers."""
        if self.suffix and fragment.endswith(self.suffix):
            bare = fragment.removesuffix(self.suffix)
            symbols = [*bare[:-1], bare[-1] + self.suffix]
        else:
            symbols = list(fragment)
        ranks, none = self.ranks, len(self.ranks)
        order = [ranks.get(pair, none) for pair in zip(symbols, symbols[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            at = order.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del order[at]
            if at:
                order[at - 1] = ranks.get((symbols[at - 1], symbols[at]), none)
            if at < len(order):
                order[at] = ranks.get((symbols[at], symbols[at + 1]), none)
        return np.array([self.vocabulary[s] for s in symbols], dtype="<u4").tobytes()

    def encode_word(self, word: str) -> bytes:
        fragments = self.fragments
        if word.isascii() and word.isprintable():  # its byte symbols are the characters themselves
            pieces = self.plain_pieces(word.lower())
        else:
            pieces = [piece for piece, _ in self.pieces(self.normalize(word))]
        return b"".join([fragments[part] for piece in pieces for part in self.cut(piece)])

    def encode_plain(self, text: str) -> bytes:
        parts = SPACES.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        if "<|" not in text and all(t.startswith("<|") for t in self.special):
            return self.encode_plain(text)
        found = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                found.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                found.append(self.encode_plain(part))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The tokens joined by blanks: what a tokenizer without a decoder gives, special tokens kept."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def read_definition(path: str) -> str:
    """The tokenizer file's text; the driver reads it once and it travels to the tasks (a vocabulary, a few MB)."""
    with open(path, encoding="utf-8") as source:
        return source.read()


#: Documents taken out of a batch at once; results leave in batches of as many.
ROWS_AT_ONCE = 128


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Replaces the text column by ``ids``: little-endian unsigned 32-bit token ids in one binary value.

    With ``decoded``, a column of that name holds the ids decoded again, by the same pass. A null text counts as empty;
    empty texts have no ids. Repeated rows are encoded each; all other columns stay. Existing columns named like the new
    ones are replaced. An empty table gives an empty table.
    """

    def both(pairs: BytePairs, value: str | None) -> tuple:
        found = pairs.encode(value or "")
        return (found,) if decoded is None else (found, pairs.decode(found))

    targets = {ids: ("binary", pa.binary())} | ({} if decoded is None else {decoded: ("string", pa.string())})
    return _mapped(df, path, text, targets, both)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replaces the ids column by the decoded ``text``; null ids decode to the empty text."""
    return _mapped(df, path, ids, {text: ("string", pa.string())}, lambda pairs, value: (pairs.decode(value or b""),))


def _mapped(df: DataFrame, path: str, source: str, targets: dict[str, tuple], change) -> DataFrame:
    definition = df.sparkSession.sparkContext.broadcast(read_definition(path))
    others = [c for c in df.columns if c != source and c not in targets]
    kinds = list(targets.values())
    names = [f"c{i}" for i in range(len(others) + len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs(definition.value)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                made = [change(pairs, v) for v in batch.column(len(others)).to_pylist()]
                new = [pa.array([m[i] for m in made], type=kind) for i, (_, kind) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), *new], names=names)

    # numbered names on the way: columns may be called anything, with dots too
    chosen = df.select(*map(named, others), named(source)).toDF(*(f"c{i}" for i in range(len(others) + 1)))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    fields += [f"c{len(others) + i} {kind}" for i, (kind, _) in enumerate(kinds)]
    return chosen.mapInArrow(run, ", ".join(fields)).toDF(*others, *targets)
