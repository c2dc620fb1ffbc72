"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of byte symbols.  The leaf at position i holds the merge rank of the pair
that starts there; the root therefore names the leftmost lowest-rank merge.  A merge changes
three leaves (its own, its left neighbour's, the one it swallowed), each in O(log n), until the
root says that nothing can be merged.

Edge cases: null text is the empty text (no ids); empty text gives no ids; repeated rows are
encoded alike; other columns of the input, whatever their names, are ignored; an empty table
gives an empty result.  Text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import Memo, batch_of, kept, per_batch

#: Fixed: the published pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = 1 << 60
_CACHED = 200_000
_FIRST, _SECOND = itemgetter(0), itemgetter(1)


def byte_letters() -> dict[int, str]:
    """Byte -> printable letter: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class PairTree:
    """Tournament tree of pair ranks; `best()` is the leftmost position of the lowest rank."""

    def __init__(self, ranks: list[int]):
        self.size = 1
        while self.size < len(ranks):
            self.size *= 2
        level = ranks + [_NONE] * (self.size - len(ranks))
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        self.node = [_NONE, *chain.from_iterable(reversed(levels))]

    def set(self, i: int, rank: int) -> None:
        node = self.node
        i += self.size
        node[i] = rank
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a <= b else b
            if node[i] == low:
                return
            node[i] = low
            i >>= 1

    def best(self) -> tuple[int, int]:
        node, i = self.node, 1
        low = node[1]
        if low == _NONE:
            return low, -1
        while i < self.size:
            i *= 2
            if node[i] != low:
                i += 1
        return low, i - self.size


class Codec:
    """A byte-level BPE vocabulary read from the text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        self.byte_of = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.first = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.bytes_of = {i: bytes(self.byte_of[c] for c in piece) for piece, i in vocab.items()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.pieces = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.piece = Memo(self._encode_piece, _CACHED)
        self.both_ways = Memo(self._round_trip_piece, _CACHED)

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges of one pre-token, lowest rank first, leftmost first among equals."""
        n, ranks, merged = len(symbols), self.ranks, self.merged
        if n < 2:
            return symbols
        tree = PairTree(list(map(ranks.get, zip(symbols, symbols[1:]), repeat(_NONE))))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            rank, i = tree.best()
            if rank == _NONE:
                break
            j = after[i]
            symbols[i] = merged[rank]
            k = after[i] = after[j]
            symbols[j] = -1
            if j < n - 1:
                tree.set(j, _NONE)
            if k < n:
                before[k] = i
                tree.set(i, ranks.get((symbols[i], symbols[k]), _NONE))
            else:
                tree.set(i, _NONE)
            h = before[i]
            if h >= 0:
                tree.set(h, ranks.get((symbols[h], symbols[i]), _NONE))
        return [s for s in symbols if s >= 0]

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        first = self.first
        return tuple(self.merge([first[b] for b in piece.encode("utf-8", "replace")]))

    def _round_trip_piece(self, piece: str) -> tuple[bytes, bytes]:
        ids = self._encode_piece(piece)
        return ",".join(map(str, ids)).encode(), b"".join(map(self.bytes_of.__getitem__, ids))

    def _parts(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Pre-tokens up to each special token, and that token; the last has none."""
        at = 0
        if self.cut:
            for m in self.cut.finditer(text):
                yield self.pieces.findall(text[at : m.start()]), m.group()
                at = m.end()
        yield self.pieces.findall(text[at:] if at else text), None

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; the strings of special tokens are those tokens."""
        out: list[int] = []
        for pieces, special in self._parts(text):
            out += chain.from_iterable(map(self.piece.__getitem__, pieces))
            if special is not None:
                out.append(self.special[special])
        return out

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a whole text as decimals joined by commas, and the bytes that the ids decode to."""
        ids: list[bytes] = []
        data: list[bytes] = []
        for pieces, special in self._parts(text):
            pairs = list(map(self.both_ways.__getitem__, pieces))
            ids += map(_FIRST, pairs)
            data += map(_SECOND, pairs)
            if special is not None:
                ids.append(b"%d" % self.special[special])
                data.append(self.bytes_of[self.special[special]])
        return b",".join(ids), b"".join(data)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(text: str) -> Codec:
    return kept("codec " + hashlib.sha256(text.encode()).hexdigest(), lambda: Codec(text))


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast: a few megabytes, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _columns(docs: DataFrame, vocab, id_col: str, text_col: str, fields: str, kinds: list, row: Callable) -> DataFrame:
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def make():
        c = codec(vocab.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [row(c, t or "") for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[] for _ in kinds]
            return batch_of([(id_col, batch.schema.field(0).type), *kinds], [batch.column(0), *cols])

        return each

    return src.mapInArrow(per_batch(make, keeps=True), f"`{id_col}` {id_type}, {fields}")


def encode(docs: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every document."""
    return _columns(docs, vocab, id_col, text_col, "ids array<int>", [("ids", pa.list_(pa.int32()))], lambda c, t: (c.encode(t),))


def decode(encoded: DataFrame, vocab, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from token ids; null ids give the empty text, bytes that are no UTF-8 give U+FFFD."""
    src = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    id_type = src.schema["id"].dataType.simpleString()

    def make():
        c = codec(vocab.value)
        return lambda b: batch_of([(id_col, b.schema.field(0).type), ("text", pa.string())], [b.column(0), [c.decode(i or []) for i in b.column(1).to_pylist()]])

    return src.mapInArrow(per_batch(make, keeps=True), f"`{id_col}` {id_type}, text string")


def _digest(ids: bytes, data: bytes) -> tuple[int, str, str]:
    decoded = data.decode("utf-8", "replace").encode()
    return ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def digests(docs: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the text."""

    def row(c: Codec, text: str):
        return _digest(*c.round_trip(text))

    return _columns(
        docs, vocab, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], row,
    )


def encoded_documents(docs: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded_sha256): token ids with the digests of their round trip."""

    def row(c: Codec, text: str):
        ids, data = c.round_trip(text)
        return list(map(int, ids.split(b","))) if ids else [], *_digest(ids, data)

    return _columns(
        docs, vocab, id_col, text_col, "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        [("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], row,
    )
