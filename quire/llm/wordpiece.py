"""Token counts by a linear longest-match automaton (trie with failure links).

A word w is matched as " " + w, greedily longest first, against a byte-level vocabulary.  Every
trie node knows where to go on when no child fits (its failure link) and how many tokens are
popped on that way (its count), so each byte is read once and no piece is ever built.

Edge cases: null and empty text have no words and no tokens; a word of any length is matched
whole; words that the vocabulary cannot spell count as one unknown token; repeated rows count
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.bpe import byte_letters
from quire.llm.common import Memo, batch_of, kept, per_batch

_CACHED = 300_000


def pieces_of(text: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file, without special tokens."""
    spec = json.loads(text)
    byte_of = {c: b for b, c in byte_letters().items()}
    return [bytes(byte_of[c] for c in piece) for piece in spec["model"]["vocab"] if all(c in byte_of for c in piece)]


class Automaton:
    """child[node << 8 | byte], fail[node] (-1: none) and popped[node]."""

    def __init__(self, vocabulary: list[bytes]):
        child: dict[int, int] = {}
        ends, parent, byte = [False], [0], [0]
        for piece in vocabulary:
            node = 0
            for b in piece:
                nxt = child.get(node << 8 | b)
                if nxt is None:
                    nxt = child[node << 8 | b] = len(ends)
                    ends.append(False)
                    parent.append(node)
                    byte.append(b)
                node = nxt
            if node:
                ends[node] = True
        depth = [0] * len(ends)
        for i in range(1, len(ends)):
            depth[i] = depth[parent[i]] + 1
        fail, popped = [-1] * len(ends), [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                fail[v], popped[v] = 0, 1
                continue
            z, n = fail[parent[v]], popped[parent[v]]
            while z >= 0 and (z << 8 | byte[v]) not in child:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = child[z << 8 | byte[v]], n
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest-first split; 1 if there is no such split."""
        child, fail, popped = self.child.get, self.fail, self.popped
        node = n = 0
        for b in word:
            nxt = child(node << 8 | b)
            while nxt is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = child(node << 8 | b)
            node = nxt
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def automaton(text: str) -> Memo:
    """Token counts by word, for the vocabulary of a tokenizer file."""

    def build() -> Memo:
        a = Automaton(pieces_of(text))
        return Memo(lambda w: a.count(b" " + w), _CACHED)

    return kept("automaton " + hashlib.sha256(text.encode()).hexdigest(), build)


def token_counts(docs: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, longest_word_tokens) of every whole text."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def make():
        count = automaton(vocab.value)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            words, tokens, most = [], [], []
            for t in b.column(1).to_pylist():
                each_word = list(map(count.__getitem__, (t or "").encode().split()))
                words.append(len(each_word))
                tokens.append(sum(each_word))
                most.append(max(each_word, default=0))
            return batch_of([(id_col, b.schema.field(0).type), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("longest_word_tokens", pa.int64())], [b.column(0), words, tokens, most])

        return each

    return src.mapInArrow(per_batch(make, keeps=True), f"`{id_col}` {src.schema['id'].dataType.simpleString()}, n_words bigint, n_tokens bigint, longest_word_tokens bigint")
