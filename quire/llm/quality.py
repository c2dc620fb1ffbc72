"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on binned statistics of a bounded sample of labelled documents, flattened into
arrays, and traversed for a whole batch at once in numpy.

Edge cases: null text scores as the empty text, which has statistics (all zero) and so a score;
texts of any length are read whole; labels that are null or neither 0 nor 1 are ignored, several
labels of one document count as their majority (ties as 1); with no usable label, or only one
class, the score is the share of label 1 (0.5 without labels); repeated rows score alike; a null
doc_id is never held out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of, per_batch, sliced
from quire.runtime import ship

#: The bound on labelled rows that the trees are grown from; scoring covers every row.
MAX_TRAIN = 20_000
THRESHOLD = 0.7

STATISTICS = ("log_words", "log_chars", "word_length", "upper", "digit", "symbol", "wide", "space", "bare_symbol_words", "symbol_ended_words", "distinct_words", "repeated_next", "top_word", "distinct_lines", "words_per_line", "lower_started_lines", "distinct_pairs", "short_words")

_CLASS = np.zeros(256, np.uint8)  # 0 symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[32, 9, 10, 11, 12, 13]] = 4


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
    symbol, lower, upper, digit, space, wide = (kinds / size).tolist()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ended = bare = short = 0
    for w, c in counts.items():
        if len(w) < 3:
            short += c
        if not w[-1:].isalnum() and w[-1] < 128:
            if len(w) < 2 or (not w[-2:-1].isalnum() and w[-2] < 128):
                ended += c
            if not any(b > 127 or 97 <= b | 32 <= 122 or 48 <= b <= 57 for b in w):
                bare += c
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    return [
        float(np.log1p(n)), float(np.log1p(size)), sum(map(len, words)) / n, upper / max(lower + upper, 1e-9), digit, symbol, wide, space,
        bare / n, ended / n, len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
        len(set(filled)) / len(filled), n / len(filled), sum(x[:1].islower() for x in filled) / len(filled),
        len(set(zip(words, words[1:]))) / max(1, n - 1), short / n,
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node k's children are 2k+1 and 2k+2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a value above it goes right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            out[lo : lo + 2048] += self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0) -> Trees:
    """Logistic boosting; each level of a tree is one histogram of gradients by (node, statistic, bin)."""
    share = float(np.mean(y)) if len(y) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(p / (1 - p))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    base = float(np.log(share / (1 - share)))
    f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin <= k exactly when x <= cuts[k]
    score = np.full(len(y), base)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)  # within the level
        for d in range(depth):
            width = 2**d
            best = np.full(width, 1e-9)
            pick = np.full((width, 2), -1)
            for j in range(f):
                if not len(cuts[j]):
                    continue
                at = node * bins + binned[:, j]
                gs = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < 1.0) | (ha - hl < 1.0)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = (top > best) & (k < len(cuts[j]))
                best[better] = top[better]
                pick[better] = np.stack([np.full(width, j), k], axis=1)[better]
            for i in range(width):
                j, k = pick[i]
                if j >= 0:
                    feature[t, width - 1 + i], cut[t, width - 1 + i] = j, cuts[j][k]
            node = 2 * node + (x[np.arange(len(y)), feature[t, width - 1 + node]] > cut[t, width - 1 + node])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -rate * gs / (hs + ridge)
        score += leaf[t][node]
    return Trees(base, depth, feature, cut, leaf)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Trees:
    """Grow trees from at most `max_train` labelled documents that are not held out.

    Which ones is decided by a hash of their id, so the sample is the same on every run.
    """
    mark = F.xxhash64("id")
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("id")))
    sample = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(mark, "id").limit(max_train)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")

    def make():
        return lambda b: batch_of(
            [("id", b.schema.field(0).type), ("y", pa.int32()), ("x", pa.list_(pa.float64()))],
            [b.column(0), b.column(1), [statistics(t) for t in b.column(2).to_pylist()]],
        )

    rows = src.mapInArrow(per_batch(make), f"id {src.schema['id'].dataType.simpleString()}, y int, x array<double>")
    got = rows.orderBy(mark, "id", "x").limit(max_train).select("y", "x").collect()  # at most max_train short rows
    x = np.array([r.x for r in got], float).reshape(len(got), len(STATISTICS))
    return grow(x, np.array([r.y for r in got], float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document; only the text is an input of the score."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def make():
        def each(b):
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(b.num_rows, len(STATISTICS))
            return batch_of([(id_col, b.schema.field(0).type), ("score", pa.float64())], [b.column(0), model.value.score(x)])

        return each

    scored = src.mapInArrow(per_batch(make), f"`{id_col}` {src.schema['id'].dataType.simpleString()}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least THRESHOLD."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in sliced(batches):
            x = np.array([statistics(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], float).reshape(b.num_rows, len(STATISTICS))
            yield b.filter(pa.array(model.value.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
