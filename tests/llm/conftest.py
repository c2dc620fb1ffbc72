import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names clash with those that the operators use inside.
CLASHING = "id bigint, mark string, n int, cls string, size double, taken string, removed string, at int, score string, shingles int, rank int, target string"


def words(rng: random.Random, n: int, vocabulary: int = 60) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def sample_texts(seed: int = 3) -> list[str | None]:
    """Nulls, blanks, short and long texts, exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    out: list[str | None] = [None, "", "   \n\t ", "one", "One", "one two three four", "ONE two THREE four", "a b c d e", "a b c d e f"]
    base = words(rng, 120, 5000)
    out += [" ".join(base)] * 3
    for k in range(12):
        near = list(base)
        for _ in range(k // 2):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(near))
    passage = words(rng, 70, 5000)
    out += [" ".join(words(rng, 60, 5000) + passage + words(rng, 50, 5000)) for _ in range(12)]
    tiny = [f"t{i}" for i in range(12)]
    out += [" ".join(tiny[: 8 + k % 5]) for k in range(8)]
    out += [" ".join(words(rng, rng.randrange(1, 40), 8)) for _ in range(40)]
    out.append("é ü 你好 🙂\u2028 " * 300)
    out.append("z" * 30_000 + " " + "y " * 5000)
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rng = random.Random(5)
    sources = ["a", "a", "a", "a", "b", "c", "Z", None]
    rows = [(i, t, "en", rng.choice(sources), len(t) if t is not None else None) for i, t in enumerate(sample_texts())]
    rows += [rows[12], rows[12], (None, "null id one two three four five six", "en", "b", 30), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def wide_docs(docs):
    from pyspark.sql import functions as F

    for field in CLASHING.split(", "):
        name, kind = field.split(" ")
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def vocab(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from quire.llm.bpe import vocabulary

    return vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))


def same(a, b) -> bool:
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)
