"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are shares and means of a whole text's bytes, words and lines. The trees learn from a bounded sample of
labelled rows (`sample` rows, those of the least hashes of their ids; every row whose crc32(id) mod 5 is 0 is held out)
and score every document. Labels, language, source and id are never inputs of a score.

Defined results: a null text is empty and gets the score of the empty text; labels that are null or not 0 or 1 teach
nothing; of repeated labels of one id the different ones count, each once, and of repeated documents of one id the one
with the least statistics teaches; no labels at all give the score 0.5; rows with null ids are held out
of learning and scored; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.boosting import Model, train

FOLDS, SAMPLE, CUTOFF = 5, 20_000, 0.3
NAMES = (
    "bytes words lines mean_word max_word distinct_words upper lower digit space high punct odd repeated_mark top_byte distinct_bytes "
    "distinct_lines short_lines words_line top_word upper_words marked_words"
).split()


def _classes() -> np.ndarray:
    out = np.zeros((8, 256), np.int64)
    for k, group in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 10, 11, 12, 13), range(128, 256), b".,;:'\"!?()-", b"|#$%&*@^~<>{}[]=+_\\/`", range(32))):
        out[k, list(group)] = 1
    return out


CLASSES = _classes()
MARKS = np.array([c in b"|#$%&*@^~<>{}[]=+_\\/`!?" for c in range(256)])


def statistics(text: str | None) -> list[float]:
    """The features of one whole text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    shares = CLASSES @ counts / len(raw)
    words = raw.lower().split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = raw.splitlines() or [raw]
    marked = MARKS[data]
    own = set(words)
    n = max(1, len(words))
    ends = np.flatnonzero((data[1:] <= 32) & (data[:-1] > 32))
    tail = int(MARKS[data[ends]].sum()) if len(ends) else 0
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        float(np.log1p(len(lines))),
        float(lengths.mean()),
        float(min(lengths.max(), 1000)),
        len(own) / n,
        *map(float, shares[:6]),
        float(shares[6]),
        float((marked[1:] & (data[1:] == data[:-1])).sum()) / len(raw),
        float(counts.max()) / len(raw),
        float(np.count_nonzero(counts)),
        len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        float(min(len(words) / len(lines), 1000)),
        n / max(1, len(own)),
        float(((data[:-1] <= 32) & (data[1:] >= 65) & (data[1:] <= 90)).sum()) / n,
        tail / n,
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    """The statistics of texts, row by row."""
    return np.array([statistics(t.as_py()) for t in texts], float).reshape(-1, len(NAMES))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(matrix(b.column(1))), pa.list_(pa.float64()))], ["id", "y", "x"])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Trees learnt from at most `sample` labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & ~held_out(F.col("id"))).distinct()
    taken = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample)  # bounded: `sample` rows of two numbers
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(taken), F.col("__doc") == F.col("id"))
    kind = labels.schema[id_col].dataType.simpleString()
    got = rows.select("id", "text", "y").mapInArrow(_features, f"id {kind}, y double, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x")).toPandas()
    x, y = np.array(got.x.tolist(), float).reshape(-1, len(NAMES)), got.y.to_numpy(float)
    order = np.lexsort([y, *x.T])  # rows come in any order; sums of floats should not
    return train(x[order], y[order])


def probability(text: Column, trees: Model) -> Column:
    """The score of a text: only the text goes to Python, and only a number comes back."""

    @F.arrow_udf("double")
    def go(texts: pa.Array) -> pa.Array:
        return pa.array(trees.probability(matrix(texts)))

    return go(text.cast("string"))


def score(docs: DataFrame, trees: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted."""
    scored = docs.select(F.col(id_col).alias("doc_id"), probability(F.col(text_col), trees).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, trees: Model, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs` that the trees accept, with all their columns."""
    return docs.where(probability(F.col(text_col), trees) >= cutoff)
