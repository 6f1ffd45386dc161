"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its 1- and 2-grams of tokens (words, and runs of other marks), hashed into ``2 ** BITS`` weights, a
2-gram of one word twice being one feature for all words; a
gram's value is its count over the square root of the number of grams, so that long and short texts are on one scale.  Training takes a bounded
sample: at most ``sample`` labelled rows, those with the smallest hash of their id.  The sample is dealt into ``parts`` tasks; each runs FTRL-proximal
over its rows and gives its weights and squared-gradient sums.  A round's model is, for each weight, the mean over the parts (by their rows) that have it non-zero, so that
rare grams are not shrunk; squared-gradient sums are averaged over the parts that met the gram, and the next round starts from both, so its per-coordinate rates go on
falling.  The model has a fixed size and is broadcast; scoring is one pass without a shuffle.

The quality label is the only thing learned from; lang, source, doc_id and labels are no inputs of a score.
Edge cases: null and empty texts score as the bias; labels that are null or have no document are ignored, rows that
repeat a doc_id are used as they come; without labelled rows every score is 0.5; an empty table gives no rows; extra columns are ignored.
A null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .textvec import Tokens, ngrams, pieces, tokens

BITS, SAMPLE, PARTS, ROUNDS, THRESHOLD = 18, 12_000, 4, 3, 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1.0
SIZE = 1 << BITS
REPEAT = np.uint64(0x9D39247E33776D41)


def features(column: pa.Array) -> tuple[Tokens, Tokens]:
    """Slots of the 1-grams and of the 2-grams of each text."""
    words = tokens(column, marks=True)
    pairs = ngrams(words, 2)
    if len(pairs.hash):  # a word said twice is one gram, whatever the word
        inner = np.ones(len(words.hash), bool)
        inner[words.offset[1:][words.count > 0] - 1] = False
        inner = np.flatnonzero(inner)
        pairs.hash[words.hash[inner] == words.hash[inner + 1]] = REPEAT
    slot = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
    return Tokens(slot(words.hash), words.offset), Tokens(slot(pairs.hash), pairs.offset)


def dots(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The sparse dot product of each text's features with the weights, and the bias (the last weight)."""
    if len(parts := pieces(column)) > 1:
        return np.concatenate([dots(column.slice(a, b - a), weights) for a, b in parts])
    ones, twos = features(column)
    total = np.zeros(len(ones.count))
    for t in (ones, twos):
        full = np.flatnonzero(t.count)
        if len(full):
            total[full] += np.add.reduceat(weights[t.hash], t.offset[full])
    return total / np.sqrt(np.maximum(ones.count + twos.count, 1)) + weights[SIZE]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], weights: np.ndarray, squares: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and squared-gradient sums after one pass over (slots, values, label) from the given ones; untouched weights stay as they are."""
    n = squares.astype(np.float64)
    z = -weights * ((BETA + np.sqrt(n)) / ALPHA + L2) - np.sign(weights) * L1
    for k in np.random.default_rng(seed).permutation(len(rows)):
        at, x, label = rows[k]
        zi, ni = z[at], n[at]
        w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        grown = ni + g * g
        z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
        n[at] = grown
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)), n


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last is the bias) from ``labels`` (doc_id, label 0 or 1)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    known = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = known.withColumn("order", order).orderBy("order", "doc_id", "label").limit(sample)
    part = F.pmod(F.xxhash64(F.lit(7), F.col("order")), F.lit(parts)).cast("int")
    # bounded by ``sample`` rows of two numbers and one text each
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "order", part.alias("part"))
    rows = scratch.keep(rows, "sample")
    weights, squares = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((weights, squares))

        def run(batches: Iterator[pa.RecordBatch], k=k, shared=shared) -> Iterator[pa.RecordBatch]:
            by_part: dict[int, list] = {}
            for batch in (whole.slice(a, b - a) for whole in batches for a, b in pieces(whole.column("text"))):
                ones, twos = features(batch.column("text"))
                for i, (p, y) in enumerate(zip(batch.column("part").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                    slots = np.concatenate([t.hash[t.offset[i] : t.offset[i + 1]] for t in (ones, twos)])
                    at, count = np.unique(slots, return_counts=True)
                    by_part.setdefault(p, []).append((np.append(at, SIZE), np.append(count / np.sqrt(max(len(slots), 1)), 1.0), y))
            for p, data in sorted(by_part.items()):
                got = [x.astype(np.float32).tobytes() for x in ftrl(data, *shared.value, seed=1000 * k + p)]
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([len(data)]), *(pa.array([x], pa.binary()) for x in got)], ["part", "rows", "weights", "squares"])

        # a range a part: hashed keys would meet in one task
        got = rows.repartitionByRange(parts, "part").sortWithinPartitions("part", "order", "label").mapInArrow(run, "part long, rows long, weights binary, squares binary").collect()
        if got:
            size = np.array([r["rows"] for r in got], float)
            each = np.stack([np.frombuffer(r["weights"], np.float32) for r in got])
            # a gram is averaged over the parts that have a weight for it, so that rare ones are not shrunk
            mean = lambda x, used: (x * used).sum(axis=0) / np.maximum(used.sum(axis=0), 1)
            weights = mean(each, (each != 0) * size[:, None])
            grown = np.stack([np.frombuffer(r["squares"], np.float32) for r in got])
            squares = np.maximum(squares, mean(grown, (grown != squares.astype(np.float32)) * size[:, None]))
        shared.unpersist()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` that are passed on by id: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dots(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, **options) -> np.ndarray:
    """The production model: quality labels of rows that are not held out."""
    return train(docs, labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")), **options)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: rows that score at or over the threshold stay, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels).astype(np.float32))
    at = docs.columns.index("text")
    cut = np.log(threshold / (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(dots(batch.column(at), shared.value) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
