"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network over them.

1. *Word vectors.* Every hashed word has a fixed sparse index vector of a few ones and minus ones. Over the whole
   corpus each word adds up the index vectors of its neighbours (two to either side); Spark sums the tables of all
   partitions per word. Words are hashed to a fixed number of buckets, so the table that goes to the driver and back
   to the tasks has a size that does not depend on the data (``BUCKETS * DIMS`` numbers, 6 MB). A word's shape (lower
   case, capitals, number, signs) is a word of its own.
2. *Pooling.* A document is the mean and the deviation of its words' vectors.
3. *Network.* A hidden layer of ``tanh`` units and a logistic output, fitted in numpy on labelled documents; the
   temperature that divides the output is fitted on labelled documents kept apart from that fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, utf8
from quarry.llm.tokens import SHAPES, hashed_words

BUCKETS, DIMS, NONZERO, WINDOW = 32768, 48, 4, 2
#: The network is fitted on at most so many labelled documents, those with the smallest hash of their id.
MAX_LABELLED = 8000
THRESHOLD = 0.7
#: Texts are taken in groups of about so many bytes, so that memory does not depend on a batch.
GROUP_BYTES = 1 << 18


def index_vectors() -> np.ndarray:
    """Each bucket's fixed sparse vector of ones and minus ones."""
    rng = np.random.default_rng(20240229)
    out = np.zeros((BUCKETS + 1, DIMS), dtype=np.int8)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIMS, BUCKETS)] = rng.choice(np.array([-1, 1], dtype=np.int8), BUCKETS)
    return out


def groups_of(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of word vectors over all of ``docs``, each of length one (zero for words that never occur)."""
    names = [f"c{i}" for i in range(DIMS)]
    schema = "bucket int, " + ", ".join(f"{c} long" for c in names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, sums = index_vectors(), np.zeros((BUCKETS, DIMS), dtype=np.int64)
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            for a, b in groups_of(texts):
                words, shapes, owner = hashed_words(texts[a:b], BUCKETS)
                if not len(words):
                    continue
                line = np.full(len(words) + 2 * WINDOW * (owner[-1] + 1) + WINDOW, BUCKETS)
                line[np.arange(len(words)) + 2 * WINDOW * owner + WINDOW] = words
                at = np.flatnonzero(line != BUCKETS)
                near = np.zeros((len(words), DIMS), dtype=np.int16)
                for step in range(-WINDOW, WINDOW + 1):
                    if step:
                        near += signs[line[at + step]]
                for ids in (words, shapes):
                    order = np.argsort(ids, kind="stable")
                    ranked = ids[order]
                    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                    sums[ranked[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int32)
        used = np.flatnonzero(sums.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), *[pa.array(np.ascontiguousarray(sums[used, i])) for i in range(DIMS)]], ["bucket", *names]
            )

    parts = docs.select(utf8(text).alias("raw")).mapInArrow(add, schema)
    total = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    found = total.toArrow()
    if found.num_rows:
        values = np.stack([found.column(c).to_numpy() for c in names], axis=1).astype(np.float64)
        norms = np.linalg.norm(values, axis=1, keepdims=True)
        out[found.column("bucket").to_numpy()] = values / np.where(norms == 0, 1, norms)
    return out


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of each text's word vectors and of its words' shapes; zeros for a text without words."""
    width = 2 * DIMS + SHAPES + 1
    out = np.zeros((len(texts), width), dtype=np.float32)
    words, shapes, owner = hashed_words(texts, BUCKETS)
    if not len(words):
        return out
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    count = np.diff(np.append(first, len(words)))[:, None]
    rows = vectors[words] + vectors[shapes]
    mean = np.add.reduceat(rows, first, axis=0, dtype=np.float64) / count
    rows *= rows
    square = np.add.reduceat(rows, first, axis=0, dtype=np.float64) / count
    at = owner[first]
    out[at, :DIMS] = mean
    out[at, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[at, 2 * DIMS : -1] = np.bincount(owner * SHAPES + shapes, minlength=len(texts) * SHAPES).reshape(-1, SHAPES)[at] / count
    out[:, -1] = np.log1p(np.bincount(owner, minlength=len(texts))) / 10
    return out


@dataclass
class Network:
    """``inputs -> tanh -> logistic``, its output divided by ``temperature``."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, seed: int = 7) -> Network:
        """Adam on the cross entropy of four fifths; the temperature with the least loss on the other fifth.

        Without labels of both kinds the network answers their share for every text.
        """
        rng = np.random.default_rng(seed)
        x = x.astype(np.float64)
        centre, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        scale = np.where(scale < 1e-6, 1, scale)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
        if len(set(y.tolist())) < 2:
            share = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
            return cls(centre, scale, w[0], w[1], w[2], float(np.log(share / (1 - share))))
        w[2] = rng.normal(0, 1 / np.sqrt(hidden), hidden)
        order = rng.permutation(len(x))
        apart, used = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - centre) / scale
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for epoch in range(epochs):
            rng.shuffle(used)
            for i in range(0, len(used), batch):
                rows = used[i : i + batch]
                h = np.tanh(z[rows] @ w[0] + w[1])
                g = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[rows]) / len(rows)
                back = g[:, None] * w[2] * (1 - h * h)
                grads = [z[rows].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ g + 1e-4 * w[2], np.array([g.sum()])]
                t += 1
                for k, grad in enumerate(grads):
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    rate = 0.005 * (1 - epoch / epochs)
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        net = cls(centre, scale, w[0], w[1], w[2], float(w[3][0]))
        if len(apart):
            logits, truth = net.logits(x[apart]), y[apart]

            def loss(temperature: float) -> float:
                return float(np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / temperature).mean())

            net.temperature = min((0.5 * 1.15**k for k in range(25)), key=loss)
        return net


def _features(docs: DataFrame, vectors, extra: list[str], text: str = "text") -> DataFrame:
    schema = ", ".join([*[f"{c} {dict(docs.dtypes)[c]}" for c in extra], "x binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(len(extra)).to_pylist()
            for a, b in groups_of(texts):
                x = pooled(texts[a:b], vectors.value)
                columns = [batch.column(i).slice(a, b - a) for i in range(len(extra))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in x], pa.binary())], [*extra, "x"])

    return docs.select(*extra, utf8(text).alias("raw")).mapInArrow(run, schema)


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id, score`` of every row: 0 to 1, higher is likelier good. Null and empty texts are scored as empty."""
        shared = docs.sparkSession.sparkContext.broadcast((self.vectors, self.network))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, network = shared.value
            for batch in slices(batches):
                texts = batch.column(1).to_pylist()
                for a, b in groups_of(texts):
                    scores = network.scores(pooled(texts[a:b], vectors))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores)], ["doc_id", "score"])

        return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("raw")).mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit on ``docs`` (all of them for the word vectors) and ``labels`` (``doc_id, quality`` with 0 or 1).

    Null labels and labels of other values count as none; of several labels of one document the highest holds. At most
    ``max_labelled`` labelled documents are used for the network, the same ones for the same ids; rows that repeat an id count
    each.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text)
    shared = spark.sparkContext.broadcast(vectors)
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = plain.join(F.broadcast(chosen), "doc_id")
    first = _features(rows, shared, ["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_labelled)
    found = first.orderBy("doc_id", "x").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), dtype=np.float32).reshape(-1, 2 * DIMS + SHAPES + 1)
    return QualityModel(vectors, Network.fit(x, found.column("y").to_numpy().astype(np.float64)))


def held_out(column: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


def production_model(documents: DataFrame, labels: DataFrame) -> QualityModel:
    """The model of the query and the pipeline: labels whose crc32(doc_id) mod 4 is 2 are never looked at."""
    return fit(documents, labels.filter(~held_out("doc_id", 4, 2)))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their own columns. Each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.network))
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            for a, b in groups_of(texts):
                good = network.scores(pooled(texts[a:b], vectors)) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = production_model(documents, table(spark, sf_dir, "labels")).score(documents)
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", predicted.alias("predicted"))
