"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over
each chunk's byte embeddings; their activations are max- and mean-pooled over the chunk, a small
hidden layer judges the chunk, and the chunks' judgements, max- and mean-pooled over the document,
are combined into one probability.

The network is trained on the driver from a bounded sample of labelled rows (``SAMPLE`` rows, over
all bytes of each) until a split of these rows shows no more gain; then all of them go through the
passes found. A batch's chunks are worked on in pieces of ``PIECE`` by ``THREADS`` threads, and the
pieces' gradients are added in order, so a text of any length needs little memory and the threads do
not change the result. Every document is scored over all of its bytes on the executors, in groups of
``GROUP`` chunks, so memory is bounded there too. Only the text enters a score.

Defined cases: null and empty texts are one chunk of padding; very long texts are read whole; repeated rows get equal scores; labels
without a quality are ignored and of several for one doc_id the smallest counts; without labels all
scores are 0.5, with labels of one value they are that value; a null doc_id is never held out; an
empty table gives no rows; extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, pick, pieces, sealed, written

CHUNK, STEP = 256, 192
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 6, 24, 16
SAMPLE, BATCH, RATE, SEED = 4000, 32, 3e-3, 11
#: Chunks that a thread works on at a time, and of a batch whose activations are kept between its two passes; those of larger batches are computed again.
PIECE, THREADS, KEPT = 128, 4, 2048
#: Training goes by rounds of whole passes with ROUND steps at least. After PATIENCE rounds without a GAIN in the loss of the split (one row in SPLIT) it goes back to the best and on with the next rate of FALLS, and ends after the last.
ROUND, PATIENCE, GAIN, FALLS, SPLIT = 80, 3, 1e-3, (1, 0.2), 7
GROUP = 256
THRESHOLD = 0.3
PAD = 256


def chunk_starts(n: int) -> range:
    """Chunk starts that cover n bytes, neighbours sharing CHUNK - STEP."""
    return range(0, max(1, n - (CHUNK - STEP)), STEP)


def _chunks(data: bytes, starts) -> np.ndarray:
    padded = np.full(max(len(data), (starts[-1] if len(starts) else 0) + CHUNK), PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.stack([padded[s : s + CHUNK] for s in starts])


def _windows(x: np.ndarray) -> np.ndarray:
    """(chunks, positions, WIDTH * EMBED) of (chunks, CHUNK, EMBED), copied for one matrix product."""
    m, _, e = x.shape
    view = np.lib.stride_tricks.as_strided(x, (m, (CHUNK - WIDTH) // STRIDE + 1, WIDTH * e), (x.strides[0], STRIDE * x.strides[1], x.strides[2]))
    return np.ascontiguousarray(view)


@dataclass
class Model:
    """weights: by name; None scores all texts ``constant``."""

    weights: dict | None
    constant: float = 0.5

    def chunk_scores(self, chunks: np.ndarray, keep: dict | None = None) -> np.ndarray:
        w = self.weights
        x = _windows(w["embed"][chunks])
        a = x.reshape(-1, x.shape[2]) @ w["filters"]
        a += w["bias"]
        np.maximum(a, 0, out=a)
        a = a.reshape(len(chunks), -1, FILTERS)
        pooled = np.concatenate([a.max(1), a.mean(1)], 1)
        z = pooled @ w["hidden"] + w["hidden_bias"]
        if keep is not None:
            keep |= {"x": x, "a": a, "pooled": pooled, "z": z}
        return np.maximum(z, 0)

    def score(self, data: bytes) -> float:
        """The probability of label 1, over all chunks of a text."""
        if self.weights is None:
            return self.constant
        starts = chunk_starts(len(data))
        top, total = None, np.zeros(HIDDEN)
        for k in range(0, len(starts), GROUP):
            part = starts[k : k + GROUP]
            h = self.chunk_scores(_chunks(data[part[0] : part[-1] + CHUNK], range(0, len(part) * STEP, STEP)))
            top = h.max(0) if top is None else np.maximum(top, h.max(0))
            total += h.sum(0)
        return self._probability(top, total / len(starts))

    def _probability(self, top, mean) -> float:
        out = np.concatenate([top, mean]) @ self.weights["out"] + self.weights["out_bias"][0]
        return round(float(1 / (1 + np.exp(-np.clip(out, -30, 30)))), 6)

    def scores(self, texts: list[bytes]) -> list[float]:
        """score of each text; short texts share matrix products."""
        if self.weights is None:
            return [self.constant] * len(texts)
        found, waiting, size = [0.0] * len(texts), [], 0

        def flush():
            if waiting:
                h = self.chunk_scores(np.concatenate([c for _, c in waiting]))
                at = 0
                for k, c in waiting:
                    own = h[at : at + len(c)]
                    found[k] = self._probability(own.max(0), own.mean(0))
                    at += len(c)
                waiting.clear()

        for k, data in enumerate(texts):
            starts = chunk_starts(len(data))
            if len(starts) >= GROUP:
                found[k] = self.score(data)
                continue
            if size + len(starts) > GROUP:
                flush()
                size = 0
            waiting.append((k, _chunks(data, starts)))
            size += len(starts)
        flush()
        return found


def train(samples: list[tuple[bytes, int]], seed: int = SEED) -> Model:
    """samples: texts and their labels. Adam on the cross entropy until it has converged.

    The passes and their rates are found on all samples but a split of them, by the loss of the split, and then gone through with all.
    """
    labels = np.array([y for _, y in samples], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, float(labels[0]) if len(labels) else 0.5)
    texts = [_chunks(data, chunk_starts(len(data))) for data, _ in samples]
    with ThreadPoolExecutor(THREADS) as pool:
        rates = _schedule(texts, labels, seed, pool)
        trainer = _Trainer(texts, labels, np.arange(len(texts)), seed, pool)
        for rate in rates:
            trainer.go(rate)
    return trainer.model


def _schedule(texts: list[np.ndarray], labels: np.ndarray, seed: int, pool) -> list[float]:
    """The rate of each pass up to the least loss of the split; without both labels in split and rest, the loss is that of all rows."""
    aside = np.random.default_rng(seed).permutation(len(texts)) % SPLIT == 0
    rest, split = np.flatnonzero(~aside), np.flatnonzero(aside)
    if min(len(set(labels[rest])), len(set(labels[split]))) < 2:
        rest = split = np.arange(len(texts))
    trainer, rates, best = _Trainer(texts, labels, rest, seed, pool), [], np.inf
    kept, passes = trainer.state(), -(-ROUND * BATCH // len(rest))
    for fall in FALLS:
        trainer.back(kept)
        idle, tried = 0, []
        while idle < PATIENCE:
            for _ in range(passes):
                trainer.go(RATE * fall)
                tried.append(RATE * fall)
            loss = trainer.loss(split)
            idle = 0 if loss < best - GAIN else idle + 1
            if loss < best:
                best, kept, rates, tried = loss, trainer.state(), rates + tried, []
    return rates


class _Trainer:
    """Passes of Adam over the texts at ``rows``."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, seed: int, pool):
        self.texts, self.labels, self.rows, self.pool, self.rng, self.step = texts, labels, rows, pool, np.random.default_rng(seed), 0

        def normal(*shape, by):
            return (self.rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)

        w = {"embed": normal(257, EMBED, by=EMBED), "filters": normal(WIDTH * EMBED, FILTERS, by=WIDTH * EMBED / 2), "bias": np.zeros(FILTERS, np.float32), "hidden": normal(2 * FILTERS, HIDDEN, by=FILTERS), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, by=2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
        self.model, self.first, self.second = Model(w), {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}

    def go(self, rate: float) -> None:
        """One pass."""
        order, w, first, second = self.rng.permutation(self.rows), self.model.weights, self.first, self.second
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            g, self.step = _gradients(self.model, [self.texts[i] for i in own], self.labels[own], self.pool), self.step + 1
            for name, value in g.items():
                first[name] = 0.9 * first[name] + 0.1 * value
                second[name] = 0.999 * second[name] + 0.001 * value**2
                w[name] -= (rate * (first[name] / (1 - 0.9**self.step)) / (np.sqrt(second[name] / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)

    def state(self) -> tuple:
        return deepcopy((self.model.weights, self.first, self.second, self.step))

    def back(self, state: tuple) -> None:
        """Go on from a state."""
        self.model.weights, self.first, self.second, self.step = deepcopy(state)

    def loss(self, rows: np.ndarray) -> float:
        """The mean cross entropy of the texts at ``rows``."""

        def one(i):
            h = np.concatenate([self.model.chunk_scores(self.texts[i][k : k + GROUP]) for k in range(0, len(self.texts[i]), GROUP)])
            p = min(max(self.model._probability(h.max(0), h.mean(0)), 1e-6), 1 - 1e-6)
            return -np.log(p if self.labels[i] else 1 - p)

        return sum(self.pool.map(one, rows)) / len(rows)


def _gradients(model: Model, texts: list[np.ndarray], labels: np.ndarray, pool) -> dict:
    """Of the mean cross entropy of a batch of texts (their chunks)."""
    w = model.weights
    chunks, sizes = np.concatenate(texts), np.array([len(x) for x in texts])
    at, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
    parts = [slice(k, k + PIECE) for k in range(0, len(chunks), PIECE)]

    def forward(part):
        kept = {}
        h = model.chunk_scores(chunks[part], kept)
        return h, kept if len(chunks) <= KEPT else None

    done = list(pool.map(forward, parts))
    h = np.concatenate([x for x, _ in done])
    top, mean = np.maximum.reduceat(h, at, axis=0), np.add.reduceat(h, at, axis=0) / sizes[:, None]
    doc = np.concatenate([top, mean], 1)
    p = 1 / (1 + np.exp(-np.clip(doc @ w["out"] + w["out_bias"][0], -30, 30)))
    d_out = ((p - labels) / len(labels)).astype(np.float32)
    d_doc = d_out[:, None] * w["out"]
    hit = h == top[of]
    hit = hit / np.add.reduceat(hit, at, axis=0)[of]
    d_h = (hit * d_doc[of, :HIDDEN] + (d_doc[:, HIDDEN:] / sizes[:, None])[of]).astype(np.float32)

    def backward(part, kept):
        if kept is None:
            kept = {}
            model.chunk_scores(chunks[part], kept)
        return _piece_gradients(model, chunks[part], kept, d_h[part])

    g = {"out": doc.T @ d_out, "out_bias": np.array([d_out.sum()], np.float32)}
    for found in pool.map(backward, parts, [kept for _, kept in done]):
        for name, value in found.items():
            g[name] = g[name] + value if name in g else value
    return g


def _piece_gradients(model: Model, chunks: np.ndarray, kept: dict, d_h: np.ndarray) -> dict:
    w, x, a, pooled = model.weights, kept["x"], kept["a"], kept["pooled"]
    d_z = d_h * (kept["z"] > 0)
    g = {"hidden": pooled.T @ d_z, "hidden_bias": d_z.sum(0)}
    d_pooled = d_z @ w["hidden"].T
    positions = a.shape[1]
    d_a = np.repeat((d_pooled[:, FILTERS:] / positions)[:, None, :], positions, 1).astype(np.float32)
    best, rows, cols = a.argmax(1), np.arange(len(a))[:, None], np.arange(FILTERS)[None]
    d_a[rows, best, cols] += d_pooled[:, :FILTERS]
    d_a *= a > 0
    flat = d_a.reshape(-1, FILTERS)
    g |= {"filters": x.reshape(-1, x.shape[2]).T @ flat, "bias": flat.sum(0)}
    # windows start STRIDE bytes apart, so the gradient of the embedded bytes is added up in steps of that many bytes
    steps, width = WIDTH // STRIDE, STRIDE * EMBED
    d_x = (flat @ w["filters"].T).reshape(len(chunks), positions, steps, width)
    d_e = np.zeros((len(chunks), CHUNK // STRIDE, width), np.float32)
    for j in range(steps):
        d_e[:, j : j + positions] += d_x[:, :, j]
    ids, d_e = chunks.ravel().astype(np.int64), d_e.reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(ids, d_e[:, e], 257) for e in range(EMBED)], 1).astype(np.float32)
    return g


def held_out(doc_id="doc_id"):
    """Rows whose labels are kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Train on at most ``sample`` labelled rows that are not held out: the first by hashes of doc_id and text, so reruns agree.

    The broadcast sides are at most ``sample`` rows of three numbers; the driver gets the texts of as many rows.
    """
    marks = pick(labels, doc_id=doc_id, label=label).filter("label is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = marks.filter(~held_out()).groupBy("doc_id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.xxhash64("text"))
    first = rows.select("doc_id", "row").join(F.broadcast(marks), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(sample)
    first = written(first, "sample")  # several rows may have one doc_id
    got = rows.join(F.broadcast(first), ["doc_id", "row"]).select("doc_id", "row", "label", "text").dropDuplicates(["doc_id", "row"]).collect()
    return train([((r.text or "").encode(), r.label) for r in sorted(got, key=lambda r: (r.doc_id, r.row))])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs (their columns, or only ``keep``) with score and predicted, over every byte of every text."""
    names = keep if keep is not None else docs.columns
    plain, _ = sealed(docs, text)
    own = [plain.columns[docs.columns.index(c)] for c in names]
    schema = ", ".join([*(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in own), "_score double", "_predicted int"])

    def run(batches):
        import pyarrow as pa

        for piece in pieces(batches, 1024):
            got = model.scores(as_bytes(piece.column(text)))
            cols = [piece.column(c) for c in own] + [pa.array(got, pa.float64()), pa.array([int(x >= threshold) for x in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, "_score", "_predicted"])

    return plain.select(*dict.fromkeys([*own, text])).mapInArrow(run, schema).toDF(*names, "score", "predicted")


def filter_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, that score at least ``threshold``."""
    plain, restored = sealed(docs, text)
    at = plain.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches, 1024):
            yield batch.filter(pa.array([x >= threshold for x in model.scores(as_bytes(batch.column(at)))]))

    return restored(plain.mapInArrow(run, plain.schema))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score(rows, fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
