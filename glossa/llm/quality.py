"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over chunks of ``CHUNK`` bytes that start every ``STEP`` bytes and cover the
whole document; each filter's largest response (max pooling) feeds a small dense layer and a sigmoid. Training (Adam,
on the driver) takes a bounded sample: at most about ``SAMPLE`` labelled texts of at most ``SAMPLE_CHARS``
characters. Scoring runs in blocks of bytes, so one very long text needs no more memory than a block.

Edge cases: null and empty texts are scored as one chunk of padding; without labelled rows every score is 0.5;
repeated rows get equal scores; nothing is learned from a doc_id whose labels differ or from labels and rows without
doc_id; rows without doc_id are scored and not held out; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, fold, slices, tidy

SAMPLE, SAMPLE_CHARS, THRESHOLD = 2_500, 200_000, 0.7
STEP, CHUNK, EMBED, FILTERS, HIDDEN = 4, 16, 6, 32, 16
PARTS, PAD = CHUNK // STEP, 256


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as int16 rows of STEP, each text padded to whole steps and to one chunk at least; first row of each text."""
    rows = np.maximum((np.diff(offsets) + STEP - 1) // STEP, PARTS)
    first = np.concatenate([[0], np.cumsum(rows)])
    out = np.full(first[-1] * STEP, PAD, np.int16)
    shift = np.repeat(first[:-1] * STEP - offsets[:-1], np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out.reshape(-1, STEP), first


@dataclass
class ConvNet:
    emb: np.ndarray  # 257 x EMBED
    conv: np.ndarray  # PARTS x (STEP * EMBED) x FILTERS
    conv_b: np.ndarray
    dense: np.ndarray
    dense_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Each filter's response at each chunk of consecutive rows: len(rows) - PARTS + 1 chunks."""
        x = self.emb[rows].reshape(len(rows), -1)
        n = len(rows) - PARTS + 1
        y = x[:n] @ self.conv[0]
        for k in range(1, PARTS):
            y += x[k : k + n] @ self.conv[k]
        return y

    def pooled(self, rows: np.ndarray, first: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The largest response of each filter in each text; chunks that cross texts don't count."""
        best = np.full((len(first) - 1, FILTERS), -np.inf, np.float32)
        last = len(rows) - PARTS + 1
        for a in range(0, last, block):
            y = self.responses(rows[a : min(a + block, last) + PARTS - 1])
            b = a + len(y)
            t0, t1 = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left")
            for k in range(1, PARTS):  # the chunks that begin in a text's last rows and end in the next text
                over = first[t0 + 1 : t1 + 1] - k
                y[over[(over >= a) & (over < b)] - a] = -np.inf
            top = np.maximum.reduceat(y, np.maximum(first[t0:t1], a) - a, axis=0)
            best[t0:t1] = np.maximum(best[t0:t1], top)
        return best

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.maximum(pooled + self.conv_b, 0)
        h = np.maximum(z @ self.dense + self.dense_b, 0)
        return z, h, 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_b, -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, first = padded(data, offsets)
        return self.head(self.pooled(rows, first))[2]


def train(texts: list[str], labels: list[int], *, passes: int = 40_000, batch: int = 32, seed: int = 3) -> ConvNet | None:
    """Adam on the log loss, about ``passes`` texts seen; through the max pooling only the winning chunks get a gradient."""
    if not texts:
        return None
    epochs = int(np.clip(passes // len(texts), 4, 60))
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    net = ConvNet(f32(257, EMBED, by=0.5), f32(PARTS, STEP * EMBED, FILTERS, by=0.15), np.zeros(FILTERS, np.float32), f32(FILTERS, HIDDEN, by=0.25), np.zeros(HIDDEN, np.float32), f32(HIDDEN, by=0.3), np.zeros((), np.float32))
    net.emb[PAD] = 0
    raw = [t.encode() for t in texts]
    y = np.array(labels, np.float32)
    names = list(net.__dataclass_fields__)
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    step, total = 0, epochs * -(-len(raw) // batch)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(raw)), -(-len(raw) // batch)):
            lens = np.array([len(raw[i]) for i in part])
            rows, first = padded(np.frombuffer(b"".join(raw[i] for i in part), np.uint8), np.concatenate([[0], np.cumsum(lens)]))
            y_all = net.responses(rows)
            win = np.empty((len(part), FILTERS), np.int64)
            for k in range(len(part)):
                a, b = first[k], first[k + 1] - PARTS + 1
                win[k] = a + y_all[a:b].argmax(0)
            pooled = y_all[win, np.arange(FILTERS)]
            z, h, p = net.head(pooled)
            d = (p - y[part]) / len(part)
            dh = np.outer(d, net.out) * (h > 0)
            dz = (dh @ net.dense.T) * (z > 0)
            around = rows[win[..., None] + np.arange(PARTS)]  # texts x filters x PARTS x STEP
            x = net.emb[around].reshape(len(part), FILTERS, PARTS, -1)
            g_x = dz[..., None, None] * net.conv.transpose(2, 0, 1)[None]
            g_emb = np.zeros_like(net.emb)
            np.add.at(g_emb, around.reshape(-1), g_x.reshape(-1, EMBED))
            g_emb[PAD] = 0
            grads = {"emb": g_emb, "conv": np.einsum("tf,tfpe->pef", dz, x, optimize=True), "conv_b": dz.sum(0), "dense": z.T @ dh, "dense_b": dh.sum(0), "out": h.T @ d, "out_b": d.sum()}
            step += 1
            rate = 0.01 * (1 - (step - 1) / total) + 1e-4
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(net, k, (getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> ConvNet | None:
    """Learn labels.quality from texts of rows whose fold (crc32 of doc_id, modulo 4) is not 2, by a bounded sample."""
    marked = labels.where((fold("doc_id", 4) != 2) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    marked = marked.where("quality = most").drop("most")
    share = int(1e6 * min(1.0, sample / max(1, marked.count()))) + 1
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    got = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return train([r[1] for r in got], [int(r[2] == 1) for r in got])


def score_quality(docs: DataFrame, net: ConvNet | None) -> DataFrame:
    """doc_id and the score of every whole text."""
    schema = docs.select("doc_id").schema.add("score", "double")

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            score = np.full(len(batch), 0.5)
            if net is not None:
                for i, j in slices(offsets, 1 << 20):
                    score[i:j] = net.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, net).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
