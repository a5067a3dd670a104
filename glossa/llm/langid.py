"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its byte 2-, 3- and 4-grams (A-Z lower-cased, other ASCII non-letters as spaces), hashed to
buckets. The mean of their embeddings goes through a linear softmax. Training runs on the driver over a bounded
sample (``SAMPLE_PER_LANG`` texts a language, of at most ``SAMPLE_CHARS`` characters each); the fitted product of both
layers, a table of buckets by languages, goes to the executors. Scores are calibrated by a temperature fitted on a
part of the sample left out of training, and a text is rejected if its score is below the threshold found there.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected; ties go to the first
language in byte order; rows without doc_id are predicted, not held out and never learned from; repeated rows get equal
results; very long texts run in blocks of texts; an empty table or one without labels gives ``und`` for all; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER_TO_LOWER, flat, fold, shielded, slices, tidy

SAMPLE_PER_LANG, SAMPLE_CHARS, SAMPLE_LANGS = 500, 200_000, 200
BUCKETS, WIDTH, SIZES = 1 << 15, 16, (2, 3, 4)
LETTER = regex.compile(r"\p{L}")
PLAIN = UPPER_TO_LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each position that has one."""
    m = max(0, len(data) - n + 1)
    v = np.full(m, n, np.uint32)
    for k in range(n):
        v = v * np.uint32(257) + data[k : k + m]
    v *= np.uint32(0x9E3779B1)
    return v >> np.uint32(32 - BUCKETS.bit_length() + 1)


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean table row of all n-grams of each text; n-grams never cross texts."""
        data = PLAIN[data]
        total, count = np.zeros((len(offsets) - 1, len(self.langs))), np.zeros(len(offsets) - 1)
        for n in SIZES:
            sums = np.zeros((max(0, len(data) - n + 1) + 1, len(self.langs)))
            np.cumsum(self.table[grams(data, n)], axis=0, dtype=np.float64, out=sums[1:])
            a, b = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)
            total += sums[np.minimum(b, len(sums) - 1)] - sums[np.minimum(a, len(sums) - 1)]
            count += b - a
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(data, offsets) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], *, epochs: int = 6, seed: int = 7) -> LangModel | None:
    """SGD over one text at a time; every fifth text calibrates instead."""
    names = tuple(sorted(set(langs)))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    docs = []
    for text in texts:
        raw = PLAIN[np.frombuffer(text.encode(), np.uint8)]
        where, count = np.unique(np.concatenate([grams(raw, n) for n in SIZES]), return_counts=True)
        docs.append((where, (count / max(1, count.sum())).astype(np.float32)))
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(docs))
    held, fit = order[::5], np.array([i for k, i in enumerate(order) if k % 5 or len(order) < 10])
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            where, weight = docs[i]
            mean = weight @ emb[where]
            g = softmax((mean @ out + bias)[None])[0]
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= 0.1 * rate * g
            emb[where] -= (10 * rate) * np.outer(weight, back)
    table = emb @ out
    logits = np.array([docs[i][1] @ table[docs[i][0]] + bias for i in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = min(np.geomspace(0.25, 50, 60), key=loss)
    right = softmax(logits / temperature).max(1)
    threshold = min(0.5, float(np.quantile(right, 0.001)) * 0.9)
    return LangModel(names, table.astype(np.float32), bias, float(temperature), threshold)


def fit_language(docs: DataFrame, *, per_lang: int = SAMPLE_PER_LANG, max_chars: int = SAMPLE_CHARS, langs: int = SAMPLE_LANGS) -> LangModel | None:
    """Learn from text and lang of rows whose fold (crc32 of doc_id, modulo 5) is not 0, by a bounded sample: of the langs most frequent languages, about per_lang texts each."""
    rows = docs.where((fold("doc_id", 5) != 0) & F.col("lang").isNotNull() & (F.length("text") <= max_chars))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs)
    share = F.floor(1e6 * F.least(F.lit(1.0), per_lang / F.col("count"))).cast("long") + 1
    some = rows.join(F.broadcast(counts.select("lang", share.alias("__share"))), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("__share"))
    got = some.select("doc_id", "text", "lang").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r[0], r[1]))
    return train([r[1] for r in got], [r[2] for r in got])


def predict_language(docs: DataFrame, model: LangModel | None, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred, score and rejected for every whole text, beside doc_id and the columns in keep."""
    schema = docs.select("doc_id", *keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names = ["doc_id", *keep]

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            data, offsets = flat(text)
            lang, score = np.full(len(text), "und", object), np.zeros(len(text))
            letter = np.array([bool(LETTER.search(t)) if (t := x.as_py()) else False for x in text], bool)
            if model is not None:
                for i, j in slices(offsets, 1 << 20):
                    best, p = model.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    lang[i:j], score[i:j] = np.array(model.langs, object)[best], p
            lang[~letter], score[~letter] = "und", 0.0
            bad = ~letter | (score < (model.threshold if model is not None else 2))
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(bad)], names=[*names, "lang_pred", "score", "rejected"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(tidy(run), schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict_language(docs, fit_language(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the method rejects go; those are also null texts and texts without a letter.

    Repeated rows stay or go together; an empty table gives an empty one; columns of any other name pass through.
    """
    plain, restore = shielded(docs, "doc_id", "text", "lang")
    keep = tuple(c for c in plain.columns if c != "doc_id")
    return restore(predict_language(plain, fit_language(plain), keep=keep).where(~F.col("rejected")))
