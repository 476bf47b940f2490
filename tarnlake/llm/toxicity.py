"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's subwords are the runs of 3 to 6 bytes of the lower-cased word with a space before
and behind it, hashed to ``BUCKETS`` embeddings of ``DIMS`` numbers. A passage of ``PASSAGE``
words is the average of its subwords' embeddings, a linear softmax gives its class, and a
document scores as its worst passage, so that a few words in a long text count. An unseen
misspelling shares most of its subwords with the words that were seen.

Learning starts from whole documents, then each document is represented by its worst passage.
It uses at most ``MOST`` rows of each class (``labelled.sample``); the class shares of all
labels correct the balanced sample. The weights that go out to the workers are one number for
each bucket, because average and softmax are linear.

Defined results: null, empty and wordless texts score as a passage without subwords (the bias);
repeated rows score alike; other columns are ignored; without labels of both classes every text
scores the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import labelled
from tarnlake.llm.common import sliced, texts_of
from tarnlake.llm.vectors import chunks

BUCKETS = 1 << 17
DIMS = 8
PASSAGE = 2
MOST = 1000
#: Steps of the embeddings, in units of their gradient's mean size: frequent subwords move more.
RATE = 0.01
#: ASCII punctuation parts words as white space does.
PART = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords in the texts' order; where each passage starts among them (and
    their number); where each text's passages start (and their number). Every text has one at least."""
    data = np.frombuffer(b" ".join((b"", *(b" ".join(t.translate(PART).split()) for t in texts), b"")), np.uint8)
    lengths = np.array([len(b" ".join(t.translate(PART).split())) for t in texts], np.int64)
    doc_start = np.concatenate(([0], np.cumsum(lengths + 1)))  # at the space before the text
    space = data == 32
    n = len(data)
    padded = np.concatenate((data, np.full(6, 32, np.uint8))).astype(np.uint32)
    solid = np.concatenate((~space, np.zeros(6, bool)))
    value, ok = padded[:n] + padded[1 : n + 1] * np.uint32(0x01000193), np.ones(n, bool)
    kept, places = [], []
    for size in (3, 4, 5, 6):
        value = value * np.uint32(0x9E3779B1) + padded[size - 1 : n + size - 1]
        ok = ok & solid[size - 2 : n + size - 2]
        at = np.flatnonzero(ok[: max(0, n - size + 1)])
        h = (value[at] ^ (value[at] >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * size)
        kept.append((h >> np.uint32(32 - 17)).astype(np.int32))
        places.append(at)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    bucket, place = np.concatenate(kept)[order], place[order]
    word = np.flatnonzero(space[:-1] & ~space[1:])  # the space before each word
    first_word = np.searchsorted(word, doc_start)
    passages = np.maximum(1, -(-np.diff(first_word) // PASSAGE))
    passage_doc = np.concatenate(([0], np.cumsum(passages)))
    owner = np.repeat(np.arange(len(texts)), passages)
    number = np.arange(passage_doc[-1]) - passage_doc[owner]
    index = first_word[owner] + number * PASSAGE
    begin = np.where(index < first_word[owner + 1], word[np.minimum(index, max(0, len(word) - 1))] if len(word) else 0, doc_start[owner])
    return bucket, np.concatenate((np.searchsorted(place, begin), [len(place)])), passage_doc


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of values between consecutive starts; 0 where there are none."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[start[1:]] - total[start[:-1]]


def passage_logits(weights: np.ndarray, bias: float, bucket: np.ndarray, start: np.ndarray) -> np.ndarray:
    return sums(weights[bucket], start) / np.maximum(1, np.diff(start)) + bias


def train(rows: list[tuple[bytes, int]], share: float, epochs: int = 90, seed: int = 5) -> tuple[np.ndarray, float]:
    """One weight for each bucket and a bias: a passage's logit is its subwords' mean weight + bias."""
    y = np.array([label for _, label in rows], np.float64)
    share = min(max(share, 1e-4), 1 - 1e-4)
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    texts = [t for t, _ in rows]
    parts = [(y[a:b], *subwords(texts[a:b])) for a, b in chunks(texts, 1 << 19)]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMS))
    soft = rng.normal(0, 0.3, (DIMS, 2))  # the softmax layer; only the difference of its columns acts
    bias = np.zeros(2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, soft, bias)]
    # what no text of the sample holds keeps no weight
    known = np.zeros(BUCKETS, bool)
    for _, bucket, _, _ in parts:
        known[bucket] = True
    emb[~known] = 0
    balance = 0.5 / max(1, (1 - y).sum()), 0.5 / max(1, y.sum())
    for step in range(1, epochs + 1):
        lean = soft[:, 1] - soft[:, 0]
        u, shift = emb @ lean, bias[1] - bias[0]
        coef, slope = np.zeros(BUCKETS), 0.0
        for want, bucket, start, doc in parts:
            if step <= epochs // 3:  # whole documents
                a, b = start[doc[:-1]], start[doc[1:]]
                z = sums(u[bucket], start[doc]) / np.maximum(1, b - a) + shift
            else:  # the worst passage of each
                logits = passage_logits(u, shift, bucket, start)
                best = np.array([p + int(np.argmax(logits[p:q])) for p, q in zip(doc[:-1], doc[1:], strict=True)])
                a, b, z = start[best], start[best + 1], logits[best]
            n = b - a
            error = np.where(want == 1, balance[1], balance[0]) * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - want)
            taken = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
            coef += np.bincount(bucket[taken], np.repeat(error / np.maximum(1, n), n), BUCKETS)
            slope += error.sum()
        pull = emb.T @ coef
        grads = [np.outer(coef, lean) + 1e-7 * emb, np.stack([-pull, pull], 1) + 1e-5 * soft, np.array([-slope, slope])]
        for x, g, m, rate in zip((emb, soft, bias), grads, moments, (RATE, 0.02, 0.05), strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * (g * g if x is not emb else (g * g).mean())
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    u = emb @ (soft[:, 1] - soft[:, 0])
    logits = np.concatenate([np.maximum.reduceat(passage_logits(u, bias[1] - bias[0], *p[1:3]), p[3][:-1]) for p in parts])
    scale, shift = calibrate(logits, y, share)
    return (u * scale).astype(np.float32), float((bias[1] - bias[0]) * scale + shift)


def calibrate(logits: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and shift of logits for rows that are weighted to the share of label 1."""
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -40, 40)))
        d, h = weight * (p - y), weight * p * (1 - p) + 1e-12
        grad = np.array([(d * logits).sum() + 1e-3 * (scale - 1), d.sum()])
        hess = np.array([[(h * logits**2).sum() + 1e-3, (h * logits).sum()], [(h * logits).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        move /= max(1.0, np.abs(move).max())
        scale, shift = max(0.05, scale - move[0]), shift - move[1]
    return scale, shift


def predict(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for a, b in chunks(texts):
        bucket, start, doc = subwords(texts[a:b])
        out.append(np.maximum.reduceat(passage_logits(weights, bias, bucket, start), doc[:-1]))
    logits = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def score(documents: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; ``most`` bounds the rows learned from."""
    weights, bias = train(*labelled.sample(documents, labels, "toxic", most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(predict(texts_of(batch.column(1)), weights, bias), pa.float64())], names=["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


__all__ = ["calibrate", "predict", "score", "subwords", "train"]
