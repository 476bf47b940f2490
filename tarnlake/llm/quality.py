"""Quality classifier: attention-based multiple-instance learning over passages.

Every passage of ``PASSAGE`` words is encoded: a vector of its letters, case, symbols, word
lengths, repeated words and word runs already seen in the text goes through a tanh layer. Gated
attention (a tanh gate times a sigmoid gate) gives each passage its weight in the document, and a
logistic output scores the weighted passage representation. All weights are learned together
from the documents' labels, in numpy, by gradients written out below.

Learning uses at most ``MOST`` rows of each class (``labelled.sample``); the class shares of all
labels weight them. Every text is scored as a whole, whatever its length.

Defined results: a null, empty or blank text is one passage of zeros; repeated rows score alike;
other columns are ignored; without labels of both classes every text scores the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm import labelled
from tarnlake.llm.common import sliced, texts_of
from tarnlake.llm.toxicity import calibrate
from tarnlake.llm.vectors import chunks, mix, words

PASSAGE = 32
HIDDEN = 16
MOST = 1200
RUN = 5

#: Kinds of bytes that are counted: of each, one column of the passage's vector.
KINDS = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b".",
    b",",
    b";:'\"()-",
    b"!?",
    b"#$%&*+=<>@^~_",
    b"|/\\{}[]`",
    bytes(range(192, 256)),
    b"\n",
]
KIND = np.full(256, len(KINDS), np.uint8)
for _i, _kind in enumerate(KINDS):
    KIND[list(_kind)] = _i


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and where each text's rows start (and their number)."""
    w = words(texts)
    count = np.diff(w.first)
    number = np.maximum(1, -(-count // PASSAGE))
    doc = np.concatenate(([0], np.cumsum(number)))
    owner = np.repeat(np.arange(len(texts)), number)
    at = w.first[owner] + (np.arange(doc[-1]) - doc[owner]) * PASSAGE
    upto = np.minimum(at + PASSAGE, w.first[owner + 1])
    n = np.maximum(1, upto - at).astype(np.float64)
    some = upto > at
    begin = np.where(some, np.append(w.start, len(w.data))[at], 0)
    end = np.where(some, np.append(w.end, 0)[upto - 1], 0)
    size = np.maximum(1, end - begin).astype(np.float64)
    kind = KIND[w.data]
    columns = []
    for i in range(len(KINDS)):
        total = np.concatenate(([0], np.cumsum(kind == i)))
        columns.append((total[end] - total[begin]) / size)

    def mean(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values)))
        return (total[upto] - total[at]) / n

    length = (w.end - w.start).astype(np.float64)
    columns += [mean(np.minimum(length, 40)) / 10, mean(np.minimum(length, 40) ** 2) / 100, mean(length > 30)]
    upper = np.concatenate(([0], np.cumsum(kind == 1)))
    columns.append(mean(upper[w.end] - upper[w.start] > 1))
    last = kind[w.end - 1] if len(w.end) else kind[:0]
    columns += [mean(last == k) for k in (3, 6, 7, 8)]
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    columns.append(mean(same))
    # words already seen in the passage, and runs of RUN words already seen in the text
    place = np.repeat(np.arange(len(owner)), upto - at)
    columns.append(mean(repeated(mix(w.hash + place.astype(np.uint64)))))
    run = np.repeat(np.arange(len(texts)), count).astype(np.uint64)
    for j in range(RUN):
        run = mix(run + np.concatenate((w.hash[j:], np.zeros(min(j, len(w.hash)), np.uint64))))
    # a run that would reach into the next text isn't one
    whole = np.arange(len(run)) + RUN <= np.repeat(w.first[1:], count)
    columns.append(mean(repeated(run) & whole))
    columns += [np.log1p(count[owner]) / 5, np.log1p(n) / 4]
    return np.stack(columns, 1) * some[:, None], doc


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value stood before."""
    order = np.argsort(values, kind="stable")
    again = np.zeros(len(values), bool)
    again[order[1:]] = values[order[1:]] == values[order[:-1]]
    return again


def forward(m: dict, x: np.ndarray, doc: np.ndarray) -> dict:
    h = np.tanh(x @ m["w"] + m["b"])
    u, s = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["g"])))
    e = (u * s) @ m["a"]
    owner = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
    e = np.exp(e - np.maximum.reduceat(e, doc[:-1])[owner])
    a = e / np.add.reduceat(e, doc[:-1])[owner]
    z = np.add.reduceat(a[:, None] * h, doc[:-1])
    return {"h": h, "u": u, "s": s, "attention": a, "z": z, "owner": owner, "logit": z @ m["c"] + m["d"][0]}


def train(rows: list[tuple[bytes, int]], share: float, steps: int = 200, seed: int = 11) -> dict:
    y = np.array([label for _, label in rows], np.float64)
    share = min(max(share, 1e-4), 1 - 1e-4)
    width = passages([b""])[0].shape[1]
    if len(set(y.tolist())) < 2:
        zero = {"w": np.zeros((width, 1)), "b": np.zeros(1), "v": np.zeros((1, 1)), "g": np.zeros((1, 1)), "a": np.zeros(1), "c": np.zeros(1)}
        return zero | {"d": np.array([np.log(share / (1 - share))]), "mean": np.zeros(width), "scale": np.ones(width)}
    texts = [t for t, _ in rows]
    parts = [passages(texts[a:b]) for a, b in chunks(texts)]
    x = np.concatenate([p[0] for p in parts])
    shift = np.cumsum([0] + [len(p[0]) for p in parts])
    doc = np.concatenate([*(p[1][:-1] + s for p, s in zip(parts, shift, strict=False)), [len(x)]])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    m = {"w": rng.normal(0, width**-0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, HIDDEN)), "g": rng.normal(0, 0.3, (HIDDEN, HIDDEN)), "a": rng.normal(0, 0.3, HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.items()}
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for step in range(1, steps + 1):
        f = forward(m, x, doc)
        dl = weight * (1 / (1 + np.exp(-np.clip(f["logit"], -40, 40))) - y)
        dz = dl[:, None] * m["c"]
        own = dz[f["owner"]]
        da = (f["h"] * own).sum(1)
        de = f["attention"] * (da - np.add.reduceat(f["attention"] * da, doc[:-1])[f["owner"]])
        du = de[:, None] * m["a"] * f["s"] * (1 - f["u"] ** 2)
        ds = de[:, None] * m["a"] * f["u"] * f["s"] * (1 - f["s"])
        dh = (f["attention"][:, None] * own + du @ m["v"].T + ds @ m["g"].T) * (1 - f["h"] ** 2)
        grads = {"w": x.T @ dh, "b": dh.sum(0), "v": f["h"].T @ du, "g": f["h"].T @ ds, "a": (f["u"] * f["s"]).T @ de, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}
        for k, g in grads.items():
            g = g + 1e-4 * m[k] * (k not in "bd")
            one, two = moments[k]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            m[k] = m[k] - 0.03 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    by, to = calibrate(forward(m, x, doc)["logit"], y, share)
    return m | {"c": m["c"] * by, "d": m["d"] * by + to, "mean": mean, "scale": scale}


def predict(texts: list[bytes], m: dict) -> np.ndarray:
    out = [np.zeros(0)]
    for a, b in chunks(texts):
        x, doc = passages(texts[a:b])
        out.append(forward(m, np.clip((x - m["mean"]) / m["scale"], -6, 6), doc)["logit"])
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -40, 40)))


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST) -> dict:
    """The model, learned from at most ``most`` rows of each class: a few kilobytes."""
    return train(*labelled.sample(documents, labels, "quality", most))


def apply(documents: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """All columns of documents (text among them), and the score under a name that they don't have."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            score = pa.array(predict(texts_of(batch.column(at)), model), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    schema = plain.withColumn("score", F.lit(0.0)).schema
    return plain.mapInArrow(run, schema).toDF(*documents.columns, name)


def score(documents: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = apply(documents.select("doc_id", "text"), fit(documents, labels, most))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
