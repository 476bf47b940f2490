"""op6 and op8: held-out accuracy, and defined results for every text."""

import random
import zlib

import numpy as np
import pytest

from tarnlake.llm import labelled, quality, toxicity

from .helpers import clashing, odd_rows, table

SF1 = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("module", "label", "least", "clean"), [(quality, "quality", 0.97, 1), (toxicity, "toxic", 0.95, 0)])
def test_held_out(spark, module, label, least, clean):
    documents, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score(clashing(documents), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 500
    assert sum(r.predicted == r[label] for r in held) / len(held) >= least
    assert sum(r.predicted == clean for r in held if r[label] == clean) / sum(r[label] == clean for r in held) >= 0.98


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    texts = [f"good plain words number {i}" if i % 2 else f"BAD!! ### {i} $$$ scum" for i in range(60)]
    rows = module.score(odd_rows(spark).unionByName(table(spark, texts, 100)), labels).collect()
    assert len(rows) == 68 and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(blank) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert len({r.score for r in rows if r.doc_id in (4, None)}) == 1
    empty = module.score(odd_rows(spark), labels.limit(0)).collect()
    assert len({r.score for r in empty}) == 1
    assert module.score(table(spark, []), labels).count() == 0


def test_sample_is_bounded_and_never_held_out(spark):
    documents, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    rows, share = labelled.sample(documents, labels, "quality", 50)
    assert len(rows) == 100 and sum(y for _, y in rows) == 50 and 0.5 < share < 1
    assert rows == labelled.sample(documents, labels, "quality", 50)[0]


def test_sample_is_bounded_in_bytes_and_one_text_an_id(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 0)], "doc_id long, quality int")
    rows = spark.createDataFrame([(i, "x" * (100 if i % 10 else 100_000)) for i in range(200)] + [(7, "least")] * 50 + [(9, None)], "doc_id long, text string")
    got, share = labelled.sample(rows, labels, "quality", 1000, most_bytes=5000)
    assert sum(len(t) for t, y in got if y == 0) <= 5000 >= sum(len(t) for t, y in got if y == 1)
    assert {len(t) for t, _ in got} == {0, 5, 100} and (b"least", 1) in got and 0.4 < share < 0.6
    assert sum(t == b"least" for t, _ in got) == 1 and len(got) > 80


def scalar_toxicity(text, weights, bias):
    """The score of one text, subword by subword."""
    words = text.translate(toxicity.PART).split()
    passages = [words[i : i + toxicity.PASSAGE] for i in range(0, max(1, len(words)), toxicity.PASSAGE)]
    logits = []
    for passage in passages:
        found = []
        for word in passage:
            spaced = b" " + word + b" "
            for size in (3, 4, 5, 6):
                for i in range(len(spaced) - size + 1):
                    part, value = spaced[i : i + size], 0
                    value = (part[0] + part[1] * 0x01000193) % 2**32
                    for c in part[2:]:
                        value = (value * 0x9E3779B1 + c) % 2**32
                    found.append(((value ^ value >> 15) * (0x85EBCA6B + 2 * size) % 2**32) >> 15)
        logits.append(sum(float(weights[b]) for b in found) / max(1, len(found)) + bias)
    return 1 / (1 + np.exp(-max(logits)))


def test_toxicity_equals_a_scalar_score(spark):
    rng = np.random.default_rng(3)
    weights, bias = rng.normal(size=toxicity.BUCKETS).astype(np.float32) * 9, -1.5
    texts = [b"", b" ", b"a", b"ab", b"one Two-THREE, four five six", "é 日本 word".encode(), b"x" * 50]
    texts += [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    got = toxicity.predict(texts, weights, bias)
    assert np.allclose(got, [scalar_toxicity(t, weights, bias) for t in texts], atol=1e-6)


def scalar_quality(text, m):
    """The score of one text, passage by passage."""
    words = [w for w in bytes(32 if c in b" \t\n\v\f\r" else c for c in text).split(b" ") if w]
    spots, at = [], 0
    for w in words:
        at = text.index(w, at)
        spots.append((at, at + len(w)))
        at += len(w)
    seen_runs, rows = set(), []
    run_again = []
    for i in range(len(words)):
        run = tuple(words[i : i + quality.RUN]) if i + quality.RUN <= len(words) else None
        run_again.append(run is not None and run in seen_runs)
        seen_runs.add(run)
    kinds = [set(k) for k in quality.KINDS]
    for first in range(0, len(words), quality.PASSAGE):
        own, n = words[first : first + quality.PASSAGE], min(quality.PASSAGE, len(words) - first)
        data = text[spots[first][0] : spots[first + n - 1][1]]
        row = [sum(c in k for c in data) / len(data) for k in kinds]
        sizes = [min(40, len(w)) for w in own]
        row += [sum(sizes) / n / 10, sum(s * s for s in sizes) / n / 100, sum(len(w) > 30 for w in own) / n]
        row.append(sum(sum(c in kinds[1] for c in w) > 1 for w in own) / n)
        row += [sum(w[-1] in kinds[k] for w in own) / n for k in (3, 6, 7, 8)]
        row.append(sum(first + i > 0 and words[first + i - 1] == w for i, w in enumerate(own)) / n)
        row.append(sum(w in own[:i] for i, w in enumerate(own)) / n)
        row.append(sum(run_again[first : first + n]) / n)
        row += [np.log1p(len(words)) / 5, np.log1p(n) / 4]
        rows.append(row)
    x = np.clip((np.array(rows or [[0.0] * len(m["mean"])]) - m["mean"]) / m["scale"], -6, 6)
    h = [np.tanh(r @ m["w"] + m["b"]) for r in x]
    e = [float((np.tanh(v @ m["v"]) / (1 + np.exp(-(v @ m["g"])))) @ m["a"]) for v in h]
    weight = np.exp(np.array(e) - max(e))
    z = sum(a * v for a, v in zip(weight / weight.sum(), h, strict=True))
    return 1 / (1 + np.exp(-(z @ m["c"] + m["d"][0])))


def test_quality_equals_a_scalar_score(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    model = quality.train([(t, i % 2) for i, t in enumerate(texts)], 0.5, steps=20)
    texts += [b"", b"  ", b"one", b"a b a b a b a b a b a b", "É. é! 日本 ## | x".encode()]
    alone = np.array([quality.predict([t], model)[0] for t in texts])
    assert np.allclose(alone, [scalar_quality(t, model) for t in texts], atol=1e-7)
    assert np.allclose(alone, quality.predict(texts, model), atol=1e-7)


def test_unseen_misspellings_share_subwords():
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(40)]
        if i % 2:
            w[rng.randrange(40)] = rng.choice(["horrible", "horribly", "horriblest"])
        rows.append((" ".join(w).encode(), i % 2))
    weights, bias = toxicity.train(rows, 0.5)
    seen, unseen, clean = toxicity.predict([b"so horrible a thing", b"so horriblle a horribel thing", b"so nearer a thing"], weights, bias)
    assert seen > 0.9 and unseen > 0.5 > clean


def test_gradients():
    rng = np.random.default_rng(0)
    rows = [(b"abc def. " * rng.integers(1, 30), 1) for _ in range(40)] + [(b"ABC!! ### " * rng.integers(1, 30), 0) for _ in range(40)]
    model = quality.train(rows, 0.5, steps=80)
    scores = quality.predict([b"abc def. " * 7, b"ABC!! ### " * 9], model)
    assert scores[0] > 0.9 and scores[1] < 0.1
