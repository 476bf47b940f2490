"""op2: every id in one piece, no gaps, no padding, and exact ids."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import packing as pk
from tarnlake.llm.queries import encoder

from .helpers import SF, clashing, odd_rows, table

CRAFTED = ["a  b", " a ", "a\n\n b", "x   y", "   ", "", "\n \nb", "don't 's <|endoftext|> x", "a   b c\t d", "x" * 3000, "　 日本 �\x00", "naïve café 1,234.5 ½ ²"]


@pytest.fixture(scope="module")
def both():
    return pk.Encoder(*encoder()), pk.Encoder(encoder()[0])


def test_fast_ids_equal_the_tokenizer(spark, both):
    texts = CRAFTED + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fast, exact = both
    assert all(fast(t) == exact(t) for t in texts)


def test_ids_equal_the_untouched_tokenizer(spark, both):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(encoder()[0])
    special = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "  <|endoftext|>\n\n y", "x  <|endoftext|>", "<|endoftext|", "a<|endoftext|>  b <|endoftext|>c's"]
    assert 50256 in own.encode(special[0], add_special_tokens=False).ids
    for text in special + CRAFTED:
        ids = own.encode(text, add_special_tokens=False).ids
        assert all(np.frombuffer(e(text), e.kind).tolist() == ids for e in both), text


def check(rows, want, size):
    """rows: pieces; want: list of id arrays by doc_id (a repeated id occurs as often)."""
    total = collections.Counter()
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
        total.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)
    return total


@pytest.mark.parametrize("size", [2048, 64])
def test_pieces(spark, both, size):
    texts = CRAFTED + ["copy of a text"] * 300 + [None]
    rows = pk.digest(pk.pack(clashing(table(spark, texts)), encoder(), size)).collect()
    want = {i: np.frombuffer(both[1](t or "") + b"\1\0", "<u2") for i, t in enumerate(texts)}
    total = check(rows, want, size)
    assert set(total.values()) == {1} and len(total) == sum(len(x) for x in want.values())


def test_odd_rows(spark, both):
    rows = pk.digest(pk.pack(odd_rows(spark), encoder())).collect()
    want = {r.doc_id: np.frombuffer(both[1](r.text or "") + b"\1\0", "<u2") for r in odd_rows(spark).collect()}
    total = check(rows, want, 2048)
    assert {k: n for k, n in total.items() if n > 1} == {(4, i): 2 for i in range(len(want[4]))}
    assert pk.pack(table(spark, []), encoder()).count() == 0


@pytest.mark.parametrize("id_of", [lambda i: None, lambda i: 7, lambda i: i])
def test_sample_of_null_and_repeated_ids(spark, monkeypatch, id_of):
    tokenised = []
    choose = pk.sampled
    monkeypatch.setattr(pk, "SAMPLE", 100)
    monkeypatch.setattr(pk, "sampled", lambda source, share: tokenised.append(choose(source, share)) or tokenised[-1])
    rows = [(id_of(i), f"text {i}") for i in range(2000)]
    assert pk.pack(spark.createDataFrame(rows, "doc_id long, text string"), encoder()).count() >= 2000
    assert 50 <= tokenised[0].count() <= 150
    nulls = spark.createDataFrame([(None, None)] * 100, "doc_id long, text string")
    assert choose(nulls, 0.001).count() == 0


def test_copies_of_one_row_share_the_ranges(spark):
    rows = spark.range(0, 6000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text of a copied row").alias("text"))
    pieces = pk.digest(pk.pack(rows, encoder())).collect()
    ranges = collections.Counter(r.sequence_id >> 32 for r in pieces)
    assert sum(r.length for r in pieces) == 6000 * pieces[0].doc_tokens
    assert len(ranges) >= 4 and max(ranges.values()) < 0.4 * len(pieces)


def test_wide_vocabularies(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    own = Tokenizer(WordLevel({f"w{i}": i for i in range(70_000)} | {"?": 70_000}, unk_token="?"))
    own.pre_tokenizer = Whitespace()
    own.save(str(tmp_path / "wide.json"))
    rows = pk.pack(table(spark, ["w69999 w3", "w65536"]), (str(tmp_path / "wide.json"),)).collect()
    assert sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows if r.doc_id == 1 or r.start == 0)[0][2][0] == 69999
    assert sorted(i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()) == [1, 1, 3, 65536, 69999]


def test_hilbert_is_a_curve():
    bits = 3
    points = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    keys = pk.hilbert(points, bits)
    assert sorted(keys.tolist()) == list(range(512))
    assert set(np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1).tolist()) == {1}
