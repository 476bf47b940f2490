"""Packing: documents along a Hilbert curve, cut into sequences without padding.

A document's token ids are counted in ``BUCKETS`` hashed counters; the log-scaled, normalised
vector is projected to three dimensions by a fixed Gaussian matrix, and their 16-bit coordinates
give its Hilbert key. Rows are dealt into ranges of (key, doc_id), sorted within each range, and
packed in that order, so that neighbours on the curve share sequences.

A range is packed by itself, which makes one pass over the texts and one shuffle of their ids
(two bytes each, four where the vocabulary needs them). Full sequences have ``size`` tokens; the last tokens of a range fill sequences
of falling powers of two, so that nothing is padded. ``sequence_id`` is range * 2**32 + number.

The range bounds come from about ``SAMPLE`` documents, chosen by a hash of id and text. They
decide only how evenly rows are dealt: ties of copies are parted by doc_id, those of one doc_id (or
of none) by a hash of partition and occurrence, and every document is packed whatever the bounds
are. The number of ranges grows with the sample's tokens, so that a range stays small.

Ids are those of ``tokenizers`` with add_special_tokens=False: nothing is added, but an added
token's string that stands in a text (<|endoftext|>) is that token, as in the tokenizer itself.

Defined results: a null or empty text is the end token alone; rows with a null doc_id are packed
first in their key's order; repeated rows are packed as often as they occur; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import sliced, task_count

SIZE = 2048
END = 1
BUCKETS = 4096
BITS = 16
SAMPLE = 20_000
LEAST = -(2**63)


class Encoder:
    """Ids of a text as little-endian bytes of ``kind``.

    tokenizer: path of the tokenizer's file, whose ids are the result. ranks and pattern: the
    same vocabulary as merge ranks, and its splitting pattern; with them a faster library gives
    the same ids (tests hold them against each other). Added tokens are taken from the tokenizer's
    file; where one strips or normalises what is next to it, or is only a whole word, the faster
    library isn't used."""

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        with open(tokenizer, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if ranks is None or not plain:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(tokenizer)
            size = own.get_vocab_size()
            self.ids = lambda text: own.encode(text, add_special_tokens=False).ids
        else:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            special = {t["content"]: t["id"] for t in added if t["content"].encode() not in merges}
            size = 1 + max([*merges.values(), *special.values()])
            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens=special)
            self.ids = lambda text: own.encode_ordinary(text) if not any(t in text for t in special) else own.encode(text, allowed_special="all")
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def __call__(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype=self.kind).tobytes()


def projection(dims: int = 3) -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((BUCKETS, dims))


def coordinates(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Of a document's hashed vector on the grid of 2**BITS steps a side."""
    slots = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
    vector = np.log1p(np.bincount(slots, minlength=BUCKETS))
    at = vector @ matrix / max(np.linalg.norm(vector), 1e-12)
    return np.clip((at / 8 + 0.5) * 2**BITS, 0, 2**BITS - 1).astype(np.int64)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of points (rows of x) on a grid: Skilling's transform."""
    x = x.copy().T
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _encoded(encoder: tuple, bounds: list[tuple[int, int, int]] | None):
    """Arrow batches of (doc_id, text) to (doc_id, key, mark, bucket, ids); without bounds no ids.

    mark is a hash of the task's partition and of how often it has seen the row's key and doc_id: it
    deals copies over ranges, and a task that is run again deals the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, matrix, task = Encoder(*encoder), projection(), TaskContext.get().partitionId()
        seen: dict[tuple, int] = {}
        for batch in sliced(batches):
            docs = batch.column(0).cast(pa.int64())
            all_ids = [encode(t or "") + END.to_bytes(encode.kind.itemsize, "little") for t in batch.column(1).to_pylist()]
            grid = np.array([coordinates(np.frombuffer(x, encode.kind), matrix) for x in all_ids]).reshape(-1, 3)
            keys = hilbert(grid)
            place = [(k, LEAST if d is None else d) for k, d in zip(keys.tolist(), docs.to_pylist(), strict=True)]
            marks = []
            for p in place:
                seen[p] = seen.get(p, 0) + 1
                marks.append(zlib.crc32(b"%d %d" % (task, seen[p])))
            if bounds is None:
                sizes = [len(x) // encode.kind.itemsize for x in all_ids]
                yield pa.RecordBatch.from_arrays([docs, pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "key", "mark", "n"])
                continue
            where = [bisect.bisect_left(bounds, (*p, m)) for p, m in zip(place, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(where, pa.int32()), pa.array(all_ids, pa.binary())], names=["doc_id", "key", "mark", "bucket", "ids"])

    return run


class Packer:
    """Pieces of one range in order: (doc_id, start, length, ids, doc_tokens, sequence, offset)."""

    def __init__(self, bucket: int, size: int):
        self.sequence, self.size, self.open, self.filled = bucket << 32, size, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        done, start = [], 0
        while start < len(ids):
            n = min(len(ids) - start, self.size - self.filled)
            self.open.append((doc_id, start, n, ids[start : start + n], len(ids), self.sequence, self.filled))
            start, self.filled = start + n, self.filled + n
            if self.filled == self.size:
                done += self.open
                self.open, self.filled, self.sequence = [], 0, self.sequence + 1
        return done

    def end(self) -> list[tuple]:
        """The open sequence, cut into falling powers of two."""
        pieces, self.open, left, self.filled = self.open, [], self.filled, 0
        done: list[tuple] = []
        room, offset = 0, 0
        for doc_id, start, n, ids, total, _, _ in pieces:
            taken = 0
            while taken < n:
                if not room:
                    room, offset = 1 << (left.bit_length() - 1), 0
                    self.sequence += bool(done)
                m = min(room, n - taken)
                done.append((doc_id, start + taken, m, ids[taken : taken + m], total, self.sequence, offset))
                taken, room, offset, left = taken + m, room - m, offset + m, left - m
        self.sequence += bool(done)
        return done


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _packed(size: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pieces), 2000):
                columns = list(zip(*pieces[i : i + 2000], strict=True))
                columns[3] = [x.astype("<u4").tobytes() for x in columns[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

        packer, bucket = None, None
        for batch in batches:
            pieces: list[tuple] = []
            for doc_id, where, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if where != bucket:
                    if packer is not None:
                        pieces += packer.end()
                    packer, bucket = Packer(where, size), where
                pieces += packer.add(doc_id, np.frombuffer(ids, kind))
            yield from out(pieces)
        if packer is not None:
            yield from out(packer.end())

    return run


def sampled(source: DataFrame, share: float) -> DataFrame:
    """About that share of the rows (doc_id, text). Spark's hash skips nulls, so that they are
    flagged: rows of nulls alone would all have its seed, and be chosen at any size."""
    mark = F.xxhash64("doc_id", F.isnull("doc_id"), "text", F.isnull("text"))
    return source.where(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30)))


def pack(documents: DataFrame, encoder: tuple, size: int = SIZE) -> DataFrame:
    """Pieces of all documents, encoded by Encoder(*encoder): doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset."""
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = Encoder(*encoder).kind
    rows = source.count()
    share = min(1.0, SAMPLE / max(rows, 1))
    # copies of one row are all chosen or none: they are counted before they reach the driver
    sample = sampled(source, share).mapInArrow(_encoded(encoder, None), "doc_id long, key long, mark long, n long")
    sample = sample.groupBy("key", "doc_id").agg(F.sum(F.col("n") + 200).alias("n"), F.count("*").alias("copies")).collect()
    total = sum(r.n for r in sample)
    ranges = task_count(spark, int(total / share) * kind.itemsize)
    bounds: set[tuple[int, int, int]] = set()
    held, cuts = 0, 1
    for r in sorted(sample, key=lambda r: (r.key, LEAST if r.doc_id is None else r.doc_id)):
        held += r.n
        while cuts < ranges and total * cuts / ranges <= held:
            # a cut within a row's copies lies at their share of all marks
            part = 1 - (held - total * cuts / ranges) / r.n if r.copies > 1 else 1
            bounds.add((r.key, LEAST if r.doc_id is None else r.doc_id, int(part * 2**32)))
            cuts += 1
    edges = sorted(bounds)
    encoded = source.mapInArrow(_encoded(encoder, edges), "doc_id long, key long, mark long, bucket int, ids binary")
    dealt = encoded.repartitionById(len(edges) + 1, "bucket").sortWithinPartitions("bucket", "key", "doc_id", "mark")
    return dealt.mapInArrow(_packed(size, kind), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
