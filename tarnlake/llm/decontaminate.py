"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised to words (A-Z lower-cased, words are runs of letters, digits and any
non-ASCII character). A text is scanned once; hits are runs of words, and ``spans`` are their
places in the original, in code points.

The benchmark's words go to every worker, which makes the automaton. One that would hold more than
``MAX_PATTERN_WORDS`` words of windows (some 120 MB) is made in parts: the same pass over the texts
then holds ``HELD_BYTES`` of them at a time and lets each part scan those. Only a benchmark of more
than ``PASS_BYTES`` of words, which one task's closure shouldn't carry, takes several passes.

Defined results: null, empty and wordless texts have no words and no hits; null and repeated
item ids count as one item (null as the string "null"); repeated documents are scanned as often
as they occur; columns besides doc_id and text (item_id and text) are ignored; an empty benchmark
gives no hits, an empty document table no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import ALNUM, discard, quoted, settle, sliced, texts_of

#: Words of the windows that one automaton may hold: about 120 MB in a worker.
MAX_PATTERN_WORDS = 500_000
#: Bytes of texts that wait while the parts of a large automaton are made one after the other.
HELD_BYTES = 1 << 25
#: Bytes of the benchmark's words that one pass takes to the workers.
PASS_BYTES = 1 << 28
HITS = "array<struct<first:long,length:long>>"
SPANS = "array<struct<start:long,end:long>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def windows(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    """All runs of n words; a text of fewer words, but not none, is one window."""
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends in the original, in code points (end exclusive)."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.frombuffer(text.translate(ALNUM), dtype=np.uint8) != 32
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return at[np.flatnonzero(edges == 1)], at[np.flatnonzero(edges == -1)]


class Scanner:
    """The automaton of windows: {window: names of its items}.

    Patterns and texts are words with one space before, between and behind them, so that a hit
    can't start or end inside a word. UTF-8 bytes are the alphabet (as Latin-1 characters)."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for window, items in patterns.items():
            self.auto.add_word(self._spaced(window), (len(window), tuple(items)))
        if patterns:
            self.auto.make_automaton()
        self.patterns = len(patterns)

    @staticmethod
    def _spaced(w) -> str:
        return b" ".join((b"", *w, b"")).decode("latin-1")

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Words, which of them are hit (empty array: none), and the items found."""
        w = words(text)
        hit, found = np.zeros(0, bool), set()
        if not self.patterns or not w:
            return len(w), hit, found
        spaced = self._spaced(w)
        if hits := list(self.auto.iter(spaced)):
            spaces = np.flatnonzero(np.frombuffer(spaced.encode("latin-1"), np.uint8) == 32)
            last = np.searchsorted(spaces, [end for end, _ in hits])  # one behind the last word
            steps = np.zeros(len(w) + 1, np.int64)
            np.add.at(steps, last - [n for _, (n, _) in hits], 1)
            np.add.at(steps, last, -1)
            hit = np.cumsum(steps[:-1]) > 0
            found.update(i for _, (_, items) in hits for i in items)
        return len(w), hit, found

    def scan_all(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
        return [self.scan(text) for text in texts]


Items = list[tuple[str, bytes]]


def passes(benchmark: DataFrame) -> Iterator[Items]:
    """The items' names and words (one space between), as much as a pass takes; one pass at least."""
    items: Items = []
    held, more = 0, False
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    for row in rows.toLocalIterator():
        own = b" ".join(words((row.t or "").encode()))
        if items and held + len(own) > PASS_BYTES:
            yield items
            items, held, more = [], 0, True
        if own:
            items.append(("null" if row.i is None else row.i, own))
            held += len(own)
    if items or not more:
        yield items


def blocks(items: Items, n: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """The windows and the names of the items that hold them, as much as one automaton takes."""
    block: dict[tuple[bytes, ...], list[str]] = {}
    held = 0
    for name, text in items:
        for window in windows(text, n):
            size = 1 if window in block else len(window)
            if held and held + size > MAX_PATTERN_WORDS:
                yield block
                block, held = {}, 0
                size = len(window)
            names = block.setdefault(window, [])
            if name not in names[-1:]:
                names.append(name)
                held += size
    yield block


def scan(documents: DataFrame, benchmark: DataFrame, n: int = 10, carry: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, text, n_words, hits (runs of hit words), spans (their places in the
    text, in code points), items (names, sorted), and the columns named in carry as one struct of
    that name."""
    none = {"hits": F.array().cast(HITS), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")}
    kept = [F.struct(*quoted(carry)).alias("carry")] if carry else []
    state = documents.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), *[c.alias(k) for k, c in none.items()], *kept)
    before = None
    for items in passes(benchmark):
        if before is not None:
            state = settle(state, "decontaminate")
            discard(before)
        before = state
        state = state.mapInArrow(_pass(items, n), state.schema)
    return state


def _pass(items: Items, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = blocks(items, n)
        first, second = next(parts), next(parts, None)
        if second is None:
            scanner = Scanner(first)
            for batch in sliced(batches):
                yield _scanned(batch, scanner.scan_all(texts_of(batch.column(1))))
            return
        del first, second, parts
        for group in _held(batches):
            texts = [texts_of(batch.column(1)) for batch in group]
            results = [[] for _ in group]
            for block in blocks(items, n):
                scanner = Scanner(block)
                for i, own in enumerate(texts):
                    results[i] = _joined(results[i], scanner.scan_all(own))
            for batch, found in zip(group, results, strict=True):
                yield _scanned(batch, found)

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    group, held = [], 0
    for batch in sliced(batches):
        group.append(batch)
        held += batch.get_total_buffer_size() if batch.num_rows == 1 else batch.nbytes
        if held >= HELD_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def _joined(one: list, two: list) -> list:
    """The results of two automata for the same texts."""
    return [(n, a if not b.size else b if not a.size else a | b, x | y) for (n, a, x), (_, b, y) in zip(one, two, strict=True)] if one else two


def _scanned(batch: pa.RecordBatch, results: list) -> pa.RecordBatch:
    """The batch with the results of a pass added to those that it holds."""
    counts, hits, spans, items = [], [], [], []
    for (count, hit, found), text, runs, names in zip(results, batch.column(1), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
        if runs and not hit.size:
            hit = np.zeros(count, bool)
        for run in runs:
            hit[run["first"] : run["first"] + run["length"]] = True
        edges = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        counts.append(count)
        hits.append([{"first": a, "length": b - a} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        if len(first):
            start, end = word_spans(text.as_py().encode())
            spans.append([{"start": a, "end": b} for a, b in zip(start[first].tolist(), end[last - 1].tolist(), strict=True)])
        else:
            spans.append([])
        items.append(sorted(found | set(names)))
    types = [f.type for f in batch.schema]
    out = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, types[3]), pa.array(spans, types[4]), pa.array(items, types[5]), *batch.columns[6:]]
    return pa.RecordBatch.from_arrays(out, names=batch.schema.names)


def clean(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without a hit, with all their columns."""
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    found = scan(documents, benchmark, n, rest).where(F.size("hits") == 0)
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col("carry").getField(c).alias(c) for c in documents.columns])


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Digest of ``scan``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return scan(documents, benchmark, n).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
