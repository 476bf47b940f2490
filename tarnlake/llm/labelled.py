"""Labelled rows that a classifier may learn from: a bounded, deterministic sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, settle

#: Bytes of the texts of one class that a classifier learns from.
MOST_BYTES = 1 << 25


def held_out(doc_id):
    """True for the fifth of all ids that no classifier learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = MOST_BYTES) -> tuple[list[tuple[bytes, int]], float]:
    """At most ``most`` (text, label) rows of each class and ``most_bytes`` of text of each class,
    whose ids aren't held out, and the share of label 1 among all such labels. Rows are taken in the
    order of a hash of the id; one whose text no longer fits is passed over. Ids are picked from the
    narrow labels first; the join then broadcasts at most 2 * most ids. A document with several
    labels counts by its largest one, one with several texts by its least; null labels and ids
    don't count."""
    narrow = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    narrow = narrow.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in narrow.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = None
    for value in (0, 1):
        some = narrow.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.union(some)
    text = F.min(F.coalesce("text", F.lit(""))).alias("text")
    held = settle(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(text), "labelled")
    room, chosen = {0: most_bytes, 1: most_bytes}, []
    for r in sorted(held.select("doc_id", "label", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("place")).collect(), key=lambda r: (r.place, r.doc_id)):
        if r["size"] <= room[r.label]:
            room[r.label] -= r["size"]
            chosen.append(r.doc_id)
    rows = held.where(F.col("doc_id").isin(chosen)).collect() if chosen else []
    discard(held)
    rows.sort(key=lambda r: (r.doc_id, r.text))
    total = sum(counts.values())
    return [(r.text.encode(), r.label) for r in rows], (counts.get(1, 0) / total if total else 0.5)
