"""Near-duplicate documents by SetSketch registers over word shingles.

1. Each text gets its number of distinct k-word shingles, a digest of their set and ``REGISTERS``
   registers: each the truncated logarithm (base ``B``) of the least of an exponential variable
   over the set, one byte. The registers of a union are the larger ones, so sketches merge.
2. Texts with equal sets form a class, which its smallest doc_id stands for.
3. Bands of registers are hashed. In each bucket one class (by a hash that differs between bands)
   is the hub, and is paired with all others: rows grow with the bucket, not with its square.
4. Each pair's similarity is estimated jointly by likelihood from how many registers are larger,
   smaller and equal, with the known set sizes; only pairs for which a similarity at the
   threshold is ``DOUBT`` log units less likely than the best one are dropped. The rest is
   verified on the full sets of both texts.
5. Verified links give components. Where a bucket still holds several of them, all classes outside
   the most frequent one are compared with all classes of other components, in blocks of about
   ``BLOCK`` rows and ``CELL_BYTES`` of text dealt over tasks, so that no link is lost to the choice
   of hubs; what the likelihood leaves is verified there, and joins the components.

Words are runs without white space, A-Z lower-cased. Links have
100 * intersection >= percent * union.

Defined results: null, empty and blank texts have an empty set, 0 shingles, and are their own
component; a text of fewer than k words has one shingle, all of it; repeated rows and copies are
in one component and each row is returned; a repeated doc_id is one document, so that what one of
its texts links with is in one component with what another links with (a row without shingles
excepted); rows with a null doc_id link with nothing, their component_id is null and they are kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import LOWER, discard, quoted, settle, sliced, task_count, texts_of
from tarnlake.llm.components import components
from tarnlake.llm.vectors import chunks, shingles, words

REGISTERS = 256
B = 1.09
RATE = 20.0
DOUBT = 14.0
BLOCK = 256
CELL_BYTES = 1 << 25
#: Similarity likelihoods are compared on this grid.
GRID = np.linspace(0.0, 1.0, 101)


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(987654321)
    return rng.integers(0, 2**64, REGISTERS, np.uint64), rng.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def registers(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One row of registers for each non-empty segment of hashes (starts, without the end)."""
    out = np.empty((len(start), REGISTERS), np.uint64)
    flip, factor = multipliers()
    room = np.empty_like(h)
    for i in range(REGISTERS):
        np.bitwise_xor(h, flip[i], out=room)
        np.multiply(room, factor[i], out=room)
        out[:, i] = np.minimum.reduceat(room, start)
    least = -np.log1p(-(out.astype(np.float64) + 0.5) * 2.0**-64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(B)), 0, 255).astype(np.uint8)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = words([t.translate(LOWER) for t in texts])
    return [np.unique(shingles(w.hash[a:b], k)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def bands_of(percent: int) -> tuple[int, int]:
    """(bands, registers in each): the most selective that miss a link at the threshold with a
    probability under 1e-8, all registers used."""
    for rows in range(12, 0, -1):
        n = REGISTERS // rows
        if (1 - (percent / 100) ** rows) ** n < 1e-8:
            return n, rows
    raise ValueError("the threshold is too low for this many registers")


def sketch(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), registers (null if empty), bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch.column(1))
            sizes, digests, rows = [], [], []
            for a, b in chunks(texts, 1 << 19):
                sets = shingle_sets(texts[a:b], k)
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                found: list[bytes | None] = [None] * len(sets)
                if len(full):
                    start = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    for i, row in zip(full.tolist(), registers(np.concatenate([sets[i] for i in full]), start), strict=True):
                        found[i] = row.tobytes()
                sizes += size.tolist()
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                rows += found
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "n_shingles", "digest", "registers", "bytes"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary, bytes long")


def log_likelihood(larger: np.ndarray, smaller: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of each similarity of GRID (columns) for pairs (rows): how many registers of the first set
    are larger and smaller, and its share of both sets' sizes. Impossible similarities: -inf."""
    u, v, j = share[:, None], 1 - share[:, None], GRID[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    up, down = p(u - v * j), p(v - u * j)
    equal = REGISTERS - larger - smaller
    tiny = 1e-12
    out = larger[:, None] * np.log(up + tiny) + smaller[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return np.where(j <= np.minimum(u / v, v / u) + 0.01, out, -np.inf)


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (rows of registers) may reach the threshold."""
    ok = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    at = np.flatnonzero(ok)
    if len(at):
        larger, smaller = (a[at] > b[at]).sum(1), (a[at] < b[at]).sum(1)
        fit = log_likelihood(larger, smaller, size_a[at] / (size_a[at] + size_b[at]))
        ok[at] = fit[:, GRID >= percent / 100 - 0.005].max(1) >= fit.max(1) - DOUBT
    return ok


def unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids that may reach the threshold."""
    one = sketches.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    two = sketches.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ra, rb = (batch.column(i) for i in range(6))
            ok = may_link(unpack(ra), unpack(rb), na.to_numpy(), nb.to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    sized = pairs.join(two, "b").join(one, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def texts_by_id(documents: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """id and text of every document, each text of an id once; and the repeated ids, if any are."""
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    many = settle(rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if many.isEmpty():
        discard(many)
        return texts, None
    again = texts.join(many, "id", "left_semi").groupBy("id", F.md5("text").alias("mark")).agg(F.first("text").alias("text"))
    return texts.join(many, "id", "left_anti").unionAll(again.select("id", "text")), many


def same_document(rows: DataFrame, classes: DataFrame, many: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that one repeated doc_id has texts of."""
    own = rows.withColumn("id", F.col("doc_id")).join(many, "id", "left_semi").select("doc_id", "digest").distinct()
    held = own.join(classes, "digest").select("doc_id", "id")
    return held.join(held.groupBy("doc_id").agg(F.min("id").alias("low")), "doc_id").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold. texts: id and text."""
    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None)
        for batch in sliced(batches, 3):
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True):
                if last[:2] != (a, ta):
                    last = (a, ta, shingle_sets([ta], k)[0])
                x, y = last[2], shingle_sets([tb], k)[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def buckets(classes: DataFrame, percent: int, *more: str) -> DataFrame:
    """(bucket, number of the band, id, more columns) of every class and band."""
    n, rows = bands_of(percent)
    values = [F.xxhash64(F.lit(i), F.substring("registers", i * rows + 1, rows)) for i in range(n)]
    return classes.select("id", *more, F.posexplode(F.array(*values)).alias("band", "bucket"))


def residual(classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components, of components, that hubs have not shown, as a settled
    table. classes: id, component, n_shingles, registers, bytes; texts: id and text.

    A bucket that holds several components belongs to the group of its most frequent one. A
    group's members are compared in cells of two blocks: all members, and those outside of that
    component. In a cell the likelihood leaves the pairs that are verified on full sets."""
    placed = buckets(classes, percent, "component", "bytes").select("bucket", "id", "component", "bytes")
    mixed = (
        placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        .groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("kinds"))
        .where("kinds > 1 AND all > 2").select("bucket", "top")
    )
    mixed = settle(mixed, "mixed")
    members = placed.join(mixed, "bucket").select("top", "id", "bytes", (F.col("component") != F.col("top")).alias("outside"))
    members = settle(members.groupBy("top", "id").agg(F.max("bytes").alias("bytes"), F.max("outside").alias("outside")), "members")
    out = F.col("outside").cast("int")
    sizes = members.groupBy("top").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.sum(out).alias("few"), F.sum(out * F.col("bytes")).alias("outer_size"))
    wide, high = (F.ceil(F.greatest(F.col(n) / BLOCK, F.col(b) / CELL_BYTES)).cast("int") for n, b in (("n", "size"), ("few", "outer_size")))
    sizes = settle(sizes.select("top", wide.alias("wide"), high.alias("high"), (F.col("size") * high + F.col("outer_size") * wide).alias("shipped")), "groups")
    needed = members.select("id").distinct().join(texts, "id").join(classes, "id")
    needed = settle(needed.select("id", "component", "n_shingles", "registers", "text"), "needed")
    block = F.xxhash64("id", F.lit(1))
    own = members.join(sizes.drop("shipped"), "top")
    every = own.select("top", F.pmod(block, F.col("wide")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("j"), F.lit(False).alias("outer"), "id")
    outer = own.where("outside").select("top", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("i"), F.pmod(block, F.col("high")).cast("int").alias("j"), F.lit(True).alias("outer"), "id")

    def links_of(group: list[pa.Table]) -> tuple[list[int], list[int]]:
        table = pa.concat_tables(group)
        top = table.column("top")[0].as_py()
        out = table.column("outer").to_numpy()
        ids, comp, size = (table.column(c).to_numpy() for c in ("id", "component", "n_shingles"))
        regs, texts = unpack(table.column("registers")), texts_of(table.column("text"))
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets([texts[i]], k)[0]
            return sets[i]

        left, right = [], []
        rest = np.flatnonzero(~out)
        for m in np.flatnonzero(out).tolist():
            own = find(int(comp[m]))
            to = rest[(comp[rest] != comp[m]) & ((comp[rest] == top) | (ids[rest] > ids[m]))]
            if len(to):
                to = to[may_link(np.broadcast_to(regs[m], (len(to), REGISTERS)), regs[to], np.full(len(to), size[m]), size[to], percent)]
            for t in to.tolist():
                if find(int(comp[t])) == find(own):
                    continue
                x, y = set_of(m), set_of(t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    left.append(int(comp[m]))
                    right.append(int(comp[t]))
                    root[find(own)] = find(int(comp[t]))
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def done() -> pa.RecordBatch:
            a, b = links_of(group)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            cells = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            first = 0
            for i in range(1, len(cells) + 1):
                if i == len(cells) or cells[i] != cells[first]:
                    if cells[first] != key:
                        if group:
                            yield done()
                        key, group = cells[first], []
                    group.append(table.slice(first, i - first))
                    first = i
        if group:
            yield done()

    cells = ["top", "i", "j"]
    dealt = every.union(outer).join(needed, "id").select(*cells, "outer", "id", "component", "n_shingles", "registers", "text")
    parts = task_count(classes.sparkSession, int(sizes.agg(F.sum("shipped")).first()[0] or 0))
    found = settle(dealt.repartition(parts, *cells).sortWithinPartitions(*cells).mapInArrow(run, "a long, b long").distinct(), "more")
    for old in (mixed, members, sizes, needed):
        discard(old)
    return found


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    rows = settle(sketch(documents, k), "sketches")
    texts, many = texts_by_id(documents, rows)
    classes = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = settle(classes, "classes")
    own = rows.join(classes.select(F.col("id").alias("doc_id"), F.col("digest").alias("own")), "doc_id").where("digest = own")
    # an id with several texts has several sketches; each pair of ids is verified on all of them
    sketches = settle(own.select(F.col("doc_id").alias("id"), "n_shingles", "registers", "digest", "bytes").dropDuplicates(["id", "digest"]).drop("digest"), "registers")
    placed = buckets(sketches, percent).select("bucket", "id")
    hubs = settle(placed.groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", "bucket")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub"), "hubs")
    stars = placed.join(hubs, "bucket").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = settle(likely(stars, sketches, percent), "likely")
    links = verified(pairs, texts, k, percent)
    links = settle(links if many is None else links.unionByName(same_document(rows, classes, many)), "links")
    found = components(links)
    reached = sketches.join(found, "id", "left").select("id", "n_shingles", "registers", "bytes", F.coalesce("component", "id").alias("component"))
    reached = settle(reached, "reached")
    more = residual(reached, texts, k, percent)
    joined = components(more).select(F.col("id").alias("component"), F.col("component").alias("joined"))
    named = reached.select("id", "component").distinct().join(joined, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
    named = settle(classes.join(named, "id", "left").select("digest", F.coalesce("component", "id").alias("component")), "named")
    for old in (pairs, links, more, sketches, hubs, reached, classes):
        discard(old)
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def representatives(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of linked ones (the smallest doc_id, any one row of it),
    with all their columns. Rows with a null doc_id stay."""
    found = settle(near_duplicates(documents, k, percent).select("doc_id", "kept"), "kept")
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    gone = settle(ids.where("rows > 1 OR NOT kept"), "gone")
    once = documents.join(gone.select("doc_id"), "doc_id", "left_anti")
    again = documents.join(gone.where("kept").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).select(*quoted(documents.columns))
