"""Each stage against brute force on its own input."""

import corpus_pipeline as cp
from tarnlake.llm import quality
from tarnlake.llm.common import settle

from .helpers import clashing, odd_rows, table
from .test_decontaminate import brute as hits
from .test_near_duplicates import brute as groups
from .test_spans import CHECKS, brute as spans

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "PII", "packing"]

    good = settle(steps["quality classifier"](spark, docs, SF), "t")
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) / sum(q == 1 for q in labels.values()) > 0.97
    assert sum(i in kept for i, q in labels.items() if q == 0) / sum(q == 0 for q in labels.values()) < 0.1
    scored = {r.doc_id: r.predicted for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert kept == {i for i, p in scored.items() if p}

    once = settle(steps["near-duplicates"](spark, good, SF), "t")
    want = groups([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i, (_, c) in want.items() if i == c)

    clean = settle(steps["decontamination"](spark, once, SF), "t")
    rows = sorted(once.collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = hits([r.text for r in rows], items, 10)
    assert sorted(clean.collect()) == [r for r, h in zip(rows, found, strict=True) if not h[4]]
    assert len(rows) > clean.count()

    masked = settle(steps["PII"](spark, clean, SF), "t")
    assert masked.columns == docs.columns and masked.schema == clean.schema
    old = {r.doc_id: r for r in clean.collect()}
    changed = 0
    for r in masked.collect():
        counts, _ = spans(old[r.doc_id].text, ["email", "ip", "card", "phone"])
        assert spans(r.text, ["email", "ip", "card", "phone"])[0] == [0, 0, 0, 0] or sum(counts) == 0
        assert (r.text == old[r.doc_id].text) or sum(counts) > 0
        assert (r.lang, r.source, r.n_chars) == (old[r.doc_id].lang, old[r.doc_id].source, len(r.text))
        changed += sum(counts) > 0
    assert changed > 5 and masked.count() == clean.count() and set(CHECKS)

    packed = steps["packing"](spark, masked, SF).collect()
    assert {r.doc_id for r in packed} == set(old) and len(before) > len(old)


def test_odd_rows(spark):
    """Every stage takes nulls, repeated rows, no rows and extra columns, and returns the columns of its input."""
    docs = clashing(odd_rows(spark).union(table(spark, ["one two three four five six +1 (617) 555-1234", "another text of a few words"], 20)))
    ids = sorted(str(r.doc_id) for r in docs.collect())
    for rows in (docs, docs.limit(0)):
        full = not rows.isEmpty()
        for name, stage in cp.STAGES[:-1]:
            out = settle(stage(spark, rows, SF), "t")
            assert out.columns == docs.columns, name
            got = sorted(str(r.doc_id) for r in out.collect())
            assert set(got) <= set(ids) and (bool(got) == full or name == "quality classifier"), name
            if full and name == "near-duplicates":
                assert got.count("4") == 1 and "None" in got and {"1", "2", "3", "5", "6"} <= set(got)
            if full and name == "PII":
                assert got == ids and any(r.text == "one two three four five six [PHONE]" for r in out.collect()) and any(r.text is None for r in out.collect())
        assert bool(cp.STAGES[-1][1](spark, rows, SF).count()) == full
