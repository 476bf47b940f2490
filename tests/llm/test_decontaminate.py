"""op3 against brute force, and spans in the original."""

import hashlib
import re

import pytest

from tarnlake.llm import decontaminate as dc

from .helpers import SF, clashing, odd_rows, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - n + 1)) if w else []:
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for t in texts:
        w = words(t)
        hit, names = set(), set()
        for j in range(len(w)):
            for size in {len(k) for k in windows}:
                if tuple(w[j : j + size]) in windows and j + size <= len(w):
                    hit |= set(range(j, j + size))
                    names |= windows[tuple(w[j : j + size])]
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def rows(spark, texts, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.decontaminate(clashing(table(spark, texts)), bench, **more).orderBy("doc_id").collect()
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (10, "short item"), (2, None), (3, "..."), (10, "short item"), (7, "É a B a B a B a B a B a B"), (8, "two three four five six seven eight nine ten eleven")]
TEXTS = ["x one-two three,four five six SEVEN eight nine ten eleven twelve", "a short item, shorter item short  item", "É a b a b a b a b a b a b a b", "é a b a b a b a b a b a", None, "", "shortitem", "1 short 2 item", "item short"]


def test_equals_brute_force(spark):
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r.item_id + 100, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = TEXTS + real
    got = rows(spark, texts, ITEMS + items)
    assert got == brute(texts, ITEMS + items, 10)
    assert any(r[4] for r in got[len(TEXTS):])


@pytest.mark.parametrize(("words", "size"), [(25, 1 << 28), (500_000, 60), (25, 60)])
def test_parts_of_the_automaton_give_the_same(spark, monkeypatch, words, size):
    monkeypatch.setattr(dc, "MAX_PATTERN_WORDS", words)
    monkeypatch.setattr(dc, "PASS_BYTES", size)
    monkeypatch.setattr(dc, "HELD_BYTES", 200)
    assert rows(spark, TEXTS, ITEMS) == brute(TEXTS, ITEMS, 10)


def test_spans_lie_in_the_original(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in dc.scan(table(spark, TEXTS), bench).collect()}
    assert [TEXTS[0][a:b] for a, b in got[0]] == ["one-two three,four five six SEVEN eight nine ten eleven"]
    assert [TEXTS[1][a:b] for a, b in got[1]] == ["short item", "short  item"] and TEXTS[2][slice(*got[2][0])].startswith("É a b")
    assert got[4] == got[5] == []


def test_odd_rows(spark):
    bench = spark.createDataFrame(ITEMS + [(None, "one two")], "item_id long, text string")
    got = {r.doc_id: r for r in dc.decontaminate(odd_rows(spark), bench).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[4].n_items == 1 and got[4].n_hit == 2
    assert got[5].n_words == 60000 and not got[5].contaminated
    assert dc.decontaminate(table(spark, []), bench).count() == 0
    none = dc.decontaminate(odd_rows(spark), bench.limit(0)).collect()
    assert len(none) == 8 and not any(r.contaminated for r in none)


def test_clean_keeps_columns_and_clean_rows(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.clean(clashing(table(spark, TEXTS)), bench)
    assert got.columns == clashing(table(spark, [])).columns
    assert sorted(r.doc_id for r in got.collect()) == [4, 5, 6, 7, 8]


@pytest.mark.parametrize("text", ["Ab, é-日本 x", "", "  a", "b  "])
def test_word_spans(text):
    start, end = dc.word_spans(text.encode())
    assert [text[a:b] for a, b in zip(start, end, strict=True)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
