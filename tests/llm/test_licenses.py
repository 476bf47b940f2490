"""op1: base phrases against brute force, and templates with words changed, added and left out."""

import re

from tarnlake.llm import licenses

from .helpers import SF, clashing, odd_rows, table


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(t):
    w, found = words(t), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_equals_brute_force(spark):
    texts = ["CC-BY 4.0 cc by\ncc  by", "GENERAL PUBLIC LICENSE, All rights\treserved. all rights reserved", "cc_by", "ccby", "cc É by", None, "", "by cc by cc", "all rights", "Kc by", "all rİghts reserved"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in licenses.scan(clashing(table(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_diagonals(spark):
    w = licenses.template_words(licenses.TEMPLATES["mit"][0])
    changed = w[:20] + ["oddly"] + w[20:35] + w[37:50] + ["other"] + w[51:]
    texts = ["some words before " + " ".join(w), " ".join(changed), " ".join(w[:12]), " ".join(w[::-1]), " ".join(w[:9] + ["filler"] * 200 + w[9:18]), "x. " + licenses.TEMPLATES["apache-2.0"][0].upper() + " " + " ".join(w)]
    got = [r for r in licenses.scan(table(spark, texts)).orderBy("doc_id").collect()]
    assert [r.labels for r in got] == ["mit", "mit", "", "", "", "apache-2.0,mit"]
    assert got[0].score == 1.0 and 0.5 <= got[1].score < 1 and got[2].score == 0
    templates = licenses.template_rows(spark, licenses.TEMPLATES)
    (span,) = licenses.spans(licenses.read_once(table(spark, texts[:1]), templates), templates).where("verified").collect()
    assert (span["first"], span["last"]) == (3, 3 + len(w))


def test_short_notices(spark):
    texts = ["A text. Released under the MIT License. More.", "Licensed under the MIT License", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "This work is licensed under the", "released under the moon", "licensed under the apache"]
    got = [r.labels for r in licenses.scan(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["mit", "mit", "apache-2.0", "gpl,gpl-notice", "cc-by,cc-by-nc-notice", "cc-by,cc-by-notice", "", "", ""]


def test_other_versions(spark):
    texts = ["This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "licensed under a Creative Commons Attribution-NonCommercial 2.5 Generic License", "Licensed under the Mozilla Public License, version 1.1", "Licensed under CC BY-SA 3.0", "Licensed under the Apache License, Version 1.1", "Released under the GNU General Public License, version 2", "This work is licensed under the Creative Commons Attribution-ShareAlike License", "under a Creative Commons Attribution License"]
    got = [r.labels for r in licenses.scan(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["cc-by-notice", "cc-by-nc-notice", "mpl", "cc-by,cc-by-sa-notice", "apache", "gpl,gpl-notice", "cc-by-sa-notice", "cc-by-notice"]


def test_many_templates_give_the_same(spark, monkeypatch):
    rows = table(spark, [f[0] for f in licenses.TEMPLATES.values()] + ["no license"])
    few = sorted(map(tuple, licenses.scan(rows).collect()))
    monkeypatch.setattr(licenses, "MOST_LISTED", 5)
    assert sorted(map(tuple, licenses.scan(rows).collect())) == few


def test_odd_rows(spark):
    rows = odd_rows(spark).union(table(spark, [*licenses.TEMPLATES["isc"]] * 2, 50)).union(table(spark, [*licenses.TEMPLATES["isc"]], 50))
    got = licenses.scan(rows).collect()
    assert len(got) == 11
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_words == 0 and by_id[1].labels == "" and by_id[1].first_word is None and by_id[5].n_words == 60000
    assert [r.labels for r in got if r.doc_id in (50, 51)] == ["isc"] * 3
    assert licenses.scan(table(spark, [])).count() == 0
