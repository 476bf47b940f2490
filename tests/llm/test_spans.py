"""op4 and op7 against Python's regular expressions, used as the contract states them."""

import collections
import hashlib
import math
import random
import re
import time

import pytest

from tarnlake.llm import pii, secrets

from .helpers import SCHEMA, SF, clashing, odd_rows, table

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def number(m):
    return re.sub("[^0-9]", "", m.group(0))


CHECKS = {
    "email": (EMAIL, lambda m: True),
    "ip": (IP, lambda m: all(int(x) <= 255 for x in m.group(0).split("."))),
    "card": (CARD, lambda m: 12 <= len(number(m)) <= 19 and luhn(number(m))),
    "phone": (PHONE, lambda m: 9 <= len(number(m)) <= 15),
    "assign": (ASSIGN, lambda m: len(m.group(1)) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group(0)) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group(0)) >= 32),
}


def brute(text, kinds):
    spans = [(m.start(), i, k, m.end()) for i, k in enumerate(kinds) for m in re.finditer(CHECKS[k][0], text or "") if CHECKS[k][1](m)]
    counts = [sum(s[2] == k for s in spans) for k in kinds]
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return counts, listed


CRAFTED = [
    "a@b.c_d@e.f x@y.zz, a.b+c%d@mail-1.example.com.", "@@a@b..c a@b.c..d@e.f é@x.yy 😀 q@r.st", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 1.2.3 256.1.1.1 12.34.56.78.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4111111111111112 1 2 3 4", "+1 (555) 123-4567 +49.30.123456- ++1 2 +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "é" * 50 + "+1 (743) 555-3824 日本 4785380592391139", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" PassWord:'abc' api_key==abcdefgh apikey=secret: abcdefghij token=secret: abcdefghij",
    "AKIAABCDEFGHIJKL AKIA12 AKIAAKIA1234567890 xAKIAABCDEFGHIJK", "deadbeef" * 4 + " " + "deadbeef" * 3 + "dead" + "g" + "0" * 40, "passwd= 'x.y/z+1=_-' secret : \"12345678\" toKen=abcdefghijk",
]


@pytest.mark.parametrize(("module", "kinds"), [(pii, pii.BASE), (secrets, secrets.BASE)])
def test_base_spans_equal_brute_force(spark, module, kinds):
    documents = table(spark, CRAFTED, 10**9).union(spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]))
    got = {r.doc_id: r for r in module.digest(module.find(clashing(documents))).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        counts, listed = brute(row.text, kinds)
        mine = got[row.doc_id]
        assert [mine[f"n_{k}"] for k in kinds] == counts, row.text[:300]
        assert mine.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (listed, mine.spans)
        assert set(filter(None, listed.split(","))) <= set(mine.spans.split(","))


@pytest.mark.parametrize("module", [pii, secrets])
def test_odd_rows(spark, module):
    got = module.digest(module.find(odd_rows(spark))).collect()
    assert len(got) == 8
    assert all(r.spans == "" for r in got if r.doc_id in (1, 2, 3, 4))
    assert module.digest(module.find(table(spark, []))).count() == 0


def test_weak_supervision_adds_names(spark):
    texts = [f"Please call Mr. John Smith{chr(97 + i)} at home" for i in range(20)] + ["account: DE89 3704 0044 0532 0130 00 thanks"] * 5 + ["plain words only"] * 10
    spans = [r.spans for r in pii.digest(pii.find(table(spark, texts))).orderBy("doc_id").collect()]
    assert all(s.startswith("name:12:") for s in spans[:20])
    assert all("account:9:" in s for s in spans[20:25])
    assert spans[25:] == [""] * 10


def scalar_candidates(text):
    """Every candidate of a text with its votes, match by match: (kind, start, end, base, size, votes)."""
    import regex

    out = []
    for kind, pattern in pii.PATTERNS.items():
        found = list(regex.finditer(pattern, text, regex.ASCII)) if pii.NEEDS.get(kind, "") in text else []
        for i, m in enumerate(found):
            t, digits = m.group(0), re.sub("[^0-9]", "", m.group(0))
            gap = text[found[i - 1].end() if i else 0 : m.start()]
            before = ((found[i - 1].group(0) if i else "") + gap if len(gap) < 32 else gap)[-32:]
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)][:8]
            has = lambda p, x: regex.search(p, x, regex.ASCII) is not None
            base = kind in pii.BASE and CHECKS[kind][1](re.match("(?s).*", t))
            good = 9 <= len(digits) <= 13 if kind == "national" else base if kind in pii.BASE else True
            sure = kind in (*pii.BASE, "account", "identity", "address", "national")
            named = {"name": has(pii.TITLE, t), "person": True, "address": True, "account": has(pii.COUNTRY, t), "email": has(pii.HOST, t)}.get(kind, False)
            shaped = {"card": 13 <= len(digits) <= 16, "phone": 10 <= len(digits) <= 13, "account": len(t) >= 15, "name": has(r"\x20\p{Lu}\p{L}+\x20\p{Lu}", t), "national": 9 <= len(digits) <= 12, "handle": False}.get(kind, True)
            own = digits if kind in ("card", "phone", "national") else ""
            dull = has(r"^(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", t) or has(r"^([0-9])\1{6,}$", own)
            vote = lambda yes, no: -1 if no else int(yes)
            votes = (vote(good and sure, not good), vote(named or has(pii.GIVEN, t), has(pii.UNIT, after)), vote(has(pii.ANNOUNCE, before), has(pii.AGAINST, before)), vote(shaped, dull))
            out.append((kind, m.start(), m.end(), base, min(4, len(t) // 8), votes))
    return out


def test_spans_of_the_method_equal_brute_force(spark):
    texts = CRAFTED + ["Please call Mr. John Smith at (617) 555-1234, Anna Schmidt or @some_one", "phone 12345678 version 4.5.6.7, page 12", "12 High Oak Street; account: DE89 3704 0044 0532 0130 00", "ssn 123-45-6789 isbn 978-3-16-148410-0 2024-01-15 1111111111111 5 km", None]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    every = [scalar_candidates(t or "") for t in texts]
    counts = collections.Counter((kind, size, votes) for found in every for kind, _, _, _, size, votes in found)
    patterns = collections.Counter()
    for (_, _, votes), n in counts.items():
        patterns[votes] += n
    post, _, _ = pii.em(sorted((v, float(n)) for v, n in patterns.items()))
    weights = pii.train(sorted((*k, float(n)) for k, n in counts.items()), post)

    def chosen(kind, size, votes):
        return 1 / (1 + math.exp(-sum(weights[f] for f in pii.features(kind, size, votes))))

    got = {r.doc_id: r.spans for r in pii.digest(pii.find(table(spark, texts))).collect()}
    added = 0
    for i, found in enumerate(every):
        base = [(a, b) for _, a, b, own, _, _ in found if own]
        kept = [(a, pii.KINDS.index(kind), kind, b) for kind, a, b, own, size, votes in found if own or (chosen(kind, size, votes) >= pii.LEAST and not any(x < b and a < y for x, y in base))]
        assert got[i] == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(kept))
        added += len(kept) - len(base)
    assert added >= 5


def test_em_finds_the_reliable_labeler():
    # the first labeler is right, the second votes at random
    counts = [((1, 1, 1, 0), 40), ((1, -1, 1, 0), 40), ((-1, 1, -1, 0), 40), ((-1, -1, -1, 0), 40)]
    post, share, tables = pii.em(counts)
    assert post[(1, -1, 1, 0)] > 0.9 > 0.1 > post[(-1, 1, -1, 0)]
    assert 0.4 < share < 0.6 and tables[0][1][0] > 0.9 and abs(tables[1][1][0] - 0.5) < 0.1


def test_mask(spark):
    documents = table(spark, ["é a@b.cc and +1 (743) 555-3824.", None, "none"])
    from pyspark.sql import functions as F

    found = pii.find(documents).join(documents.select("doc_id", "text"), "doc_id")
    masked = found.select("doc_id", pii.mask(F.col("text"), F.concat("base", "more")).alias("m")).orderBy("doc_id").collect()
    assert [r.m for r in masked] == ["é [EMAIL] and [PHONE].", None, "none"]


def test_mask_of_overlapping_spans(spark):
    texts = ["x bob@mail.com-4111 1111 1111 1111 y", "4111111111111111@mail.com z"]
    assert [r.text for r in pii.masked(table(spark, texts)).orderBy("doc_id").collect()] == ["x [EMAIL][CARD] y", "[CARD][EMAIL] z"]


def test_mask_of_many_spans(spark):
    parts = [("é word ", ""), ("a.b@mail.com", "[EMAIL]"), (" 日 ", ""), ("+1 (743) 555-3824", "[PHONE]"), (", ", "")]
    text, want = ("".join(p[0] for p in parts) * 900, "".join(p[1] or p[0] for p in parts) * 900)
    assert pii.masked(table(spark, [text])).first().text == want


def test_many_matches_take_linear_time(spark):
    documents = table(spark, ["12.5 " * 60_000, "a@b.cc " * 40_000])
    began = time.time()
    rows = {r.doc_id: r for r in pii.digest(pii.find(documents)).collect()}
    assert rows[1].n_email == 40_000 and rows[0].n_card == 0 and rows[1].spans.startswith("email:0:6,email:7:13,")
    assert time.time() - began < 60


def test_national_numbers_and_given_names(spark):
    texts = [f"Please call (617) 555-12{i:02} today" for i in range(30)] + [f"ask Anna Schmidt{chr(97 + i)} about it" for i in range(20)] + ["in 1999 we had 0 items"] * 20
    spans = [r.spans for r in pii.digest(pii.find(table(spark, texts))).orderBy("doc_id").collect()]
    assert all(s == "national:12:26" for s in spans[:30]) and all(s == "person:4:17" for s in spans[30:50])
    assert spans[50:] == [""] * 20


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
DULL = ["internationalization2ofeverything", "getElementsByClassName2", "Donaudampfschifffahrtsgesellschaft", "user-profile-settings-v2", "2024-01-15T10-20-30Z", "some_long_identifier_name", "en/articles/2020/some-title-of-it", "z" * 40 + "1"]


def scores(tokens):
    """The battery, written out for single tokens: the bin of each."""
    from statistics import NormalDist

    tail = lambda z: 1 - NormalDist().cdf(z)
    out = []
    for t in tokens:
        body = t.replace("-", "+").replace("_", "/").rstrip("=")
        form, alphabet, (first, second) = next(e for e in secrets.ENCODINGS.values() if re.search(e[0], body))
        at = [alphabet.index(c if alphabet != alphabet.lower() else c.lower()) + 1 for c in body]
        n, size = len(at), len(alphabet)
        mean = n * (n - 1) / (2 * size)
        pairs = sum(v * (v - 1) / 2 for v in collections.Counter(at).values())
        groups = [g for g in (first, second, size - first - second) if g]
        seen = collections.Counter(0 if v <= first else 1 if second and v <= first + second else 2 for v in at)
        chi = sum((seen[k] - n * g / size) ** 2 / (n * g / size) for k, g in zip((0, 1, 2) if second else (0, 2), groups, strict=True))
        high = [v * 2 > size for v in at]
        n1, n2 = sum(high), n - sum(high)
        expected = 2 * n1 * n2 / n + 1
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        p_runs = 2.0 ** (1 - n) if not n1 * n2 else 2 * tail(abs(runs - expected) / max(1e-9, (expected - 1) * (expected - 2) / (n - 1)) ** 0.5)
        middle = sum(at) / n
        square = sum((v - middle) ** 2 for v in at)
        cross = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:]))
        serial = 0.0 if square < 1e-6 else 2 * tail(abs((cross / square + 1 / n) * n**0.5))
        ps = [tail((pairs - mean) / (mean * (1 - 1 / size)) ** 0.5), math.exp(-chi / 2) if second else 2 * tail(chi**0.5), p_runs, serial]
        half = -sum(math.log(max(min(p, 1), 1e-40)) for p in ps)
        p = min(1.0, math.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6))
        out.append(min(secrets.STEPS - 1, -math.log10(max(p, 1e-38)) * 10))
    return out


def test_battery_equals_single_tokens(spark):
    rng = random.Random(2)
    tokens = ["".join(rng.choice(a) for _ in range(n)) for n in (16, 25, 40, 90) for a in (ALPHABET, ALPHABET[:62], ALPHABET[26:62], "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(6)] + [d for d in DULL if "Z" not in d]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(list(enumerate(tokens)), "i int, t string").select("i", (-F.log10(F.greatest(secrets.p_random(F.col("t")), F.lit(1e-38))) * 10).alias("x")).orderBy("i").collect()
    assert all(abs(r.x - min(x, 380.0)) < 0.05 + 0.01 * x or x > 120 < r.x for r, x in zip(got, scores(tokens), strict=True))


def test_randomness(spark):
    rng = random.Random(3)
    secret = ["".join(rng.choice(ALPHABET) for _ in range(n)) for n in (40, 64, 88, 40, 60) * 6]
    dull = DULL * 4
    spans = [r.spans for r in secrets.digest(secrets.find(table(spark, [f"x {s} y" for s in secret + dull]))).orderBy("doc_id").collect()]
    assert sum(s.startswith("random:2:") for s in spans[:30]) >= 27
    assert sum(bool(s) for s in spans[30:]) <= 2


def test_short_random_tokens(spark):
    rng = random.Random(7)
    secret = ["".join(rng.choice(ALPHABET[:62]) for _ in range(20)) for _ in range(60)]
    spans = [r.spans for r in secrets.digest(secrets.find(table(spark, [f"DB_PASS: '{s}'" for s in secret] + [f"x {d} y" for d in DULL * 2]))).orderBy("doc_id").collect()]
    assert sum(s == "random:10:30" for s in spans[:60]) >= 20
    assert sum(bool(s) for s in spans[60:]) <= 2


def test_discoveries_are_bounded():
    texts = {(0, b): 100 * (b >= 5) for b in range(100)}
    found = secrets.first_text({(0, b): (40 if b < 5 else 10) for b in range(100)}, texts)[0]
    assert found == 5 and secrets.first_text({(0, b): 10 for b in range(100)}, {(0, b): 100 for b in range(100)})[0] == 0
    assert secrets.first_text({}, {}) == dict.fromkeys(range(len(secrets.STRATA)), 0)


def test_very_long_tokens(spark):
    rng = random.Random(11)
    big = ["".join(rng.choices(ALPHABET[:62], k=n)) for n in (5_000, 1_000_000)] + ["word" * 250_000]
    began = time.time()
    rows = secrets.digest(secrets.find(table(spark, [f"x {t} y" for t in big]))).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["random:2:5002", "random:2:1000002", ""]
    assert time.time() - began < 90


def test_random_values_behind_an_equals_sign(spark):
    rng = random.Random(5)
    forms = ["AWS_SECRET_ACCESS_KEY={}", "auth={}", "private_key={}", "https://h.example/f?sig={}", "https://h.example/f?a=1&sig={}&b=2", "x={}==", "x=={}"]
    values = ["".join(rng.choice(ALPHABET[:62]) for _ in range(40)) for _ in range(5 * len(forms))]
    texts = [forms[i % len(forms)].format(v) for i, v in enumerate(values)]
    found = [r.spans.split(",") for r in secrets.digest(secrets.find(table(spark, texts))).orderBy("doc_id").collect()]
    want = [f"random:{t.index(v)}:{t.index(v) + 40 + 2 * t.endswith('==')}" for t, v in zip(texts, values, strict=True)]
    hit = [w in f for w, f in zip(want, found, strict=True)]
    assert sum(hit) >= 32 and all(any(hit[i :: len(forms)]) for i in range(len(forms)))


def test_the_null_is_of_all_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(17)
    signs = [ALPHABET[:62], ALPHABET[26:62], ALPHABET[26:52], "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0189", "0123456789"]
    texts = [" é, ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 15))) for _ in range(n)) for a in signs for n in (1, 12, 40)] + ["ab+/c=d_e-f " * 9, "x" * 1000, "a" * 15 + " b", "", None]
    windows = []
    for text in texts:
        # words of fewer than 16 characters, without what isn't a letter or digit
        solid = "".join(c for t in re.findall(r"[A-Za-z0-9+/_=-]+", text or "") if len(t) < 16 for c in t if c.isalnum())
        for i, size in enumerate(secrets.STRATA):
            last = len(solid) - size
            windows += [(i, solid[k : k + size]) for k in sorted({*range(0, last + 1, size), last}) if k >= 0]
    want = spark.createDataFrame(windows, "stratum int, w string").select("stratum", secrets.step_of(secrets.p_random(F.col("w"))).alias("step")).coalesce(1).collect()
    seen = []
    monkeypatch.setattr(secrets, "first_text", lambda tokens, nulls: seen.append(collections.Counter(nulls)) or dict.fromkeys(range(len(secrets.STRATA)), 0))
    secrets.find(table(spark, texts).coalesce(1))
    want = collections.Counter((r.stratum, r.step) for r in want)
    # besides, there are the windows of PROSE
    assert not want - seen[0] and sum(seen[0].values()) == len(windows) + len(secrets.PROSE) * len(secrets.STRATA)
