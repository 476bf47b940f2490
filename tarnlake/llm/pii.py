"""PII by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are found by wide patterns: the base kinds (email, ip, card, phone) whether or not
their checks pass, and names behind a title, given names with a surname, handles, addresses,
national phone numbers, account and identity numbers. Four labelers vote 1 (personal), -1 (not)
or 0 on each:

- regex: the strict form of the kind, with its checks (Luhn, ranges, digit counts);
- gazetteer: titles, given names, street words, account countries, mail hosts; units against;
- before: words in the 32 characters before (the match before included, what lies before that not)
  that announce personal data, or versions and pages;
- shape: dates, decimals and runs of one digit against; digit counts of the kind in favour.

Votes are few patterns, so that their counts (at most 3**4 for each kind) are all the driver sees.
Expectation-maximisation with conditionally independent labelers gives each labeler's vote
distribution and each pattern's posterior. A logistic span classifier over votes, kind and length
is trained on the posteriors, and decides on every candidate that isn't a base span, those of the
base kinds that fail their checks among them; base spans always stay, and candidates that overlap
one are dropped. Every step is linear in a text and its matches.

All of it is DataFrame expressions; candidates are written once to the shared folder.

Defined results: null and empty texts have no spans; repeated rows are treated alike; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import quoted, settle
from tarnlake.llm.spans import FOUND, apart, bind, blocks, listed, matches, number, running

BASE = ["email", "ip", "card", "phone"]
#: Patterns that find what the contract's do, in linear time: a match can start only where a run
#: of the first class starts or where the last match ended, and repeats don't backtrack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sr|Sra)\.?\x20\p{Lu}\p{L}{1,30}+(?:\x20\p{Lu}\p{L}{1,30}+)?",
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{3,30}+(?![A-Za-z0-9_.@])",
    "address": r"(?<![0-9])[0-9]{1,5}+\x20(?:\p{Lu}\p{L}{1,20}+\x20){1,2}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Boulevard|Blvd)(?!\p{L})",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<!\p{L})(?:James|John|Mary|Anna|Maria|Peter|Paul|Thomas|Michael|Sarah|Laura|David|Hans|Klaus|Jean|Pierre|Marie|José|Carlos|Juan|Sofia|Emma|Lucas)\x20\p{Lu}\p{Ll}{1,30}+(?!\p{L})",
    "national": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{2,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9A-Za-z-])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = list(PATTERNS)
#: What a text must hold for a kind's search to be worthwhile.
NEEDS = {"email": "@", "handle": "@", "phone": "+", "ip": ".", "identity": "-"}
LABELERS = ["regex", "gazetteer", "before", "shape"]

ANNOUNCE = r"(?i)(?:phone|tel|call|fax|mobile|contact|mail|name|account|iban|card|visa|ssn|passport|address|lives|born|host|client|téléphone|telefon|teléfono|konto|cuenta|compte|courriel|correo|adresse|dirección)[^\p{L}]{0,6}(?:\p{L}{1,8}[^\p{L}]{1,3})?$"
AGAINST = r"(?i)(?:version|release|page|chapter|section|isbn|issn|figure|table|line|build|seite|kapitel|capítulo|página|chapitre)[^\p{L}]{0,4}$"
#: Given names of the gazetteer; those of the pattern of persons are the same.
GIVEN = r"(?i)(?<!\p{L})(?:james|john|mary|anna|maria|peter|paul|thomas|michael|sarah|laura|david|hans|klaus|jean|pierre|marie|josé|carlos|juan|sofia|emma|lucas)(?!\p{L})"
TITLE = r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sr|Sra)"
#: Least probability of the classifier for a span beyond the base ones.
LEAST = 0.5
COUNTRY = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
HOST = r"@(?:mail|gmail|outlook|yahoo|proton|web|gmx|example)"
UNIT = r"(?i)^\x20?(?:%|km|kg|mm|cm|ms|eur|usd|€|\$|mb|gb)(?!\p{L})"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of a string of at most 19 digits."""
    n = F.length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, F.substring(number, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(d * 2 % 10 + d * 2 // 10) for d in range(10)]), F.substring(number, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def at_most_255(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def strict(kind: str, text: Column, own: Column) -> Column:
    """Whether a match of a kind passes the contract's checks; own: its digits."""
    size = F.length(own)
    if kind == "card":
        return F.when(size.between(12, 19), luhn(own)).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), at_most_255)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0).cast("int")


def votes(kind: str, x: Column) -> dict[str, Column]:
    """Of a candidate with text, own (its digits), good (whether its checks pass), before and after."""
    text, own, good, before, after = x["text"], x["own"], x["good"], x["before"], x["after"]
    never = F.lit(False)
    if kind == "national":
        good = F.length(own).between(9, 13)
    regex = vote(good if kind in (*BASE, "account", "identity", "address", "national") else never, ~good)
    named = {"name": text.rlike(TITLE), "person": F.lit(True), "handle": never, "address": F.lit(True), "account": text.rlike(COUNTRY), "email": text.rlike(HOST)}.get(kind, never)
    shape_no = text.rlike(r"^(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}") | own.rlike(r"^([0-9])\1{6,}$")
    shape_yes = {"email": F.lit(True), "card": F.length(own).between(13, 16), "phone": F.length(own).between(10, 13), "ip": F.lit(True), "account": F.length(text) >= 15, "name": text.rlike(r"\x20\p{Lu}\p{L}+\x20\p{Lu}"), "person": F.lit(True), "national": F.length(own).between(9, 12), "identity": F.lit(True), "address": F.lit(True)}.get(kind, never)
    return {"regex": regex, "gazetteer": vote(named | text.rlike(GIVEN), after.rlike(UNIT)), "before": vote(before.rlike(ANNOUNCE), before.rlike(AGAINST)), "shape": vote(shape_yes, shape_no)}


def candidates(documents: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id (and with carry the whole row as a struct, carry) and found: kind, start, end, base,
    size and votes of each candidate."""
    text = F.coalesce("text", F.lit(""))
    kept = [F.struct(*quoted(documents.columns)).alias("carry")] if carry else []
    found = []
    for kind, pattern in PATTERNS.items():
        spans = matches(F.col("text"), pattern)
        if kind in NEEDS:
            spans = F.when(F.contains("text", F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(FOUND))
        found.append(F.transform(spans, _told(kind)))
    source = documents.select("doc_id", text.alias("text"), *kept)
    return source.select("doc_id", *["carry"] * carry, F.concat(*found).alias("found"))


def _told(kind: str):
    """A found span as a candidate with its votes."""

    def told(x: Column) -> Column:
        own = digits(x["text"]) if kind in ("card", "phone", "national") else F.lit("")
        return bind(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), own.alias("own"), x["before"].alias("before"), F.substring(x["after"], 1, 8).alias("after")), checked)

    def checked(x: Column) -> Column:
        good = strict(kind, x["text"], x["own"])
        return bind(F.struct(*[x[n].alias(n) for n in ("start", "end", "text", "own", "before", "after")], good.alias("good")), judged)

    def judged(x: Column) -> Column:
        size = F.least(F.lit(4), F.floor((x["end"] - x["start"]) / 8)).cast("int")
        base = x["good"] if kind in BASE else F.lit(False)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), size.alias("size"), *[v.alias(k) for k, v in votes(kind, x).items()])

    return told


def em(counts: list[tuple[tuple, float]], rounds: int = 50) -> tuple[dict, float, list[dict]]:
    """Posterior of each vote pattern, share of class 1, and each labeler's vote shares by class.
    counts: (votes, number). Starts from the majority; shares are smoothed by one count."""
    post = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in counts}
    share, tables = 0.5, []
    for _ in range(rounds if counts else 0):
        total = sum(n for _, n in counts)
        mass = sum(n * post[v] for v, n in counts)
        share = (mass + 1) / (total + 2)
        tables = []
        for i in range(len(LABELERS)):
            table = {}
            for value in (-1, 0, 1):
                # a vote's prior count leans to its meaning, so that classes can't swap
                up = sum(n * post[v] for v, n in counts if v[i] == value) + (2 if value == 1 else 1)
                down = sum(n * (1 - post[v]) for v, n in counts if v[i] == value) + (2 if value == -1 else 1)
                table[value] = (up / (mass + 4), down / (total - mass + 4))
            tables.append(table)
        for v, _ in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(t[x][0] / t[x][1]) for t, x in zip(tables, v, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, share, tables


def features(kind: str, size: int, pattern: tuple) -> list[str]:
    return ["bias", f"kind={kind}", f"size={size}", *(f"{name}={v}" for name, v in zip(LABELERS, pattern, strict=True) if v)]


def train(rows: list[tuple[str, int, tuple, float]], post: dict, steps: int = 300) -> dict[str, float]:
    """Weights of the span classifier from (kind, size, votes, number) and the patterns' posteriors."""
    weights = {f: 0.0 for k, s, v, _ in rows for f in features(k, s, v)}
    by_kind: dict[str, float] = {}
    for kind, _, _, n in rows:
        by_kind[kind] = by_kind.get(kind, 0.0) + n
    for _ in range(steps if rows else 0):
        grads = {f: 0.02 * w for f, w in weights.items()}
        for kind, size, v, n in rows:
            own = features(kind, size, v)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in own)))))
            for f in own:
                grads[f] += n / by_kind[kind] * (p - post[v])
        for f, g in grads.items():
            weights[f] -= 0.3 * g
    return weights


def decide(x: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability as an expression over a candidate."""
    z = F.lit(weights.get("bias", -1.0))
    for name, column in (("kind", x["kind"]), ("size", x["size"]), *((n, x[n]) for n in LABELERS)):
        case = None
        for f, w in weights.items():
            if f.startswith(f"{name}="):
                value = f.split("=", 1)[1]
                test = column == (value if name == "kind" else int(value))
                case = F.when(test, F.lit(w)) if case is None else case.when(test, F.lit(w))
        if case is not None:
            z = z + case.otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find(documents: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, base and more: arrays of spans (kind, start, end, probability); with carry also the
    whole row as a struct."""
    held = settle(candidates(documents, carry), "candidates")
    kept = ["carry"] * carry
    each = held.select(F.explode("found").alias("x")).select("x.*")
    counts = each.groupBy("kind", "size", *LABELERS).agg(F.count("*").alias("n")).collect()
    rows = sorted((r.kind, r["size"], tuple(r[k] for k in LABELERS), float(r.n)) for r in counts)
    patterns: dict[tuple, float] = {}
    for _, _, v, n in rows:
        patterns[v] = patterns.get(v, 0.0) + n
    post, _, _ = em(sorted(patterns.items()))
    weights = train(rows, post)

    def span(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.when(x["base"], 1.0).otherwise(decide(x, weights)).alias("probability"))

    base = F.transform(F.filter("found", lambda x: x["base"]), span)
    rest = F.filter(F.transform(F.filter("found", lambda x: ~x["base"]), span), lambda x: x["probability"] >= LEAST)
    out = held.select("doc_id", *kept, base.alias("base"), rest.alias("rest"))
    return out.select("doc_id", *kept, "base", apart(F.col("rest"), F.col("base")).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    counts = [number(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.concat("base", "more"), KINDS).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (by start) replaced by [KIND]; of a span that starts within
    an earlier one only what lies behind that is left to replace."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def cut(x: Column) -> Column:
        done = running(F.transform(x["order"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        told = F.transform(F.arrays_zip(x["order"].alias("s"), done.alias("at")), lambda z: F.struct(z["at"].alias("at"), *[z["s"][k].alias(k) for k in ("start", "end", "kind")]))
        return bind(F.struct(x["text"].alias("text"), F.filter(told, lambda z: z["end"] > z["at"]).alias("told")), joined)

    def joined(x: Column) -> Column:
        # the text of a block of spans is taken out first: substring() walks from a string's start
        pieces = F.transform(blocks(x["told"]), lambda part: _pieces(x["text"], part))
        last = F.get(x["told"], F.size(x["told"]) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), F.substring(x["text"], (last + 1).cast("int"), F.length(x["text"])))

    return F.when(F.size(spans) > 0, bind(F.struct(text.alias("text"), order.alias("order")), cut)).otherwise(text)


def _pieces(text: Column, part: Column) -> Column:
    first = F.get(part, F.lit(0))["at"]
    own = F.substring(text, (first + 1).cast("int"), (F.get(part, F.size(part) - 1)["start"] - first).cast("int"))

    def each(x: Column) -> Column:
        # of spans that overlap, the second has nothing between
        return F.array_join(F.transform(x["part"], lambda z: F.concat(F.substring(x["own"], (z["at"] - x["first"] + 1).cast("int"), F.greatest(z["start"] - z["at"], F.lit(0)).cast("int")), F.lit("["), F.upper(z["kind"]), F.lit("]"))), "")

    return bind(F.struct(own.alias("own"), first.alias("first"), part.alias("part")), each)


def masked(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind, and n_chars (if there) counted anew."""
    found = find(documents, carry=True).withColumn("masked", mask(F.col("carry.text"), F.concat("base", "more")))
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("carry.text").isNotNull(), F.length("masked")).otherwise(F.col("carry.n_chars"))} if "n_chars" in documents.columns else {"text": F.col("masked")}
    return found.select(*[new.get(c, F.col("carry").getField(c)).cast(documents.schema[c].dataType).alias(c) for c in documents.columns])
