"""Secret scans: a battery of randomness tests under false-discovery control.

Base spans are the contract's assign, access and hex patterns. Beyond them every token of 16
characters or more that isn't of digits alone is tested, by the encoding that its characters
allow (hex, base32, lower- or upper-case base36, base62, base64), for how well it passes as random:

- uniformity: chi-squared of the alphabet's counts, as the number of equal pairs against its
  Poisson mean, which holds for short tokens too, and chi-squared of its letter and digit classes;
- runs: Wald and Wolfowitz's number of runs above and below the alphabet's middle;
- serial correlation of neighbouring characters' places in the alphabet.

Fisher's sum joins the p-values to one score. A discovery is a secret, so the hypothesis to reject
is "text": its distribution of scores is that of text-like strings of the same length, in each
stratum of lengths by itself. They are windows of running text without separators and long tokens:
for each stratum the whole of every text of the table, cut into one window after the other (a last
one ends with the text), and those of ``PROSE``, so that small tables have some too. A token's p-value is the share of text-like strings that look as random, and
Benjamini and Hochberg's procedure at level ``LEVEL`` bounds the share of text among the tokens
that are found in a stratum. Short tokens give the tests less power, and find less. What is found
is a secret of kind random, unless it overlaps a base span.

All of it is DataFrame expressions, in time linear in a text. The tokens'
scores are written once to the shared folder, those of the windows are counted as they are made; the
driver sees the histograms alone (``STEPS`` bins for a stratum). Windows are far more than tokens:
their sums come from bit planes, 48 characters to a number (``planes`` and ``window_sums``).

Defined results: null and empty texts have no spans; repeated rows are treated alike, and their
tokens are tested as often; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import settle
from tarnlake.llm.spans import FOUND, apart, bind, listed, matches, number

BASE = ["assign", "access", "hex"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The contract's minimum lengths are in the pattern where a run's length is the match's.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: Padding ends a token; what follows it, as a value follows its name's "=", starts another.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: What of a text windows are cut from, to stand for text: all but long tokens and separators.
RUNNING = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{1,15}+(?![A-Za-z0-9+/_=-])"
#: A stretch's length and what is taken out of it, its ends too: of PROSE, and in the SQL, whose
#: text-like strings are still one window from a stretch of each text.
STRETCH = 400
NOT_TEXT = r"^[A-Za-z0-9+/_=-]+|[A-Za-z0-9+/_=-]+\z|[A-Za-z0-9+/_=-]{16,}|[^A-Za-z0-9]+"
#: Least lengths of the strata; windows of text have these lengths.
STRATA = [16, 24, 32, 48, 96]
#: Texts are cut into pieces of this length, a multiple of every stratum's, of two halves.
PIECE = 96
HALF = 48
LEVEL = 0.05
STEPS = 400
#: Of each encoding: its characters, its alphabet in order, and the sizes of the alphabet's first classes.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", (10, 0)),
    "base32": (r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", (26, 0)),
    "base36": (r"^(?:[a-z0-9]+|[A-Z0-9]+)$", "abcdefghijklmnopqrstuvwxyz0123456789", (26, 0)),
    "base62": (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (26, 26)),
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26, 26)),
}
#: Running text, for windows that stand for text whatever the table holds.
PROSE = (
    "The old mill by the river was sold last spring to a family from the coast who had never seen snow before. "
    "They painted its shutters green, mended the wheel and opened a small bakery where people from five villages meet on Saturdays. "
    "Der Bahnhof liegt am Rand der Stadt, und wer abends ankommt, hört zuerst die Glocken und dann den Wind in den Pappeln. "
    "Nous avons marché longtemps le long du canal, puis le café a fermé et chacun est rentré chez soi sans parler. "
    "Cuando llegaron las lluvias los caminos desaparecieron y durante semanas solo se podía cruzar el valle en barca. "
    "Reading the config file takes a moment, because every setting is checked twice and unknown names are reported with their line number. "
    "Her second letter arrived in October 1987; it spoke of the garden, the new roof, and a dog that answers to three names."
)


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) by Zelen and Severo's series."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def p_random(token: Column) -> Column:
    """How well a token passes as random text of its encoding: near uniform in 0 to 1 if it is."""
    return bind(F.rtrim(F.translate(token, "-_=", "+/ ")), _encoded)


def _encoded(body: Column) -> Column:
    """What the tests need of a token, by the first encoding that its characters allow."""
    out = None
    for form, alphabet, classes in reversed(list(ENCODINGS.values())):
        own = body if alphabet != alphabet.lower() else F.lower(body)
        known = bind(own, _counted(alphabet, *classes))
        out = known if out is None else F.when(body.rlike(form), known).otherwise(out)
    return bind(out, _tests)


def _counted(alphabet: str, first: int, second: int):
    """Sums over a token: whole numbers, so that their order doesn't matter. What doesn't depend on
    the order of the characters comes from the numbers of each (at most the alphabet's size)."""
    size = len(alphabet)
    halves = "".join("L" if 2 * v <= size else "H" for v in range(1, size + 1))

    def place(c: Column) -> Column:
        return F.position(c, F.lit(alphabet)).cast("long")

    def counted(own: Column) -> Column:
        return bind(F.struct(own.alias("own"), F.split(own, "").alias("each"), F.translate(own, alphabet, halves).alias("halves")), of)

    def of(x: Column) -> Column:
        own = x["own"]
        numbers = F.transform(F.array_distinct(x["each"]), lambda c: F.struct(place(c).alias("v"), (F.length(own) - F.length(F.replace(own, c, F.lit("")))).cast("long").alias("n")))
        at = F.transform(x["each"], place)
        turns = sum((F.length(own) - F.length(F.replace(x["halves"], F.lit(t), F.lit("")))) / 2 for t in ("LH", "HL"))
        high = F.length(F.replace(x["halves"], F.lit("L"), F.lit("")))
        return F.struct(F.aggregate(numbers, start, add, lambda acc: F.struct(*[acc[n].cast("double").alias(n) for n in names])).alias("sums"), bind(at, _cross).alias("cross"), turns.alias("changes"), high.cast("double").alias("high"), F.length(own).cast("double").alias("n"), F.lit(float(size)).alias("size"), F.lit(first).alias("first"), F.lit(second).alias("second"), place(F.substring(own, 1, 1)).alias("a"), place(F.substring(own, -1, 1)).alias("z"))

    names = ("pairs", "sum", "square", "c1", "c2")
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])

    def add(acc: Column, x: Column) -> Column:
        v, n = x["v"], x["n"]
        new = {"pairs": acc["pairs"] + (n * (n - 1) / 2).cast("long"), "sum": acc["sum"] + n * v, "square": acc["square"] + n * v * v, "c1": acc["c1"] + F.when(v <= first, n).otherwise(0), "c2": acc["c2"] + F.when((v > first) & (v <= first + second), n).otherwise(0)}
        return F.struct(*[new[k].cast("long").alias(k) for k in names])

    return counted


def _cross(at: Column) -> Column:
    """Sum of the products of neighbours."""
    return F.aggregate(F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: a * F.coalesce(b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, v: acc + v).cast("double")


def _tests(x: Column) -> Column:
    """Fisher's sum of the battery's p-values, as one value."""
    return bind(bind(_measures(x), _half), _fisher)


def _measures(x: Column) -> Column:
    """The tests' statistics, of which _half makes p-values."""
    n, size, sums = x["n"], x["size"], x["sums"]
    mean = n * (n - 1) / (2 * size)
    e1, e2 = n * x["first"] / size, n * x["second"] / size
    e3, c3 = n - e1 - e2, n - sums["c1"] - sums["c2"]
    one = (sums["c1"] - e1) * (sums["c1"] - e1) / e1 + (c3 - e3) * (c3 - e3) / e3
    two = one + (sums["c2"] - e2) * (sums["c2"] - e2) / F.greatest(e2, F.lit(1e-9))
    n1, n2 = x["high"], n - x["high"]
    expected = 2 * n1 * n2 / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    middle = sums["sum"] / n
    square = sums["square"] - n * middle * middle
    cross = x["cross"] - middle * (2 * sums["sum"] - x["a"] - x["z"]) + (n - 1) * middle * middle
    found = {
        "uniform": (sums["pairs"] - mean) / F.sqrt(mean * (1 - 1 / size)),
        "one": F.sqrt(one),
        "two": F.when(x["second"] > 0, two),
        "runs": F.when((n1 != 0) & (n2 != 0), F.abs(x["changes"] + 1 - expected) / spread),
        "serial": F.when(square >= 1e-6, F.abs((cross / square + 1 / n) * F.sqrt(n))),
        "n": n,
    }
    return F.struct(*[v.alias(k) for k, v in found.items()])


def _half(x: Column) -> Column:
    """Minus the sum of the logarithms of the battery's p-values."""
    classes = F.when(x["two"].isNotNull(), F.exp(-x["two"] / 2)).otherwise(2 * upper_tail(x["one"]))
    runs = F.when(x["runs"].isNull(), F.pow(F.lit(2.0), 1 - x["n"])).otherwise(2 * upper_tail(x["runs"]))
    serial = F.when(x["serial"].isNull(), F.lit(0.0)).otherwise(2 * upper_tail(x["serial"]))
    logs = [F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-40))) for p in (upper_tail(x["uniform"]), classes, runs, serial)]
    return -(logs[0] + logs[1] + logs[2] + logs[3])


def _fisher(half: Column) -> Column:
    return F.least(F.lit(1.0), F.exp(-half) * (1 + half + half * half / 2 + half * half * half / 6))


def step_of(p: Column) -> Column:
    """A score's bin: 0 is the most random."""
    return F.least(F.lit(STEPS - 1), F.floor(-F.log10(F.greatest(p, F.lit(1e-38))) * 10)).cast("int")


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, base spans (kind, start, end), and tested tokens (start, end, stratum, bin of p)."""
    text = F.coalesce("text", F.lit(""))
    small = F.lower(F.col("text"))
    named = F.contains(small, F.lit("pass")) | F.contains(small, F.lit("secret")) | F.contains(small, F.lit("token")) | F.contains(small, F.lit("api"))
    # lower() also turns two other letters (a Kelvin sign, a dotted capital I) into a-z: such a text is only searched in vain
    none = F.array().cast(FOUND)
    assign = F.filter(F.when(named, matches(F.col("text"), ASSIGN, 1)).otherwise(none), lambda x: F.length(x["part"]) >= 8)
    access = F.when(F.contains("text", F.lit("AKIA")), matches(F.col("text"), ACCESS)).otherwise(none)
    kinds = {"assign": assign, "access": access, "hex": matches(F.col("text"), HEX)}
    base = F.concat(*[F.transform(v, _named(k)) for k, v in kinds.items()])
    tokens = F.filter(matches(F.col("text"), TOKEN), lambda x: x["text"].rlike("[A-Za-z]"))

    def tested(x: Column) -> Column:
        stratum = sum(((F.length(x["text"]) >= s).cast("int") for s in STRATA[1:]), F.lit(0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum.alias("stratum"), step_of(p_random(x["text"])).alias("step"))

    return documents.select("doc_id", text.alias("text")).select("doc_id", base.alias("base"), F.transform(tokens, tested).alias("tested"))


def text_like(solid: Column, place: Column) -> Column:
    """stratum and step of a window of each stratum's length, at a place (modulo their number)."""

    def each(x: Column) -> Column:
        size = F.length(x["solid"])
        lengths = F.filter(F.array(*[F.struct(F.lit(i).alias("stratum"), F.lit(s).alias("length")) for i, s in enumerate(STRATA)]), lambda s: s["length"] <= size)
        return F.transform(lengths, lambda s: F.struct(s["stratum"].alias("stratum"), F.substring(x["solid"], (x["place"] % (size - s["length"] + 1) + 1).cast("int"), s["length"]).alias("text")))

    windows = bind(F.struct(solid.alias("solid"), place.alias("place")), each)
    return F.transform(windows, lambda w: F.struct(w["stratum"].alias("stratum"), step_of(p_random(w["text"])).alias("step")))


def running_windows(documents: DataFrame) -> DataFrame:
    """stratum and step of all windows of all texts: for each stratum a text is cut into windows of its
    length from the start on, and a rest too short for one is in a window that ends with the text."""
    size = F.length("solid")
    ends = [F.when((size >= s) & (size % s != 0), F.struct(F.lit(i).alias("only"), F.expr(f"right(solid, {s})").alias("w"))) for i, s in enumerate(STRATA)]
    pieces = F.transform(F.regexp_extract_all("solid", F.lit(f".{{1,{PIECE}}}"), F.lit(0)), lambda w: F.struct(F.lit(-1).alias("only"), w.alias("w")))
    # explode would be given filters that make the array again
    words = F.regexp_extract_all("text", F.lit(RUNNING), F.lit(0))
    cut = documents.select(F.translate(F.array_join(words, ""), "+/_=-", "").alias("solid")).select(F.explode_outer(F.concat(pieces, F.array(*ends))).alias("x")).where("x is not null")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("stratum"), F.lit(s).alias("size"), F.lit(start).alias("start")) for i, s in enumerate(STRATA) for start in range(0, PIECE, s)]))
    every = planes(cut.select("x.only", "x.w")).select("*", at.alias("at")).select("*", "at.*").where("(only < 0 and start + size <= length) or (only = stratum and start = 0)")
    scored = window_sums(every)
    for name, f in (("x", _measures), ("x", _half), ("x", _fisher), ("step", step_of)):
        scored = scored.select(F.expr(_alone("stratum")), f(F.col("x")).alias(name))
    return scored


def _alone(name: str) -> str:
    """A column as it is, by a lambda, which keeps its projection out of the code that Spark makes of
    several operators at once: Java doesn't compile methods as large as that of all these sums."""
    return f"get(transform(array({name}), v -> v), 0) AS {name}"


def planes(pieces: DataFrame) -> DataFrame:
    """only, length, and the seven bits of the ASCII letters and digits of w (PIECE at most): lo0 to
    lo6 are of its first HALF, hi0 to hi6 of the others, the first character in the highest bit.
    Eight characters are a number of eight bytes, whose bits are transposed in three steps."""
    blocks = range(PIECE // 8)
    out = pieces.selectExpr("only", "length(w) AS length", f"hex(rpad(w, {PIECE}, '0')) AS h").selectExpr(_alone("only"), "length", *[f"coalesce(cast(conv(substring(h, {16 * k + 1}, 16), 16, 10) AS bigint), 0L) AS x{k}" for k in blocks])
    for n, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0xF0F0F0F0)):
        swap = [f"((x{k} ^ shiftrightunsigned(x{k}, {n})) & {mask}L)" for k in blocks]
        out = out.selectExpr(_alone("only"), "length", *[f"x{k} ^ {t} ^ shiftleft({t}, {n}) AS x{k}" for k, t in enumerate(swap)])
    n = HALF // 8
    return out.selectExpr(_alone("only"), "length", *[" | ".join(f"shiftleft(shiftrightunsigned(x{first + k}, {8 * b}) & 255L, {8 * (n - 1 - k)})" for k in range(n)) + f" AS {name}{b}" for name, first in (("lo", 0), ("hi", n)) for b in range(7)])


def window_sums(every: DataFrame) -> DataFrame:
    """stratum and x, what the tests need of the window of size characters from start on: the same
    whole numbers as _counted's, by counting bits. A window has its bits in a0 to a6, those of more
    than HALF characters the later ones in b0 to b6. Bits 0 to 4 of a letter are its place in the
    alphabet, those of a digit 16 more than it; a place in the encoding's alphabet is that number
    plus o, plus d for a digit, plus e for what isn't a capital; ends and seam are without o."""
    full, right = (1 << HALF) - 1, f"({PIECE} - start - size)"
    mask = f"(shiftleft(1L, size) - 1L)"
    a = [f"CASE WHEN size > {HALF} THEN lo{b} WHEN {right} >= {HALF} THEN shiftrightunsigned(lo{b}, {right} - {HALF}) & {mask} ELSE (shiftleft(lo{b}, {HALF} - {right}) | shiftrightunsigned(hi{b}, {right})) & {mask} END AS a{b}" for b in range(7)]
    out = every.selectExpr(_alone("stratum"), "size", f"least(size, {HALF}) AS wide", f"CASE WHEN size > {HALF} THEN {full}L ELSE {mask} END AS am", f"CASE WHEN size > {HALF} THEN {full}L ELSE 0L END AS bm", *a, *[f"CASE WHEN size > {HALF} THEN hi{b} ELSE 0L END AS b{b}" for b in range(7)])
    for h in "ab":  # capitals, small letters, digits, all but capitals
        out = out.selectExpr("*", f"{h}6 & ~{h}5 AS {h}u", f"{h}6 & {h}5 AS {h}l", f"{h}m & ~{h}6 AS {h}d", f"{h}m & ({h}5 | ~{h}6) AS {h}e")

    def none(bits: str) -> str:
        return f"({' | '.join('(' + bits.replace('@', h) + ')' for h in 'ab')}) = 0"

    one_case = f"({none('@u')} OR {none('@l')})"
    out = out.selectExpr("*", f"CASE WHEN {none('@6 & (@4 | @3 | (@2 & @1 & @0))')} AND {one_case} THEN 16 WHEN {none('@l')} AND {none('@d & (@3 | ~(@2 | @1))')} THEN 32 WHEN {one_case} THEN 36 ELSE 62 END AS code")
    above = "CASE code WHEN 62 THEN @d | (@l & (@4 | @3 | (@2 & @1))) WHEN 36 THEN @d | (@6 & @4 & (@3 | @2 | (@1 & @0))) WHEN 32 THEN @d | (@6 & @4 & (@3 | @2 | @1 | @0)) ELSE @6 | (@d & @3) END AS @h"
    out = out.selectExpr("*", *[above.replace("@", h) for h in "ab"], "CASE code WHEN 16 THEN 10 ELSE 0 END AS o", "CASE code WHEN 16 THEN -25 WHEN 32 THEN 9 ELSE 11 END AS d", "CASE code WHEN 62 THEN 26 ELSE 0 END AS e")

    def count(bits: str) -> str:
        return f"(bit_count({bits.replace('@', 'a')}) + bit_count({bits.replace('@', 'b')}))"

    def symbol(kind: str, low: int, bits: int) -> str:
        return count(" & ".join([f"@{kind}"] + [f"@{b}" if low >> b & 1 else f"~@{b}" for b in range(bits)]))

    def next_to(first: str, second: str) -> str:
        return count(f"@{first} & shiftrightunsigned(@{second}, 1)")

    def weighed(of: Callable[[int], str]) -> str:
        return " + ".join(f"{1 << b} * {of(b)}" for b in range(5))

    def place(h: str, at: str) -> str:
        bit = lambda k: f"(shiftrightunsigned({h}{k}, {at}) & 1L)"
        return f"({weighed(bit)} + d * {bit('d')} + e * {bit('e')})"

    symbols = [symbol(k, v, 5) for k in "ul" for v in range(1, 27)] + [symbol("d", v, 4) for v in range(10)]
    sums = {"s": weighed(lambda b: count(f"@{b}")), "sd": weighed(lambda b: count(f"@{b} & @d")), "se": weighed(lambda b: count(f"@{b} & @e")), "ss": " + ".join(f"{(1 + (b < c)) << b + c} * {count(f'@{b} & @{c}')}" for b in range(5) for c in range(b, 5))}
    sums |= {f"n{k}": count(f"@{k}") for k in "ulde"}
    # with more than 100 columns Spark makes small methods of them, which Java compiles
    sums |= {f"c{b}{c}": next_to(b, c) for b in range(5) for c in range(5)}
    sums |= {f"c{b}{k}": f"{next_to(b, k)} + {next_to(k, b)}" for b in range(5) for k in "de"} | {"cdd": next_to("d", "d"), "cee": next_to("e", "e"), "cde": f"{next_to('d', 'e')} + {next_to('e', 'd')}"}
    sums |= {"high": count("@h"), "changes": f"bit_count((ah ^ shiftrightunsigned(ah, 1)) & shiftrightunsigned(am, 1)) + bit_count((bh ^ shiftrightunsigned(bh, 1)) & shiftrightunsigned(bm, 1)) + CASE WHEN size > {HALF} THEN (ah ^ shiftrightunsigned(bh, {HALF - 1})) & 1L ELSE 0L END"}
    sums |= {"ends": f"{place('a', 'wide - 1')} + CASE WHEN size > {HALF} THEN {place('b', '0')} ELSE {place('a', '0')} END", "seam": f"CASE WHEN size > {HALF} THEN {place('a', '0')} * {place('b', str(HALF - 1))} ELSE 0L END"}
    out = out.selectExpr("stratum", "size", "code", "o", "d", "e", *[f"{v} AS {k}" for k, v in sums.items()], *[f"{v} AS n{i}" for i, v in enumerate(symbols)])
    plain = "(s + d * nd + e * ne)"
    cross = f"{' + '.join(f'{1 << b + c} * c{b}{c}' for b in range(5) for c in range(5))} + {' + '.join(f'{1 << b} * {k} * c{b}{k}' for b in range(5) for k in 'de')} + d * d * cdd + e * e * cee + d * e * cde + seam"
    found = {
        "pairs": f"({' + '.join(f'n{i} * (n{i} - 1)' for i in range(len(symbols)))}) / 2",
        "sum": f"{plain} + o * size",
        "square": f"ss + 2 * (d * sd + e * se + d * e * nd) + d * d * nd + e * e * ne + 2 * o * {plain} + o * o * size",
        "c1": "CASE code WHEN 62 THEN nu WHEN 16 THEN nd ELSE nu + nl END",
        "c2": "CASE code WHEN 62 THEN nl ELSE 0 END",
        "cross": f"{cross} + o * (2 * {plain} - ends) + (size - 1) * o * o",
        "ends": "ends + 2 * o",
    }
    out = out.selectExpr("stratum", "size", "code", "high", "changes", *[f"CAST({v} AS double) AS {k}" for k, v in found.items()])
    names = ["pairs", "sum", "square", "c1", "c2"]
    others = [F.col("cross"), *[F.col(k).cast("double").alias(k) for k in ("changes", "high")], F.col("size").cast("double").alias("n"), F.col("code").cast("double").alias("size"), F.expr("CASE code WHEN 16 THEN 10 ELSE 26 END AS first"), F.expr("CASE code WHEN 62 THEN 26 ELSE 0 END AS second"), F.col("ends").alias("a"), F.lit(0.0).alias("z")]
    return out.select("stratum", F.struct(F.struct(*names).alias("sums"), *others).alias("x"))


def first_text(tokens: dict[tuple[int, int], int], texts: dict[tuple[int, int], int], level: float = LEVEL) -> dict[int, int]:
    """For each stratum the first bin that isn't found (0: nothing is). tokens and texts: numbers of
    tested tokens and of text-like strings by (stratum, bin). A token's p-value is the share of
    text-like strings in its bin or a more random one; Benjamini and Hochberg's procedure."""
    out = {}
    for stratum in range(len(STRATA)):
        total = sum(n for (s, _), n in tokens.items() if s == stratum)
        null = sum(n for (s, _), n in texts.items() if s == stratum)
        out[stratum], rank, like = 0, 0, 1
        for step in range(STEPS):
            n = tokens.get((stratum, step), 0)
            rank += n
            like += texts.get((stratum, step), 0)
            if n and like / (null + 1) <= level * rank / total:
                out[stratum] = step + 1
    return out


def find(documents: DataFrame) -> DataFrame:
    """doc_id, base and more: arrays of spans (kind, start, end)."""
    spark = documents.sparkSession
    held = settle(candidates(documents), "tokens")
    solid = F.regexp_replace(F.lit(PROSE), NOT_TEXT, "")
    fixed = spark.range(len(PROSE)).select(F.explode(text_like(solid, F.col("id"))).alias("x"), F.lit(False).alias("token"))
    own = held.select(F.explode("tested").alias("x")).select(F.struct("x.stratum", "x.step").alias("x"), F.lit(True).alias("token"))
    texts = running_windows(documents).select(F.struct("stratum", "step").alias("x"), F.lit(False).alias("token")).unionAll(fixed)
    counts = own.unionAll(texts).groupBy("token", "x.stratum", "x.step").agg(F.count("*").alias("n")).collect()
    found = first_text(*[{(r.stratum, r.step): r.n for r in counts if r.token == token} for token in (True, False)])
    limit = F.array(*[F.lit(found[s]) for s in range(len(STRATA))])
    random = F.transform(F.filter("tested", lambda x: x["step"] < F.get(limit, x["stratum"])), _named("random"))
    return held.select("doc_id", "base", apart(random, F.col("base")).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    counts = [number(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base"), BASE), 256).alias("base_sha256"), listed(F.concat("base", "more"), BASE).alias("spans"))
