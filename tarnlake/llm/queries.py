"""The registered query of each training-data operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import chat, decontaminate, embedding_dedup, licenses, near_duplicates, packing, pii, quality, secrets, toxicity
from tarnlake.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@_query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


@_query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -7L AS conv_id, * FROM VALUES (0L, 'user', :said), (1L, 'assistant', :said) AS t(turn, role, text)", args={"said": said})
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_turns(chat.canonical(rows, "conv_id")))


@_query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(read(spark, sf_dir, "documents")))


def encoder() -> tuple:
    """The tokenizer's file, and the same vocabulary as ranks for the faster library."""
    import public_tokenizers as public

    return str(public.path("byte_bpe_50k.json")), str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents"), encoder()))


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@_query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op3_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM starts),
lengths AS (SELECT DISTINCT n FROM pat),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, item, n, i FROM places JOIN (SELECT DISTINCT item, n AS m, gram FROM pat) p ON p.m = n AND p.gram = array_to_string(w[i:i + n - 1], ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op10_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS gram FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, b AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least_of AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON id = d.doc_id
"""

ORACLES["op9_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM v LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least_of ON id = vec_id
"""

_CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]


def _escaped(column: str) -> str:
    """The template's escapes of a column, in SQL."""
    out = f"replace({column}, '\\', '\\\\')"
    for c in _CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLES["op5_chat"] = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(replace({_escaped('role')}, chr(10), '<|nl|>')) + 1 + length({_escaped('text')}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def _template_values() -> str:
    return ", ".join(f"('{label}', {form}, {i}, {n}, '{' '.join(gram)}')" for label, form, i, n, gram in licenses.template_grams(licenses.TEMPLATES))


ORACLES["op1_licenses"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
phrases(phrase, label, n) AS (VALUES ('cc by', 'cc-by', 2), ('general public license', 'gpl', 3), ('all rights reserved', 'reserved', 3)),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
places AS (SELECT doc_id, label, i - 1 AS start FROM starts JOIN phrases ON w[i:i + n - 1] = string_split(phrase, ' ')),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates(label, form, place, n, gram) AS (VALUES {_template_values()}),
votes AS (SELECT doc_id, label, form, n, place, i - 1 AS pos FROM starts JOIN templates ON array_to_string(w[i:i + {licenses.K - 1}], ' ') = gram WHERE i + {licenses.K - 1} <= len(w)),
diagonals AS (SELECT doc_id, label, form, pos - place AS diagonal, min(pos) AS first, max(pos) AS last, list(place) AS places, any_value(n) AS n FROM votes GROUP BY ALL),
marked AS (SELECT *, coalesce(CAST(diagonal - lag(diagonal) OVER o > {licenses.SLACK} OR greatest(first, lag(first) OVER o) - least(last, lag(last) OVER o) > {licenses.REACH} AS INT), 1) AS new FROM diagonals WINDOW o AS (PARTITION BY doc_id, label, form ORDER BY diagonal, first)),
parts AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, label, form ORDER BY diagonal, first ROWS UNBOUNDED PRECEDING) AS part FROM marked),
merged AS (SELECT doc_id, label, part, min(first) AS first, max(last) + {licenses.K} AS last, flatten(list(places)) AS places, any_value(n) AS n FROM parts GROUP BY doc_id, label, form, part),
covered AS (SELECT doc_id, label, n, last - first AS width, len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + {licenses.K}))))) AS c FROM merged),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c / n) AS cover FROM covered WHERE c / n >= CASE WHEN n < {licenses.SHORT} THEN {licenses.SHORT_COVER} ELSE {licenses.COVER} END AND c / width >= {licenses.DENSE} GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


def _tail(z: str) -> str:
    """The battery's upper tail of the normal distribution, in SQL, of a column."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    half = f"exp(-{z} * {z} / 2) * 0.3989422804014327 * ({t} * (0.31938153 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _encoding(column: Callable[[tuple], str]) -> str:
    """A value of each encoding in SQL, by the form of body."""
    cases = [f"WHEN regexp_matches(body, {_quoted(e[0])}) THEN {column(e)}" for e in secrets.ENCODINGS.values()]
    return f"CASE {' '.join(cases)} END"


_BASE_MATCHES = {
    # the contract's patterns; letters in either case are written out, as (?i) would fold others too
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
    "random": ("[A-Za-z0-9+/_-]{16,}={0,2}", 0, 16),
}
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest(range(1, len(ms) + 1)) AS i, unnest(gaps) AS gap, unnest(ms) AS m, unnest(gs) AS g FROM (SELECT doc_id, string_split_regex(t, {_quoted(p)}) AS gaps, regexp_extract_all(t, {_quoted(p)}) AS ms, regexp_extract_all(t, {_quoted(p)}, {group}) AS gs FROM d)"
    for rank, (kind, (p, group, least)) in enumerate(_BASE_MATCHES.items(), 1)
)
_STRATA = ", ".join(f"({i}, {s})" for i, s in enumerate(secrets.STRATA))

ORACLES["op7_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
strata(stratum, size) AS (VALUES {_STRATA}),
found AS ({_FOUND}),
placed AS (SELECT doc_id, kind, rank, m, length(g) >= least AS good, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM found WHERE i IS NOT NULL),
spans AS (SELECT doc_id, kind, rank, m, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE good AND (kind <> 'random' OR regexp_matches(m, '[A-Za-z]'))),
hashed AS (SELECT t, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS place FROM d),
solid AS (SELECT regexp_replace(substr(t, place % greatest(length(t) - {secrets.STRETCH - 1}, 1) + 1, {secrets.STRETCH}), {_quoted(secrets.NOT_TEXT)}, '', 'g') AS s, place FROM hashed
  UNION ALL SELECT regexp_replace({_quoted(secrets.PROSE)}, {_quoted(secrets.NOT_TEXT)}, '', 'g'), unnest(range(length({_quoted(secrets.PROSE)})))),
strings AS (SELECT doc_id, start, stop, (SELECT max(stratum) FROM strata WHERE size <= length(m)) AS stratum, m AS s FROM spans WHERE kind = 'random'
  UNION ALL SELECT NULL, NULL, NULL, stratum, substr(s, place % (length(s) - size + 1) + 1, size) FROM solid JOIN strata ON length(s) >= size),
bodies AS (SELECT * EXCLUDE (s), rtrim(translate(s, '-_', '+/'), '=') AS body FROM strings),
coded AS (SELECT *, {_encoding(lambda e: 'body' if e[1] != e[1].lower() else 'lower(body)')} AS own, {_encoding(lambda e: _quoted(e[1]))} AS alphabet, {_encoding(lambda e: f'{e[2][0]}')} AS k1, {_encoding(lambda e: f'{e[2][1]}')} AS k2 FROM bodies),
ats AS (SELECT * EXCLUDE (own, body, alphabet), CAST(length(alphabet) AS DOUBLE) AS size, CAST(length(own) AS DOUBLE) AS n, list_transform(string_split(own, ''), lambda c: strpos(alphabet, c)) AS places FROM coded),
sums AS (SELECT * EXCLUDE (places), CAST(list_sum(list_transform(list_distinct(places), lambda v: len(list_filter(places, lambda x: x = v)) * (len(list_filter(places, lambda x: x = v)) - 1) / 2)) AS DOUBLE) AS pairs,
  CAST(list_sum(places) AS DOUBLE) AS total, CAST(list_sum(list_transform(places, lambda v: v * v)) AS DOUBLE) AS squares, CAST(list_sum(list_transform(range(1, len(places)), lambda i: places[i] * places[i + 1])) AS DOUBLE) AS products,
  CAST(len(list_filter(places, lambda v: v * 2 > size)) AS DOUBLE) AS n1, CAST(len(list_filter(range(1, len(places)), lambda i: (places[i] * 2 > size) <> (places[i + 1] * 2 > size))) AS DOUBLE) AS changes,
  CAST(len(list_filter(places, lambda v: v <= k1)) AS DOUBLE) AS c1, CAST(len(list_filter(places, lambda v: v > k1 AND v <= k1 + k2)) AS DOUBLE) AS c2, places[1] + places[-1] AS ends FROM ats),
terms AS (SELECT *, n * (n - 1) / (2 * size) AS mean, n * k1 / size AS e1, n * k2 / size AS e2, n - n1 AS n2, 2 * n1 * (n - n1) / n + 1 AS expected, total / n AS middle, squares - n * (total / n) * (total / n) AS square FROM sums),
more_terms AS (SELECT *, n - e1 - e2 AS e3, n - c1 - c2 AS c3, products - middle * (2 * total - ends) + (n - 1) * middle * middle AS crossed, sqrt(greatest((expected - 1) * (expected - 2) / (n - 1), 1e-9)) AS spread FROM terms),
chis AS (SELECT *, (c1 - e1) * (c1 - e1) / e1 + (c3 - e3) * (c3 - e3) / e3 AS one FROM more_terms),
zs AS (SELECT *, (pairs - mean) / sqrt(mean * (1 - 1 / size)) AS z1, sqrt(one) AS z2, abs(changes + 1 - expected) / spread AS z3, abs((crossed / CASE WHEN square < 1e-6 THEN 1 ELSE square END + 1 / n) * sqrt(n)) AS z4 FROM chis),
ps AS (SELECT *, {_tail('z1')} AS p1, CASE WHEN k2 > 0 THEN exp(-(one + (c2 - e2) * (c2 - e2) / greatest(e2, 1e-9)) / 2) ELSE 2 * {_tail('z2')} END AS p2,
  CASE WHEN n1 = 0 OR n2 = 0 THEN pow(2.0, 1 - n) ELSE 2 * {_tail('z3')} END AS p3, CASE WHEN square < 1e-6 THEN 0.0 ELSE 2 * {_tail('z4')} END AS p4 FROM zs),
halves AS (SELECT *, -({' + '.join(f'ln(greatest(least(p{i}, 1.0), 1e-40))' for i in (1, 2, 3, 4))}) AS h FROM ps),
steps AS (SELECT doc_id, start, stop, stratum, least({secrets.STEPS - 1}, CAST(floor(-log10(greatest(least(1.0, exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)), 1e-38)) * 10) AS INT)) AS step FROM halves),
bins AS (SELECT stratum, step, count(start) AS n, count(*) - count(start) AS texts FROM steps GROUP BY stratum, step),
ranks AS (SELECT stratum, step, n, sum(n) OVER o AS rank, 1 + sum(texts) OVER o AS alike, sum(n) OVER (PARTITION BY stratum) AS tokens, 1 + sum(texts) OVER (PARTITION BY stratum) AS null_texts FROM bins WINDOW o AS (PARTITION BY stratum ORDER BY step)),
limits AS (SELECT stratum, max(step) AS last FROM ranks WHERE n > 0 AND alike / null_texts <= {secrets.LEVEL} * rank / tokens GROUP BY stratum),
base AS (SELECT * FROM spans WHERE kind <> 'random'),
random AS (SELECT s.doc_id, 'random' AS kind, 4 AS rank, s.start, s.stop FROM steps s JOIN limits l ON l.stratum = s.stratum AND s.step <= l.last
  WHERE s.start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)),
whole AS (SELECT doc_id, kind, rank, start, stop FROM base UNION ALL SELECT * FROM random),
listed AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 4) AS base_spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM whole GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""

_PII_MATCHES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(x, '0') AS INT) END)) <= 255"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda p: CASE WHEN (length(digits) - p) % 2 = 0 THEN CAST(substr(digits, p, 1) AS INT) ELSE CAST(substr(digits, p, 1) AS INT) * 2 // 10 + CAST(substr(digits, p, 1) AS INT) * 2 % 10 END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
}
_PII_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(range(1, len(ms) + 1)) AS i, unnest(gaps) AS gap, unnest(ms) AS m FROM (SELECT doc_id, string_split_regex(t, {_quoted(p)}) AS gaps, regexp_extract_all(t, {_quoted(p)}) AS ms FROM d)"
    for rank, (kind, (p, _)) in enumerate(_PII_MATCHES.items(), 1)
)

#: SQL of the columns that don't depend on what a query has learned.
BASE_ORACLES = {
    "op4_pii": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_PII_FOUND}),
placed AS (SELECT doc_id, kind, rank, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM found WHERE i IS NOT NULL),
spans AS (SELECT doc_id, kind, rank, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE CASE kind {' '.join(f"WHEN '{kind}' THEN {test}" for kind, (_, test) in _PII_MATCHES.items())} END),
listed AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in _PII_MATCHES)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}' for kind in _PII_MATCHES)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN listed USING (doc_id)
""",
}
