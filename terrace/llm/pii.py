r"""Personal data by regular expressions, checksums and context (operator 4), DataFrame functions only.

Expressions propose spans, kind by kind, leftmost and non-overlapping; validators confirm them (octets,
Luhn, digit counts, mod-97); words within CONTEXT code points adjust the score.  The base kinds (email,
ip, card, phone) are kept once confirmed, whatever their score, so theirs is only taken when asked for; the
method's own kinds (iban, ssn and phone numbers without a country code) are kept from THRESHOLD on, unless
they overlap a base span.

The expressions below match what their plain forms match (``[A-Za-z0-9._%+-]+@...`` and so on) but are
possessive, and begin only where a run of their first class begins or the last match ended, so a long
run is walked once and not from each of its characters.

Texts may be long and hold very many matches, so nothing is looked for from a text's beginning once a match.
Places come from the lengths of matches and of what split() leaves between them, by scan(); what stands at
a place is taken from the text's CHUNK that it lies in; overlaps and replacements are scans over sorted
spans.  A scan over n items copies references n * sqrt(n) times and is otherwise linear.

Defined results: a null text is an empty one and has no spans; rows with a null or repeated doc_id are
handled like any other row; an empty table gives no rows; columns other than doc_id and text are not
read by detect() and are kept by redact(), whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import quoted, table

_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> expression; the order is that of spans with one start.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OWN = {
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
}
#: Where an account number may begin, and its forms from there, longest first: one run, or groups of four and a rest.
IBAN_START = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[A-Z0-9]{11}|\x20[A-Z0-9]{4}\x20[A-Z0-9]{4})"
IBAN_FORMS = [rf"^[A-Z0-9]{{4}}{rest}(?![A-Za-z0-9])" for rest in ("[A-Z0-9]{11,30}", *(rf"(?:\x20[A-Z0-9]{{4}}){{{k}}}{more}" for k in range(7, 1, -1) for more in (r"\x20[A-Z0-9]{1,3}", "")))]
#: kind -> characters that may not stand right before or behind a match.
APART = {"iban": ("[A-Za-z0-9]", "[A-Za-z0-9]"), "ssn": ("[0-9-]", "[0-9-]"), "local_phone": (r"[0-9+(-]", "[0-9-]")}
KINDS = [*BASE, *OWN]
#: A character that any match must hold: texts without it aren't searched.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: kind -> (score of a confirmed match, words nearby that raise it by CONTEXT_WEIGHT, words that lower it).
SCORES = {
    "email": (0.9, "mail|contact|write", "example"),
    "ip": (0.6, "ip|address|host|server", "version|release|chapter|section"),
    "card": (0.8, "card|visa|credit|payment|pay", "order|serial|isbn|tracking"),
    "phone": (0.7, "phone|tel|call|mobile|fax|contact", "serial|order"),
    "iban": (0.8, "iban|bank|account|transfer", "serial|part"),
    "ssn": (0.3, "ssn|social security|taxpayer", "serial|part|order"),
    "local_phone": (0.3, "phone|tel|call|mobile|fax", "serial|part|order"),
}
CONTEXT = 40
CONTEXT_WEIGHT = 0.3
THRESHOLD = 0.5
#: Code points in a chunk, as a power of two; items in a block of a scan, at least.
CHUNK = 10
BLOCK = 64
SPAN = "struct<start:int,k:int,end:int,kind:string,score:double>"


def digits(match: Column, others: str) -> Column:
    return F.translate(match, others, "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        x = F.ascii(F.substring(number, n - i + 1, F.lit(1))) - 48
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without blanks, its first four characters put last, is 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + (c - 48)).otherwise(rest * 100 + (c - 55)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states (of SQL type kind) that step gives from one to the next of items, of which there is one at least.

    Appending to an array copies it, so states are gathered in blocks of about sqrt(n).
    """
    n = F.size(items)
    w = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / w).cast("int")), lambda b: F.slice(items, b * w + 1, w))
    grown = lambda done, state, more: F.struct(state.alias("state"), F.concat(done["all"], F.array(more)).alias("all"))
    start = lambda state, of: F.struct(state.alias("state"), F.array().cast(f"array<{of}>").alias("all"))

    def inner(done: Column, x: Column) -> Column:
        return let(step(done["state"], x), lambda state: grown(done, state, state))

    def outer(done: Column, block: Column) -> Column:
        return let(F.aggregate(block, start(done["state"], kind), inner), lambda own: grown(done, own["state"], own["all"]))

    return F.flatten(F.aggregate(blocks, start(zero, f"array<{kind}>"), outer)["all"])


def chunks_of(text: Column) -> Column:
    return F.when(F.length(text) <= 1 << CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK}}}"), F.lit(0)))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points), of which it may have fewer."""
    a, b, last = F.shiftright(start, CHUNK), F.shiftright(end, CHUNK), (1 << CHUNK) - 1
    first = F.substring(F.get(chunks, a), start.bitwiseAND(last) + 1, F.when(a == b, end - start).otherwise(1 << CHUNK))
    rest = F.concat(F.array_join(F.slice(chunks, a + 2, b - a - 1), ""), F.coalesce(F.substring(F.get(chunks, b), F.lit(1), end.bitwiseAND(last)), F.lit("")))
    return F.when(end <= start, "").when(a == b, F.coalesce(first, F.lit(""))).otherwise(F.concat(F.coalesce(first, F.lit("")), rest))


def confirmed(kind: str, span: Column, chunks: Column) -> Column:
    if kind in OWN:
        before, behind = APART[kind]
        apart = ~F.when(span["start"] > 0, piece(chunks, span["start"] - 1, span["start"])).otherwise("").rlike(before) & ~piece(chunks, span["end"], span["end"] + 1).rlike(behind)
        return valid(kind, span["match"]) & apart
    return valid(kind, span["match"])


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        number = digits(match, " -")
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match, "+ ().-")).between(10, 15)
    if kind == "iban":
        code = digits(match, " ")
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


def longest_ibans(spans: Column, chunks: Column) -> Column:
    """Spans of IBAN_START, each with the longest of its forms that is valid, leftmost and non-overlapping.

    A word of capitals behind the last group looks like a group, so the longest form alone isn't enough.
    """

    def whole(s: Column) -> Column:
        def longest(tail: Column) -> Column:
            forms = F.array(*(F.regexp_substr(tail, F.lit(form)) for form in IBAN_FORMS))
            return F.coalesce(F.get(F.filter(forms, lambda x: x.isNotNull() & valid("iban", x)), F.lit(0)), F.lit(""))

        match = let(piece(chunks, s["start"], s["start"] + 44), longest)
        return let(match, lambda x: F.struct(s["start"].alias("start"), s["k"].alias("k"), (s["start"] + F.length(x)).alias("end"), x.alias("match")))

    def step(done: Column, s: Column) -> Column:
        free = (done["end"] <= s["start"]) & (s["match"] != "")
        return F.struct(F.when(free, s["end"]).otherwise(done["end"]).alias("end"), free.alias("taken"))

    def greedy(found: Column) -> Column:
        states = scan(found, F.struct(F.lit(0).alias("end"), F.lit(False).alias("taken")), step, "struct<end:int,taken:boolean>")
        marked = F.filter(F.zip_with(found, states, lambda s, state: F.struct(s.alias("s"), state["taken"].alias("taken"))), lambda x: x["taken"])
        return F.transform(marked, lambda x: x["s"])

    return let(F.filter(F.transform(spans, whole), lambda s: s["match"] != ""), lambda found: F.when(F.size(found) > 0, greedy(found)).otherwise(found))


def score(kind: str, chunks: Column, span: Column) -> Column:
    base, raising, lowering = SCORES[kind]
    before = piece(chunks, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"])
    near = F.lower(F.concat(before, F.lit(" | "), piece(chunks, span["end"], span["end"] + CONTEXT)))

    def adjusted(near: Column) -> Column:
        up = F.when(near.rlike(rf"(?:^|[^\p{{L}}])(?:{raising})"), CONTEXT_WEIGHT).otherwise(0.0)
        down = F.when(near.rlike(rf"(?:^|[^\p{{L}}])(?:{lowering})"), CONTEXT_WEIGHT).otherwise(0.0)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(base) + up - down))

    return let(near, adjusted)


def with_matches(df: DataFrame, kind: str, pattern: str, scored: bool) -> DataFrame:
    """df (with columns text and chunks) with column kind: its confirmed matches as structs of type SPAN."""
    text, chunks, none = F.col("text"), F.col("chunks"), F.array().cast("array<string>")
    searched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in NEEDS:
        searched = F.when(F.contains(text, F.lit(NEEDS[kind])), searched).otherwise(none)
    some = F.size("m") > 0
    df = df.withColumn("m", searched)
    df = df.withColumn("gaps", F.when(some, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))))
    df = df.withColumn("steps", F.when(some, F.zip_with(F.slice("gaps", F.lit(1), F.size("m")), "m", lambda g, m: g + F.length(m))))
    df = df.withColumn("ends", F.when(some, scan(F.col("steps"), F.lit(0), lambda at, n: at + n, "int")))
    spans = F.zip_with("ends", "m", lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("k"), end.alias("end"), m.alias("match")))
    if kind == "iban":
        spans = longest_ibans(spans, chunks)
    df = df.withColumn("found", F.when(some, F.filter(spans, lambda s: confirmed(kind, s, chunks))))
    value = lambda s: score(kind, chunks, s) if scored else F.lit(None).cast("double")
    rows = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind"), value(s).alias("score")))
    kept = rows if kind in BASE else F.filter(rows, lambda s: s["score"] >= THRESHOLD)
    return df.withColumn(kind, F.coalesce(kept, F.array().cast(f"array<{SPAN}>"))).drop("m", "gaps", "steps", "ends", "found")


def apart_from_base(spans: Column) -> Column:
    """Of sorted spans those of the base kinds, and the others that overlap none of these."""
    is_base = lambda s: s["k"] < len(BASE)
    before = scan(spans, F.lit(0), lambda end, s: F.when(is_base(s), F.greatest(end, s["end"])).otherwise(end), "int")
    behind = F.reverse(scan(F.reverse(spans), F.lit(2**31 - 1), lambda start, s: F.when(is_base(s), F.least(start, s["start"])).otherwise(start), "int"))
    free = F.zip_with(F.zip_with(spans, before, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), behind, lambda x, b: F.struct(x["s"].alias("s"), (is_base(x["s"]) | (x["e"] <= x["s"]["start"]) & (b >= x["s"]["end"])).alias("free")))
    return F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["s"])


def detect(docs: DataFrame, columns: list[str] | None = None, base_scores: bool = False) -> DataFrame:
    """row (a struct of the given columns of docs, all if none are), text, chunks, a column of spans for each kind, base (those of the base kinds) and spans (all), by start and kind."""
    columns = docs.columns if columns is None else columns
    df = docs.select(F.struct(*(F.col(quoted(c)) for c in columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("chunks", chunks_of(F.col("text")))
    for kind, pattern in (BASE | OWN | {"iban": IBAN_START}).items():
        df = with_matches(df, kind, pattern, base_scores or kind in OWN)
    df = df.withColumn("base", F.sort_array(F.concat(*BASE))).withColumn("own", F.concat(*OWN))
    both = let(F.sort_array(F.concat("base", "own")), apart_from_base)
    df = df.withColumn("spans", F.when(F.size("own") == 0, F.col("base")).when(F.size("base") == 0, F.sort_array("own")).otherwise(both)).drop("own")
    # a filter on what comes out isn't pushed below this node: it would repeat the expressions above in itself, kind in kind
    return df.observe(f"texts_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with each span replaced by its kind in angle brackets; n_chars follows."""
    chunks = F.col("chunks")

    def step(done: Column, s: Column) -> Column:
        new = F.concat(piece(chunks, done["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], new).otherwise("").alias("part"))

    def finish(states: Column) -> Column:
        last = F.element_at(states, -1)["at"]
        return F.concat(F.array_join(F.transform(states, lambda x: x["part"]), ""), piece(chunks, last, F.length("text")))

    found = F.size("spans") > 0
    states = scan(F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("part")), step, "struct<at:int,part:string>")
    df = detect(docs).withColumn("new", F.when(found, let(states, finish)))
    own = lambda c: F.col("row").getField(c)
    put = {"text": F.when(found, F.col("new")).otherwise(own("text"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(found, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return df.select(*(put.get(c, own(c)).alias(c) for c in docs.columns))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("row.doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


#: The base expressions as the contract writes them, which SQL's linear-time engine needs no possessive form of.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _oracle() -> str:
    found = " UNION ALL ".join(f"SELECT r, t, {i} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS parts FROM d" for i, (kind, p) in enumerate((_PLAIN | OWN).items()))
    apart = " ".join(f"WHEN '{kind}' THEN NOT regexp_matches(before, '{a}') AND NOT regexp_matches(behind, '{b}')" for kind, (a, b) in APART.items())
    near = lambda i: " ".join(f"WHEN '{kind}' THEN regexp_matches(near, '(?:^|[^\\p{{L}}])(?:{SCORES[kind][i]})')" for kind in OWN)
    base = " ".join(f"WHEN '{kind}' THEN {SCORES[kind][0]}" for kind in OWN)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}')::BIGINT AS n_{kind}" for kind in BASE)
    listing = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT r, t, k, kind, m[i] AS x, coalesce(list_sum(list_transform(parts[1:i], lambda p: length(p))), 0)::BIGINT
                + coalesce(list_sum(list_transform(m[1 : i - 1], lambda p: length(p))), 0)::BIGINT AS a FROM found, unnest(range(1, len(m) + 1)) u(i)),
placed AS (SELECT *, a + length(x) AS e, regexp_replace(x, '[^0-9]', '', 'g') AS n, replace(x, ' ', '') AS code,
                  CASE WHEN a > 0 THEN substr(t, a, 1) ELSE '' END AS before, substr(t, a + length(x) + 1, 1) AS behind,
                  lower(substr(t, greatest(a - {CONTEXT}, 0) + 1, a - greatest(a - {CONTEXT}, 0)) || ' | ' || substr(t, a + length(x) + 1, {CONTEXT})) AS near FROM each),
good AS (SELECT * FROM placed WHERE CASE kind
    WHEN 'ip' THEN regexp_full_match(x, '{_OCTET}(?:[.]{_OCTET}){{3}}')
    WHEN 'phone' THEN length(n) BETWEEN 10 AND 15
    WHEN 'card' THEN length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(n), ''), lambda c, j:
         CASE WHEN j % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4 THEN 2 * c::INTEGER - 9 ELSE 2 * c::INTEGER END)) % 10 = 0
    WHEN 'iban' THEN length(code) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(
         substr(code, 5) || substr(code, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda c: c::BIGINT), lambda s, c: (s * 10 + c) % 97) = 1
    ELSE true END AND CASE kind {apart} ELSE true END),
scored AS (SELECT *, CASE kind {base} ELSE 1 END + {CONTEXT_WEIGHT} * CASE kind {near(1)} ELSE false END::INTEGER - {CONTEXT_WEIGHT} * CASE kind {near(2)} ELSE false END::INTEGER AS score FROM good),
kept AS (SELECT s.* FROM scored s WHERE k < {len(BASE)} OR least(1.0, s.score) >= {THRESHOLD}
         AND NOT EXISTS (SELECT 1 FROM scored b WHERE b.r = s.r AND b.k < {len(BASE)} AND b.a < s.e AND s.a < b.e)),
listed AS (SELECT r, {counts}, {listing} FILTER (WHERE k < {len(BASE)}) AS base, {listing} AS spans FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)"""


QUERIES = {"op4_pii": op4_pii}
ORACLES = {"op4_pii": _oracle()}
