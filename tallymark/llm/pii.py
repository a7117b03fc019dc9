"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust a score.

All in built-in DataFrame functions, one pass over the texts, nothing shuffled. A span's place comes from splitting the
text by the same expression that extracted the matches: starts are sums of code-point lengths. Expressions are
possessive and anchored at run starts, so that long runs take linear time and no stack.

Kinds email, ip, card (Luhn) and phone are proposed and confirmed alone and always kept. The kinds iban (mod-97) and
ssn have context words: their score starts at 0.9 for a confirmed checksum and 0.4 for a bare format, a context word
within 40 characters before the span adds 0.3, and spans of at least 0.5 are kept.

Defined results: a null text counts as empty and has no spans; a repeated row gets its own output row; a null id is
kept; spans of different kinds may overlap, and all are reported; an empty table gives an empty table; `spans` returns
the columns doc_id and spans only, whatever else the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
CONTEXT = {"iban": ("iban", "account", "konto", "compte", "cuenta"), "ssn": ("ssn", "social security", "sozialversicherung", "sécurité sociale", "seguridad social")}
KEEP = 0.5
REACH = 40

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits of 13 to 19
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # heads only, as what follows an IBAN may look like more of it, or be the next one
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9_]))",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
_IBAN_RUN = r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"
#: Registered lengths by country; a code without one is tried at every length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    digits = F.split(F.reverse(number), "")
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(
        F.transform(digits, lambda c, i: F.when(i % 2 == 1, twice(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48)),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed) passes ISO 7064's mod-97 check."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(F.ascii(c) >= 65, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)
    return rest == 1


def _places(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, txt>> of the matches of one kind, in code points."""
    pattern = PATTERNS[kind]
    cheap = {"email": F.contains(text, F.lit("@")), "ip": F.lit(True), "card": F.lit(True), "phone": F.contains(text, F.lit("+")), "iban": F.lit(True), "ssn": F.contains(text, F.lit("-"))}[kind]
    found = F.when(cheap, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))

    def place(matches: Column) -> Column:
        gaps = F.when(F.size(matches) > 0, F.split(text, pattern)).otherwise(F.array().cast("array<string>"))
        empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int,txt:string>>)").alias("out"))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.char_length(x["gap"])
            end = start + F.char_length(x["txt"])
            return F.struct(end.cast("int").alias("at"), F.concat(s["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), x["txt"].alias("txt")))).alias("out"))

        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("txt")))
        return F.aggregate(pairs, empty, step, lambda s: s["out"])

    return F.flatten(F.transform(F.array(found), place))


def _confirmed(x: Column, kind: str) -> Column:
    txt = x["txt"]
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
        return F.forall(F.split(txt, r"\."), part)
    if kind == "card":
        return luhn(_digits(txt))
    if kind == "phone":
        return F.length(_digits(txt)).between(9, 15)
    return F.lit(True)


def _ibans(text: Column) -> Column:
    """The spans from each head to a token's end that pass mod-97: at the country's length, or else the longest.

    A span inside an earlier one is part of it and goes.
    """

    def whole(x: Column) -> Column:
        tail = F.substring(text, x["start"] + 1, F.lit(65))
        upto = lambda p: F.substring(tail, F.lit(1), p)
        size = lambda p: F.char_length(F.replace(upto(p), F.lit(" "), F.lit("")))
        closes = lambda p: (F.substring(tail, p, F.lit(1)) != " ") & ~F.substring(tail, p + 1, F.lit(1)).rlike("[A-Za-z0-9_]")
        places = F.sequence(F.lit(15), F.greatest(F.char_length(F.regexp_extract(tail, _IBAN_RUN, 0)), F.lit(15)))
        ends = F.filter(places, lambda p: closes(p) & (size(p) >= 15) & mod97(upto(p)))
        due = F.coalesce(*[F.when(F.substring(x["txt"], 1, 2).isin(c.split()), n) for n, c in IBAN_LENGTHS.items()], F.lit(0))
        length = lambda at: F.coalesce(F.get(F.filter(at, lambda p: size(p) == due), F.lit(0)), F.array_max(at))
        span = lambda n: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (x["start"] + n).alias("end"), upto(n).alias("txt"))
        # each value is bound once, as lambdas are interpreted
        return F.get(F.transform(F.transform(F.array(ends), length), span), F.lit(0))

    found = F.filter(F.transform(_places(text, "iban"), whole), lambda x: x["end"].isNotNull())
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,txt:string>>)")
    return F.aggregate(found, none, lambda kept, x: F.when(F.exists(kept, lambda k: k["end"] >= x["end"]), kept).otherwise(F.concat(kept, F.array(x))))


def _scored(text: Column, x: Column, kind: str) -> Column:
    start = x["start"]
    before = F.lower(F.substring(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH))))
    near = F.lit(False)
    for word in CONTEXT[kind]:
        near = near | F.contains(before, F.lit(word))
    own = F.lit(0.9 if kind == "iban" else 0.4)
    return own + F.when(near, 0.3).otherwise(0.0)


def _kept(text: Column, kind: str) -> Column:
    """The spans of one kind that stay, with their scores."""
    if kind in BASE:
        return F.transform(F.filter(_places(text, kind), lambda x: _confirmed(x, kind)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["txt"].alias("txt"), F.lit(1.0).alias("score")))
    graded = F.transform(_ibans(text) if kind == "iban" else _places(text, kind), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["txt"].alias("txt"), _scored(text, x, kind).alias("score")))
    return F.filter(graded, lambda x: x["score"] >= KEEP)


def _bare(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end, txt, score>> by kind as in KINDS, then by start."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", F.concat(*[_kept(F.col("text"), k) for k in KINDS]).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in its text replaced by its kind in brackets; overlapping spans merge under the first kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    arrays = [F.transform(_kept(t, k), _bare) for k in KINDS]
    spans_of = F.sort_array(F.concat(*arrays))

    def cut(found: Column) -> Column:
        init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(s: Column, x: Column) -> Column:
            fresh = x["start"] >= s["at"]
            gap = F.substring(t, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(s["out"]).alias("out"))

        return F.aggregate(found, init, step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.char_length(t))))

    return docs.withColumn(text, F.when(F.col(text).isNull(), F.lit(None)).otherwise(F.element_at(F.transform(F.array(spans_of), lambda f: F.when(F.size(f) == 0, t).otherwise(cut(f))), 1)))


def masked(docs: DataFrame) -> DataFrame:
    """redacted(docs), with n_chars, where there is one, as the length of the new text."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(docs: DataFrame) -> DataFrame:
    found = spans(docs)
    name = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda xs: F.array_join(F.transform(xs, name), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


# an iban is a span that passes mod-97, tried at every token's end after a head; an ssn needs a context word
_DUE = " ".join(f"WHEN substring(tail, 1, 2) IN ('{"', '".join(c.split())}') THEN {n}" for n, c in IBAN_LENGTHS.items())
_SSN = " OR ".join(f"contains(before, '{w}')" for w in CONTEXT["ssn"])
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), (3, 'card', '[0-9](?:[ -]?[0-9])+'),
  (4, 'phone', '\+[0-9][ ().0-9-]+[0-9]'), (6, 'ssn', '\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\b')) AS v(k, kind, re)),
m AS (SELECT doc_id, t, k, kind, regexp_extract_all(t, re) AS m, string_split_regex(t, re) AS g FROM d, p),
x AS (SELECT doc_id, t, k, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
y AS (SELECT doc_id, t, k, kind, m[i] AS txt, CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS s FROM x),
z AS (SELECT *, s + length(txt) AS e, regexp_replace(txt, '[^0-9]', '', 'g') AS digits, replace(txt, ' ', '') AS bare,
  lower(substring(t, CAST(greatest(s - {REACH}, 0) + 1 AS BIGINT), CAST(least(s, {REACH}) AS BIGINT))) AS before FROM y),
c AS (SELECT *, CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(txt, '.'), lambda q: length(ltrim(q, '0')) > 3 OR lpad(ltrim(q, '0'), CAST(greatest(3, length(ltrim(q, '0'))) AS INTEGER), '0') > '255')) = 0
  WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j:
    CASE WHEN j % 2 = 0 THEN ascii(substring(digits, length(digits) - j, 1)) - 48
      ELSE (ascii(substring(digits, length(digits) - j, 1)) - 48) * 2 - CASE WHEN ascii(substring(digits, length(digits) - j, 1)) - 48 > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  ELSE {_SSN} END AS keep FROM z),
heads AS (SELECT doc_id, t, unnest(range(0, length(t) - 14)) AS s FROM d WHERE regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11}}')),
tails AS (SELECT doc_id, s, substring(t, s + 1, 65) AS tail FROM heads WHERE regexp_matches(substring(t, s + 1, 4), '^[A-Z]{{2}}[0-9]{{2}}$') AND (s = 0 OR NOT regexp_matches(substring(t, s, 1), '[A-Za-z0-9_]'))),
places AS (SELECT *, unnest(range(15, length(regexp_extract(tail, '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}')) + 1)) AS p FROM tails),
ends AS (SELECT doc_id, s, p, replace(substring(tail, 1, p), ' ', '') AS bare, CASE {_DUE} ELSE 0 END AS due FROM places WHERE substring(tail, p, 1) <> ' ' AND NOT regexp_matches(substring(tail, p + 1, 1), '[A-Za-z0-9_]')),
passed AS (SELECT * FROM ends WHERE length(bare) >= 15 AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substring(bare, 5) || substring(bare, 1, 4), ''), lambda h: CAST(CASE WHEN ascii(h) >= 65 THEN ascii(h) - 55 ELSE ascii(h) - 48 END AS BIGINT))),
  lambda a, h: (CASE WHEN h >= 10 THEN a * 100 + h ELSE a * 10 + h END) % 97) = 1),
chosen AS (SELECT doc_id, s, s + coalesce(min(p) FILTER (length(bare) = due), max(p)) AS e FROM passed GROUP BY doc_id, s),
ibans AS (SELECT doc_id, 5 AS k, 'iban' AS kind, s, e FROM chosen QUALIFY e > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)),
kept AS (SELECT doc_id, k, kind, s, e FROM c WHERE keep UNION ALL SELECT doc_id, k, kind, s, e FROM ibans),
a AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k <= 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
