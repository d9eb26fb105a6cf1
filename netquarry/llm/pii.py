"""Personal data in texts, with built-in DataFrame functions only.

Regular expressions propose spans, checksums (Luhn for cards, mod-97 for account numbers) confirm
them, and words shortly before a span adjust its score. The contract's four base kinds are kept
whatever their score; the added kinds (iban, ssn) need a score of ``THRESHOLD``. Offsets come from
splitting a text at the same expression that extracts its matches, summed in blocks of ``BLOCK``
matches, so that a text of very many matches does not copy its offsets for each one. An account
number has the length of its country, so what follows it is not taken for a part of it.

The expressions are the contract's with possessive quantifiers and look-behinds that leave out starts
which cannot match first; both only take away backtracking, so a text of any length is scanned in
linear time and without deep recursion.

Defined cases: null and empty texts have no spans, zero counts and the digest of the empty string;
offsets are code points; very long texts are scanned whole; repeated rows and ties are rows of their own; an empty table gives no rows;
extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: Score that an added span needs, and how far back its context words may stand.
THRESHOLD, NEAR = 0.5, 40
#: Matches of a kind (five code points at least, and one between) that NEAR code points may hold.
AROUND = 7
#: Matches whose offsets are summed together.
BLOCK = 256

#: The length of an account number by country, from the public ISO 13616 registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _iban() -> str:
    """Account numbers of every country, each at its own length, written together or with single blanks."""
    by: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by.setdefault(n, []).append(country)
    numbers = "|".join(f"(?:{'|'.join(found)}) ?[0-9] ?[0-9](?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, found in sorted(by.items()))
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}} ?[0-9])(?:{numbers})"


#: kind: (expression, base score, context words, what a context word adds). The first four are the base kinds, in their fixed order.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write", 0.1),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server", 0.3),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+", 0.8, r"card|visa|credit|pay", 0.2),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"phone|call|tel|mobile|fax", 0.2),
    "iban": (_iban(), 0.8, r"iban|account|bank|konto|cuenta|compte", 0.2),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, r"ssn|social security|tax id", 0.5),
}
BASE = ("email", "ip", "card", "phone")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total, i):
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * digit - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number (capitals, digits, blanks) leaves 1 modulo 97, letters counting 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")

    def step(left, c):
        code = F.ascii(c)
        return F.when(code >= 65, (left * 100 + code - 55) % 97).otherwise((left * 10 + code - 48) % 97)

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(part, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _lengths(found: Column, between: Column) -> Column:
    """How far each match reaches from the end of the one before: found are the matches, between the pieces around them."""
    return F.transform(found, lambda x, i: F.length(x) + F.length(between[i]))


def _ends(lengths: Column) -> Column:
    """0 and the end of each match: sums within blocks, then over them. lengths is a column of its own, used twice, so that it is computed once a row."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    summed = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    inner = F.transform(blocks, lambda b: summed(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def put(acc, block):
        """acc: blocks moved to their place and the end of the last."""
        return F.struct(F.concat(acc["ends"], F.array(F.transform(block, lambda x: x + acc["last"]))).alias("ends"), (acc["last"] + F.element_at(block, -1)).alias("last"))

    start = F.struct(F.array().cast("array<array<int>>").alias("ends"), F.lit(0).alias("last"))
    return F.aggregate(inner, start, put, lambda acc: F.concat(F.array(F.lit(0)), F.flatten(acc["ends"])))


def _spans(kind: str, rank: int, found: Column, between: Column, ends: Column) -> Column:
    """The confirmed matches as (start, rank, end, kind, score). ends is a column of its own, so that it is computed once a row."""
    _, score, words, more = KINDS[kind]
    index = F.sequence(F.lit(0), F.size(found) - 1)

    def before(i):
        """The NEAR code points before a match, from the pieces and matches that it ends, so that its place in the text costs nothing. No NEAR hold more than AROUND matches."""
        near = [x for j in range(AROUND, 0, -1) for x in (F.get(between, i - j), F.get(found, i - j))]
        return F.when(F.length(between[i]) >= NEAR, F.right(between[i], F.lit(NEAR))).otherwise(F.right(F.concat_ws("", *near, between[i]), F.lit(NEAR)))

    def span(i):
        return F.struct((ends[i] + F.length(between[i])).alias("start"), ends[i + 1].alias("end"), found[i].alias("value"), before(i).alias("before"))

    confirmed = F.filter(F.transform(index, span), lambda s: _valid(kind, s["value"]))

    def scored(s):
        total = F.lit(score) + F.when(F.lower(s["before"]).rlike(words), more).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), total.alias("score"))

    return F.transform(confirmed, scored)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text, found (array of start, rank, end, kind, score; by start, then kind)."""
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    can = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+"), "ssn": F.col("text").contains("-")}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"m_{k}": F.when(can.get(k, F.lit(True)), F.regexp_extract_all("text", F.lit(v[0]), F.lit(0))).otherwise(none) for k, v in KINDS.items()})
    kind_spans = []
    for rank, (kind, spec) in enumerate(KINDS.items()):
        any_ = F.size(f"m_{kind}") > 0
        rows = rows.withColumn(f"p_{kind}", F.when(any_, F.split("text", spec[0], -1)))
        rows = rows.withColumn(f"l_{kind}", F.when(any_, _lengths(F.col(f"m_{kind}"), F.col(f"p_{kind}"))))
        rows = rows.withColumn(f"e_{kind}", F.when(any_, _ends(F.col(f"l_{kind}"))))
        spans = F.when(any_, _spans(kind, rank, F.col(f"m_{kind}"), F.col(f"p_{kind}"), F.col(f"e_{kind}")))
        rows = rows.withColumn(f"s_{kind}", spans)
        empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
        if kind in BASE:
            kind_spans.append(F.coalesce(F.col(f"s_{kind}"), empty))
        else:
            kind_spans.append(F.coalesce(F.filter(f"s_{kind}", lambda s: s["score"] >= THRESHOLD), empty))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*kind_spans)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def pii_report(docs: DataFrame, **columns) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans, scores (aligned with spans)."""
    found = find_pii(docs, **columns)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.transform("found", lambda s: s["score"]).alias("scores"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
