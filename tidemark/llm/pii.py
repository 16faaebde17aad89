"""Personal data in whole texts. DataFrame functions only.

Regular expressions propose spans, checks confirm them (address parts for ip, Luhn for card, digit
counts for phone, mod 97 for iban), and words near a span adjust its score. The base kinds email, ip,
card and phone keep every confirmed span whatever its score; iban and ssn are added where their score
reaches `least`: ssn, which has no checksum, only with a fitting word nearby.

Positions come from splitting a text by the same expression: pieces and matches alternate, so a running
sum of their lengths (in code points) gives each span's start. The expressions find the same leftmost
non-overlapping matches as the plain forms in their comments, but never step back over a long run:
a match can start only where a run starts, or where the last match ended.

Scale: one map over the texts, with no shuffle, no join and no Python; matches leave the first
projection without the text. A document's cost is linear in its length (running sums go by blocks of
256 matches).

Edge cases: null text is empty; no spans give zero counts, empty spans and the digest of the empty
string; repeated rows count each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (expression, cheap test that a text must pass, score, words that raise it)
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write to"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|server|host"),
    # [0-9]([\x20-]?[0-9])+, 13 to 19 digits passing Luhn
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", None, 0.7, "card|visa|credit|debit|karte|tarjeta|carte"),
    # \+[0-9][\x20().0-9-]+[0-9], 9 to 15 digits
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, 0.8, "iban|bank|konto|account|cuenta|compte"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"\bssn\b|social security|tax id"),
}
BASE = ("email", "ip", "card", "phone")
_NEAR = 40


def _running(a: Column) -> Column:
    """Inclusive running sums of a non-empty array, by blocks of 256."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 256).cast("int")), lambda b: F.slice(a, b * 256 + 1, 256))
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    before = F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)), zero, grow)
    pairs = F.arrays_zip(blocks.alias("x"), F.slice(before, 1, F.size(before) - 1).alias("off"))
    return F.flatten(F.transform(pairs, lambda p: F.slice(F.aggregate(p["x"], F.array(p["off"]), grow), 2, F.size(p["x"]))))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = _digits(s)
    n = F.length(d)

    def add(total, i):
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(s: Column) -> Column:
    c = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, F.lit(1), F.lit(4)))

    def add(total, i):
        x = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(x < 58, (total * 10 + x - 48) % 97).otherwise((total * 100 + x - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(s)
    return F.lit(True)


def _spans(kind: str, m: Column, g: Column, steps: Column, least: float) -> Column:
    """Array of (start, end, score) of the confirmed matches of a kind."""
    _, _, score, words = KINDS[kind]
    rows = F.transform(
        F.arrays_zip(m.alias("m"), _running(steps).alias("to"), F.slice(g, F.lit(1), F.size(m)).alias("l"), F.slice(g, F.lit(2), F.size(m)).alias("r")),
        lambda x: F.struct(
            x["m"].alias("m"),
            (x["to"] - F.length(x["m"])).alias("start"),
            x["to"].alias("end"),
            (F.lit(score) + F.when(F.lower(F.concat(F.right(x["l"], F.lit(_NEAR)), F.lit(" "), F.left(x["r"], F.lit(_NEAR // 2)))).rlike(words), 0.2).otherwise(0.0)).alias("score"),
        ),
    )
    kept = F.filter(rows, lambda x: _confirmed(kind, x["m"]) & (F.lit(True) if kind in BASE else x["score"] >= least))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,score:double>>)")
    return F.when(F.size(m) > 0, F.transform(kept, lambda x: F.struct(x["start"], x["end"], x["score"]))).otherwise(empty)


def find_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and, by kind, an array of (start, end, score); start and end in code points, end exclusive."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    none = F.expr("cast(array() as array<string>)")
    found = {}
    for kind, (pattern, sign, _, _) in KINDS.items():
        test = F.contains("t", F.lit(sign)) if sign else F.col("t").rlike("[0-9]")
        found[f"m_{kind}"] = F.when(test, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none)
    d = d.withColumns(found)
    d = d.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("t", p[0], -1)).otherwise(none) for k, p in KINDS.items()}).drop("t")
    steps = {f"s_{k}": F.zip_with(f"m_{k}", F.slice(f"g_{k}", F.lit(1), F.size(f"m_{k}")), lambda m, g: (F.length(m) + F.length(g)).cast("long")) for k in KINDS}
    d = d.withColumns(steps)
    return d.select("doc_id", *[_spans(k, F.col(f"m_{k}"), F.col(f"g_{k}"), F.col(f"s_{k}"), least).alias(k) for k in KINDS])


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def _joined(kinds) -> Column:
    return F.array_join(F.concat(*[_named(k) for k in kinds]), ",")


def query(spark, sf_dir: str) -> DataFrame:
    d = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(BASE).cast("binary"), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"),
        F.array_join(F.concat(*[F.transform(k, lambda x: F.format_number(x["score"], 1)) for k in KINDS]), ",").alias("scores"),
    )
