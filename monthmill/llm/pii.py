"""Personal data: regular expressions propose spans, validators confirm, context adjusts the score.

Four base kinds (email, ip, card, phone) are found leftmost and non-overlapping;
those that fail their check are dropped.  Three further kinds are scored: iban
(mod 97), ssn (needs a context word nearby) and secret (keys and assigned
passwords or tokens, in any case, quoted or not, of any length from 8 on).  Positions are code points, derived from the lengths of the gaps and
matches of the same expression, so nothing leaves the JVM.  Every expression
starts only where a run of its characters starts and uses possessive repetition,
so it is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, table

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "secret")

#: Names in any case whose assigned value is a secret; words before them (access_token, dbPassword) are left out of the span.
SECRET_NAME = r"passw(?:or)?d|passphrase|pwd|secret(?:[_-]?(?:access[_-]?)?key)?|token|(?:api|access|private)[_-]?key"
#: The whole value: to its closing quote on the same line, else to white space.
SECRET_VALUE = r"""(?:"(?:[^"\\\n]|\\.){8,}+"|'(?:[^'\\\n]|\\.){8,}+'|`[^`\n]{8,}+`|["'`]?+[^ \t-\r]{8,}+)"""

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": rf"(?:(?<![A-Za-z0-9])AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9])|(?i:{SECRET_NAME})[\\\"'`]{{0,3}}[ \t]*+(?::=|=>|=++|:)[ \t]*+{SECRET_VALUE})",
}
#: A cheap test that a text must pass before its expression is tried.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
#: Scores: of the pattern alone, added by a confirmed checksum, added by a context word.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.4, "secret": 0.8}
CHECKED, IN_CONTEXT, KEEP_FROM = 0.4, 0.2, 0.6
CONTEXT = {
    "email": "mail|contact|correo|courriel|kontakt",
    "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|telefon|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
    "secret": "key|token|secret|password|login",
}
CONTEXT_WIDTH = 40
BLOCK = 256
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _ip_valid(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card_valid(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", F.when(F.length(digits).between(13, 19), digits).otherwise(F.lit("1")))


def _phone_valid(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN's rearranged digits; 1 is valid."""
    s = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    return F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


VALID = {"ip": _ip_valid, "card": _card_valid, "phone": _phone_valid, "iban": lambda m: mod97(m) == 1}
HAS_CHECKSUM = {"card", "iban"}


# Context is what lies between a match and its neighbours of the same kind, up to CONTEXT_WIDTH a side.
def spans_of(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, score) of one kind, in order of start."""
    pattern = F.lit(PATTERNS[kind])
    none = F.array().cast(SPANS)
    placed_type = "array<struct<v:string,near:string,start:int,end:int>>"

    def place(x: Column) -> Column:
        """Positions by running sums, in blocks of BLOCK so that long arrays aren't copied at each step."""
        tail = lambda i: F.substring(F.get(x.getField("g"), i), -CONTEXT_WIDTH, CONTEXT_WIDTH)
        head = lambda i: F.substring(F.get(x.getField("g"), i + 1), 1, CONTEXT_WIDTH)
        parts = F.transform(
            x.getField("m"),
            lambda v, i: F.struct(v.alias("v"), F.length(F.get(x.getField("g"), i)).alias("gap"), F.lower(F.concat_ws(" ", tail(i), head(i))).alias("near")),
        )

        def step(acc: Column, p: Column) -> Column:
            start = acc.getField("pos") + p.getField("gap")
            end = start + F.length(p.getField("v"))
            here = F.struct(p.getField("v").alias("v"), p.getField("near").alias("near"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("pos"), F.concat(acc.getField("out"), F.array(here)).alias("out"))

        def block(p: Column, at: Column) -> Column:
            zero = F.struct(at.getField("pos").alias("pos"), F.array().cast(placed_type).alias("out"))
            return F.aggregate(F.slice(p, at.getField("first"), F.lit(BLOCK)), zero, step, lambda acc: acc.getField("out"))

        def starts(p: Column) -> Column:
            length = lambda first: F.aggregate(F.slice(p, first, F.lit(BLOCK)), F.lit(0), lambda a, q: a + q.getField("gap") + F.length(q.getField("v")))
            return F.aggregate(
                F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(BLOCK)),
                F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<first:int,pos:int>>").alias("out")),
                lambda acc, first: F.struct(
                    (acc.getField("pos") + length(first)).alias("pos"),
                    F.concat(acc.getField("out"), F.array(F.struct(first.alias("first"), acc.getField("pos").alias("pos")))).alias("out"),
                ),
                lambda acc: acc.getField("out"),
            )

        return let(parts, lambda p: F.flatten(F.transform(starts(p), lambda at: block(p, at))))

    def score(p: Column) -> Column:
        near = F.when(p.getField("near").rlike(rf"(?<![\p{{L}}])(?:{CONTEXT[kind]})"), F.lit(IN_CONTEXT)).otherwise(F.lit(0.0))
        return F.least(F.lit(1.0), F.lit(BASE_SCORE[kind] + (CHECKED if kind in HAS_CHECKSUM else 0.0)) + near)

    def finish(placed: Column) -> Column:
        if kind in VALID:
            placed = F.filter(placed, lambda p: VALID[kind](p.getField("v")))
        found = F.transform(placed, lambda p: F.struct(F.lit(kind).alias("kind"), p.getField("start").alias("start"), p.getField("end").alias("end"), score(p).alias("score")))
        return found if kind in BASE_KINDS else F.filter(found, lambda p: p.getField("score") >= KEEP_FROM)

    found = let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("g")), lambda x: finish(place(x)))
    possible = text.rlike(PATTERNS[kind])
    if kind in NEEDS:
        possible = F.contains(text, F.lit(NEEDS[kind])) & possible
    return F.when(possible, found).otherwise(none).cast(SPANS)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_all``: arrays of spans by kind, then start.

    A span has kind, start, end and score.  Null text is an empty text and has none; repeated rows
    get equal spans, an empty table an empty result.  A text of any length is searched whole, by expressions whose time is linear in it.  Columns of those names are replaced.
    """
    t, extra = F.coalesce(F.col(text), F.lit("")), fresh("extra")
    out = docs.withColumns({"pii_base": F.concat(*[spans_of(t, k) for k in BASE_KINDS]), extra: F.concat(*[spans_of(t, k) for k in EXTRA_KINDS])})
    return out.withColumn("pii_all", F.concat("pii_base", extra)).drop(extra)


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s.getField("start").alias("start"), (-s.getField("end")).alias("end"), s.getField("kind").alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        end = -s.getField("end")
        pieces = F.array(F.substring(text, acc.getField("pos") + 1, s.getField("start") - acc.getField("pos")), F.concat(F.lit("<"), F.upper(s.getField("kind")), F.lit(">")))
        return F.struct(
            F.greatest(acc.getField("pos"), end).alias("pos"),
            F.when(s.getField("start") >= acc.getField("pos"), F.concat(acc.getField("out"), pieces)).otherwise(acc.getField("out")).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(ordered, zero, step, lambda acc: F.concat(F.array_join(acc.getField("out"), ""), F.substring(text, acc.getField("pos") + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs``, with personal data in ``text`` replaced.  Null texts stay null, repeated rows stay equal, an empty table stays empty."""
    return find_pii(docs, text).withColumn(text, redacted(F.col(text), F.col("pii_all"))).select(*docs.columns)


def op10_pii_of(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s.getField("kind") == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(rendered(F.col("pii_base")), 256).alias("base_sha256"),
        rendered(F.col("pii_all")).alias("spans"),
        F.array_join(F.transform("pii_all", lambda s: F.format_number(s.getField("score"), 1)), ",").alias("scores"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_pii_of(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pii": op10_pii}
ORACLES = {}
