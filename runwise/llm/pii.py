"""Personal data: regular expressions propose spans, checksums confirm them, nearby words score them.

Everything is a column expression of one projection, without a shuffle and without Python.  For each kind
``regexp_extract_all`` gives the matches and ``split`` by the same pattern the text between them; running sums
of the lengths are the positions, and the ends of the pieces around a match are its context.

The patterns are those of the contract in a form that the regular expression engine reads without
backtracking or recursion (possessive repeats, a start only where a run of characters starts), so a run of a
million digits or letters is linear; ``PLAIN`` has the contract's own form, which the SQL uses.

Kinds: email, ip, card, phone are the base ones and stay whatever their score.  iban (mod 97), ssn, local
(telephone numbers without a country code) and birth (dates of birth) are added where the score, the kind's
own weight, raised by words that speak for it within ``REACH`` characters and lowered by words against it in the
``NEAREST`` characters before it, comes to ``LEAST_SCORE``.  Context ends at the neighbouring match of the same kind.

Defined results: a null or empty text has no spans; repeated rows and null ids each keep their own row; an
empty table gives an empty table; very long texts are read whole; spans of different kinds may overlap; other
columns of the input aren't read by ``report`` and pass through ``find`` inside the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.functions.geo import let

REACH = 40
LEAST_SCORE = 0.5
NEAREST = 16
CONTEXT_BONUS, CONTEXT_MALUS = 0.4, 0.3

# Fixed values of the contract.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Proposals of the added kinds; both regular expression engines read them alike.
ADDED = {
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    "birth": r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}",
}
OCTET = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}$"
# A number that goes on before or after the match is part of a longer one.
GOES_ON_BEFORE, GOES_ON_AFTER = r"[A-Za-z0-9+.(-]$|[0-9]\x20$", r"^[./-]?[A-Za-z0-9]"
SSN = r"^(?:00[1-9]|0[1-9].|[1-578]..|6[0-57-9].|66[0-57-9])-(?:0[1-9]|[1-9].)-(?:000[1-9]|00[1-9].|0[1-9]..|[1-9]...)$"
DATE = r"^(?:(?:19|20)[0-9]{2}[./-](?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-](?:19|20)[0-9]{2})$"


def _words(*words: str) -> str:
    return r"(?i)(?:^|[^A-Za-z])(?:" + "|".join(words) + r")(?:[^A-Za-z]|$)"


WEIGHT = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local": 0.3, "birth": 0.1}
HELPS = {
    "email": _words("e-?mail", "mail", "contact"),
    "ip": _words("ip", "host", "server", "address"),
    "card": _words("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"),
    "phone": _words("tel", "phone", "telephone", "mobile", "call", "fax", "telefon"),
    "iban": _words("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": _words("ssn", "social security", "tax id"),
    "local": _words("tel", "phone", "telephone", "mobile", "call", "fax", "cell"),
    "birth": _words("born", "birth", "dob", "birthday", "birthdate", "geboren", "geburtsdatum", "nacid[oa]"),
}
HURTS = _words("order", "invoice", "version", "isbn", "issn", "part no", "serial", "ticket")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str                                   # proposals, in the linear form
    hint: Callable[[Column], Column]               # false only where the pattern can't match acceptably
    accept: Callable[[Column], Column]             # candidate struct -> the accepted part of its text, or null
    base: bool


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(c: Column) -> Column:
    number = digits(c["text"])
    return F.when(F.length(number).between(13, 19) & F.call_function("luhn_check", number), c["text"])


def _phone(c: Column) -> Column:
    return F.when(F.length(digits(c["text"])).between(9, 15), c["text"])


def _apart(c: Column) -> Column:
    return ~c["before"].rlike(GOES_ON_BEFORE) & ~c["after"].rlike(GOES_ON_AFTER)


def mod97(number: Column) -> Column:
    """Remainder of an account number by 97: its first four characters last, letters as 10 to 35."""
    def add(rest: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    turned = F.concat(F.substr(number, F.lit(5)), F.substr(number, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(add(a, x)))


def _iban(c: Column) -> Column:
    """The whole proposal, or without its last group where that is a word that follows."""
    def confirmed(text: Column) -> Column:
        number = F.replace(text, F.lit(" "), F.lit(""))
        return F.length(number).between(15, 34) & (mod97(number) == 1)

    shorter = F.regexp_replace(c["text"], r"\x20[A-Z0-9]+$", "")
    ends = ~c["before"].rlike(r"[A-Za-z0-9]$")
    return F.when(ends & ~c["after"].rlike("^[A-Za-z0-9]") & confirmed(c["text"]), c["text"]).when(ends & confirmed(shorter), shorter)


def _rlike(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


KINDS: dict[str, Kind] = {k.name: k for k in (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), lambda c: c["text"], True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
         lambda c: F.when(c["text"].rlike(OCTET), c["text"]), True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _rlike(r"(?:[0-9][\x20-]?){12}[0-9]"), _card, True),
    Kind("phone", PLAIN["phone"], lambda t: F.contains(t, F.lit("+")), _phone, True),
    Kind("iban", ADDED["iban"], _rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), _iban, False),
    Kind("ssn", ADDED["ssn"], _rlike(ADDED["ssn"]),
         lambda c: F.when(_apart(c) & c["text"].rlike(SSN), c["text"]), False),
    Kind("local", ADDED["local"], _rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"), lambda c: F.when(_apart(c), c["text"]), False),
    Kind("birth", ADDED["birth"], _rlike(r"[0-9][./-][0-9]{1,2}[./-][0-9]"),
         lambda c: F.when(_apart(c) & c["text"].rlike(DATE), c["text"]), False),
)}
BASE = [k.name for k in KINDS.values() if k.base]

CANDIDATES = "array<struct<start:int,text:string,before:string,after:string>>"
SPANS = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def running_sums(xs: Column) -> Column:
    """Running sums of a non-empty array, in blocks of its root's length: an appended array is copied."""
    def by_blocks(b: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, b), lambda k: F.slice(xs, k + 1, b))

        def sums(block: Column, before: Column) -> Column:
            return F.aggregate(block, F.array(before), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

        def finish(bs: Column) -> Column:
            totals = F.transform(bs, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x))
            return let(sums(totals, F.lit(0)), lambda starts: F.flatten(F.transform(
                bs, lambda block, k: F.slice(sums(block, F.get(starts, k)), F.lit(2), F.size(block)))))

        return let(blocks, finish)

    return let(F.ceil(F.sqrt(F.size(xs))).cast("int"), by_blocks)


def candidates(text: Column, kind: Kind) -> Column:
    """Every match of the kind's pattern with its position and the characters around it."""
    def place(matches: Column, pieces: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))
        return let(running_sums(steps), lambda starts: F.transform(matches, lambda m, i: F.struct(
            F.get(starts, i).alias("start"), m.alias("text"), F.right(F.get(pieces, i), F.lit(REACH)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(REACH)).alias("after"))))

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) > 0, let(F.split(text, kind.pattern, -1), lambda p: place(m, p))))
    return F.coalesce(F.when(kind.hint(text), found), F.array().cast(CANDIDATES))


def score(kind: Kind, c: Column) -> Column:
    """The kind's weight, changed by words near the match."""
    near = F.concat(c["before"], F.lit(" "), c["after"])
    value = F.lit(WEIGHT[kind.name]) + F.when(near.rlike(HELPS[kind.name]), CONTEXT_BONUS).otherwise(0.0) \
        - F.when(F.right(c["before"], F.lit(NEAREST)).rlike(HURTS), CONTEXT_MALUS).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 2)


def spans(found: Column, kind: Kind) -> Column:
    """Candidates that the validator accepts and, for added kinds, the score confirms."""
    def judge(c: Column) -> Column:
        return let(kind.accept(c), lambda text: F.struct(
            F.lit(kind.name).alias("kind"), c["start"].alias("start"), (c["start"] + F.length(text)).alias("end"),
            text.alias("text"), score(kind, c).alias("score")))

    def keep(s: Column) -> Column:
        return s["text"].isNotNull() if kind.base else s["text"].isNotNull() & (s["score"] >= LEAST_SCORE)

    return F.filter(F.transform(found, judge), keep).cast(SPANS)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all input columns), and per kind the array of spans, ordered by start."""
    every = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    proposed = every.select("row", *[candidates(F.col("whole"), k).alias(k.name) for k in KINDS.values()])
    return proposed.select("row", *[spans(F.col(k.name), k).alias(k.name) for k in KINDS.values()])


def listed(*kinds: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    every = F.concat(*[F.col(k) for k in kinds])
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the number of spans that the method adds."""
    found = find(docs.select("doc_id", "text"))
    added = [k for k in KINDS if k not in BASE]
    return found.select(
        "row.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(*BASE), 256).alias("base_sha256"),
        listed(*KINDS).alias("spans"), F.size(F.concat(*[F.col(k) for k in added])).cast("long").alias("n_added"))
