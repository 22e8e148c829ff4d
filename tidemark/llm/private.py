"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

DataFrame operations only.  A pattern's matches come from ``regexp_extract_all`` and the text
between them from ``split`` with the same pattern, so places follow from lengths, and the
neighbourhood of a match is the end of the piece before it and the start of the piece after it.
Quantifiers are possessive where that changes no match, so a run of a million digits neither
backtracks nor deepens the stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field

NEAR, PASS = 40, 60
SPANS = "array<struct<kind: string, start: bigint, end: bigint, value: string, score: int>>"
_SUM_BLOCK = 256


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))
    digit = lambda i: F.substring(number, -i, F.lit(1)).cast("int")
    doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """True where an account number passes mod-97: four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _between(value: Column, low: int, high: int, then: Callable[[Column], Column] | None = None) -> Column:
    number = digits(value)
    fits = F.length(number).between(low, high)
    return F.when(fits, then(number)).otherwise(False) if then else fits


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what proposes a span, what confirms it, what its neighbourhood says.

    ``needs`` is a pattern every match holds, cheap to look for.  The score is ``prior``, plus
    ``confirmed`` if the check passes, plus ``context`` if one of ``words`` is near.  A span of a
    ``base`` kind stays if its check passes; any other one needs a score of :data:`PASS`.
    """

    name: str
    pattern: str
    needs: str
    check: Callable[[Column, Column], Column]
    words: tuple[str, ...]
    base: bool = True
    prior: int = 30
    confirmed: int = 30
    context: int = 30


# The four base patterns, in forms that match the same spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

KINDS = (
    Kind("email", EMAIL, "@", lambda v, before: F.lit(True), ("mail", "email", "contact", "write", "address")),
    Kind("ip", IP, r"[0-9]\.[0-9]", lambda v, before: v.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), ("ip", "host", "server", "address", "login")),
    Kind("card", CARD, "[0-9]", lambda v, before: _between(v, 13, 19, luhn), ("card", "visa", "credit", "debit", "payment")),
    Kind("phone", PHONE, r"\+[0-9]", lambda v, before: _between(v, 9, 15), ("phone", "call", "tel", "fax", "mobile")),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}+", "[A-Z][A-Z][0-9][0-9]", lambda v, before: ~before.rlike("[A-Za-z0-9]$") & mod97(v), ("iban", "account", "bank", "transfer", "konto"), base=False),
    # Without a checksum: a plausible number also needs a word near it.
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-[0-9]{2}-", lambda v, before: ~before.rlike("[0-9-]$") & ~v.rlike("^(000|666|9)|-00-|-0000$"), ("ssn", "social", "security", "insurance"), base=False, confirmed=20),
    Kind("phone_local", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "[0-9]{3}[ .-][0-9]{4}", lambda v, before: ~before.rlike("[0-9+][ ().-]*$"), ("phone", "call", "tel", "fax", "mobile"), base=False, confirmed=20),
)


def _running(steps: Column) -> Column:
    """Inclusive running sums of an array, in blocks, so that long arrays are not copied once per element."""
    add = lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["sums"], F.array(acc["total"] + x)).alias("sums"))
    empty = F.array().cast("array<bigint>")
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("total"), empty.alias("sums")))
    blocks = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _SUM_BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def block(done: Column, b: Column) -> Column:
        zero = F.struct(F.element_at(done, -1)["total"].alias("total"), empty.alias("sums"))
        return F.concat(done, F.array(F.aggregate(F.slice(steps, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK)), zero, add)))

    return F.flatten(F.transform(F.aggregate(blocks, start, block), lambda x: x["sums"]))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, kind: Kind) -> Column:
    """All confirmed spans of one kind in a text, in order; places are code points, the end is exclusive."""
    split = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    word = rf"(?i)(?<![\p{{L}}])({'|'.join(kind.words)})(?![\p{{L}}])"

    def span(x: Column) -> Column:
        value, before, after = x["value"], F.right(x["before"], F.lit(NEAR)), F.left(x["after"], F.lit(NEAR))
        near = before.rlike(word) | after.rlike(word)
        confirmed = kind.check(value, before)
        score = F.lit(kind.prior) + F.when(confirmed, kind.confirmed).otherwise(0) + F.when(near, kind.context).otherwise(0)
        return F.struct(F.lit(kind.name).alias("kind"), (x["end"] - F.length(value)).alias("start"), x["end"].alias("end"), value.alias("value"), score.alias("score"), confirmed.alias("ok"))

    def located(s: Column) -> Column:
        n = F.size(s["found"])
        before, after = F.slice(s["pieces"], F.lit(1), n), F.slice(s["pieces"], F.lit(2), n)
        ends = _bind(F.zip_with(before, s["found"], lambda p, m: (F.length(p) + F.length(m)).cast("bigint")), _running)
        return F.transform(F.arrays_zip(before.alias("before"), s["found"].alias("value"), after.alias("after"), ends.alias("end")), span)

    keep = (lambda x: x["ok"]) if kind.base else (lambda x: x["ok"] & (x["score"] >= PASS))
    bare = lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "value", "score")])
    found = F.transform(F.filter(_bind(split, located), keep), bare)
    return F.when(text.rlike(kind.needs), found).otherwise(F.array()).cast(SPANS)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The personal data of every text: doc_id and spans (kind, start, end, value, score).

    One row per input row, spans by kind as listed, then start.  Matches of one kind do not
    overlap, those of two kinds may.  Null and empty texts have no spans; repeated rows
    give repeated results; other columns are not read.  Whole texts are searched.
    """
    text = F.coalesce(field(docs, "text", "string"), F.lit(""))
    return docs.select(field(docs, "doc_id", "long").alias("doc_id"), F.concat(*[spans_of(text, k) for k in kinds]).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
