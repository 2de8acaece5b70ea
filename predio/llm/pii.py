"""Personal data in texts: patterns propose spans, checksums confirm, context adjusts.

Patterns find candidates of each kind; a validator (octet range, digit count, Luhn,
mod-97, mod-11, ABA) drops what fails; words near the span raise its score or lower it (a
commit's digest isn't a password, a serial number isn't a card). Base kinds always stay, as
asked for, and carry their score; an added kind counts from `THRESHOLD` on. Everything is DataFrame
functions: matches are wrapped in a mark, the text is split at the marks, and the pieces'
lengths give the offsets.

Kinds, in order: email, ip, card (16 to 19 digits, Luhn), phone, then what the method
adds: iban (mod-97), short_card (13 to 15 digits, Luhn, with a word for cards nearby), key
(tokens with a vendor's prefix), secret (32 to 64 hexadecimal digits next to a word for
secrets), ssn (three, two and four digits in the ranges given out), rut (Chilean identity
number, mod-11) and routing (nine digits, ABA checksum, with a word for banks nearby).

Defined results: a null text is the empty text; offsets are code points, end exclusive;
matches of one kind don't overlap, those of different kinds may; rows with equal doc_id
are looked at each by its own; an empty table gives an empty table; other columns are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Wraps matches. Neither it nor what stands in for it in a text is in any pattern's classes.
MARK, STAND_IN = "\ue000", "\ue001"
#: The patterns as asked for, with possessive repeats and checks of the character before,
#: so that a long run is scanned once; the matches are the same.
LOCAL = "A-Za-z0-9._%+-"
NOT_BEFORE, NOT_AFTER = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
#: 34 characters and a blank before each but the first four.
LONGEST_IBAN = 64
PATTERNS = {
    "email": rf"[{LOCAL}](?:(?<=\G.)|(?<![{LOCAL}][{LOCAL}]))[{LOCAL}]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "short_card": r"(?<![0-9.])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9]|[\x20.-][0-9])",
    "key": r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9_])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "rut": r"(?<![0-9.-])[0-9]{1,2}(?:\.?[0-9]{3}){2}-[0-9Kk](?![A-Za-z0-9-])",
    "routing": r"(?<![0-9.-])[0-9]{9}(?![0-9.-])",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Characters on either side of a span in which context words count.
REACH = 40
CONTEXT = {
    "email": r"(?i)mail|correo|courriel|contact",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|amex|tarjeta|karte|carte",
    "phone": r"(?i)tel|phone|call|mobile|fax|llam",
    "iban": r"(?i)iban|bank|account|konto|compte|cuenta",
    "short_card": r"(?i)card|visa|master|amex|tarjeta|karte|carte",
    "key": r"(?i)key|token|secret|credential",
    "secret": r"(?i)token|secret|passw|credential|api.?key|auth",
    "ssn": r"(?i)\bssn\b|social|security|taxpayer",
    "rut": r"(?i)\brut\b|\brun\b|c[ée]dula|identidad",
    "routing": r"(?i)routing|\baba\b|bank|transfer",
}
#: Words near a span that speak against it.
DOUBTS = {
    "email": r"(?i)example|sample|placeholder",
    "ip": r"(?i)version|release|chapter|section",
    "card": r"(?i)order|serial|isbn|tracking|invoice",
    "phone": r"(?i)order|serial|isbn|tracking|invoice",
    "iban": r"(?i)example|sample|specimen",
    "short_card": r"(?i)order|serial|isbn|tracking|invoice|imei",
    "key": r"(?i)example|sample|placeholder",
    "secret": r"(?i)commit|checksum|digest|\bsha|md5|etag|revision",
    "ssn": r"(?i)order|serial|part|invoice|phone",
    "rut": r"(?i)example|ejemplo|folio|factura",
    "routing": r"(?i)order|serial|part|invoice",
}
#: Score of a valid span by itself, what context adds and doubt takes; an added span counts from THRESHOLD on.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "short_card": 0.3, "key": 0.7, "secret": 0.3, "ssn": 0.4, "rut": 0.6, "routing": 0.2}
CONTEXT_ADDS, DOUBT_TAKES, THRESHOLD = 0.3, 0.3, 0.5


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's checksum."""
    back = F.reverse(digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters go to
    the end, letters count as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def octets(value: Column) -> Column:
    # by digits, not by a cast: a part may be longer than any integer type holds
    return ~value.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")


def mod11(value: Column) -> Column:
    """Whether the last character is the check digit of those before it: weights 2 to 7 from
    the right, K for ten."""
    plain = F.upper(F.regexp_replace(value, "[.-]", ""))
    back = F.reverse(F.substring(plain, F.lit(1), F.length(plain) - 1))
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda t, i: t + F.substring(back, i, F.lit(1)).cast("int") * (2 + (i - 1) % 6))
    rest = 11 - total % 11
    return F.substring(plain, -1, 1) == F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string"))


def aba(value: Column) -> Column:
    """Whether nine digits pass the routing number's checksum (weights 3, 7, 1)."""
    digit = lambda i: F.substring(value, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda t, i: t + digit(i) * F.element_at(F.array(F.lit(3), F.lit(7), F.lit(1)), (i - 1) % 3 + 1))
    return (total % 10 == 0) & (value != "000000000")


def mixed_hex(value: Column) -> Column:
    """Letters and digits, at least eight different ones: not a number or a filler."""
    return value.rlike("[A-Fa-f]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(F.lower(value), ""))) >= 8)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": octets,
    "card": lambda v: F.when(F.length(digits(v)).between(16, 19), luhn(v)).otherwise(False),
    "phone": lambda v: F.length(digits(v)).between(8, 15),
    "iban": mod97,
    "short_card": luhn,
    "key": lambda v: F.lit(True),
    "secret": mixed_hex,
    "ssn": lambda v: ~v.rlike("^(000|666|9..)|-00-|-0000$"),
    "rut": mod11,
    "routing": aba,
}


#: Pieces on either side of a match that hold `REACH` characters at least, or all there are: every
#: second piece is a match, and those have five characters or more.
NEIGHBOURS = 2 * REACH // 5
#: What is there of each kind before it is scored: pieces, their lengths, offsets, ends and starts.
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _pieces(text: Column, kind: str) -> Column:
    """The text cut at a pattern's matches (a match is every second piece, from the second one on);
    for iban at each possible start. Null if there is none."""
    if kind == "iban":
        body = PATTERNS["iban"].removeprefix(NOT_BEFORE).removesuffix(NOT_AFTER)
        marked = F.regexp_replace(text, f"{NOT_BEFORE}(?={body}{NOT_AFTER})", MARK)
    else:
        marked = F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}")
    possible = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(PATTERNS[kind])
    return F.when(possible, F.split(marked, MARK))


def _bases(lengths: Column) -> Column:
    """Offsets of every block of pieces; a block has about as many pieces as there are blocks, so
    offsets take far less than the square of their number. The lengths stand in a column, and only
    single ones are taken, since an array's slice costs as much as the array."""
    n, wide = F.size(lengths), _wide(lengths)
    total = lambda k: F.aggregate(F.sequence(k * wide, F.least(n, (k + 1) * wide) - 1), F.lit(0).cast("long"), lambda t, i: t + F.get(lengths, i))
    none = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int")), none, lambda got, k: F.concat(got, F.array(F.element_at(got, -1) + total(k))))


def _wide(lengths: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths)))).cast("int")


def _offsets(lengths: Column, bases: Column) -> Column:
    """Offset of every piece."""
    n, wide = F.size(lengths), _wide(lengths)

    def block(k: Column) -> Column:
        inner = F.sequence(k * wide, F.least(n, (k + 1) * wide) - 1)
        ends = F.aggregate(inner, F.array(F.get(bases, k)), lambda got, i: F.concat(got, F.array(F.element_at(got, -1) + F.get(lengths, i))))
        return F.slice(ends, 1, F.size(ends) - 1)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(bases) - 2), block))


def _joined_around(ends: Column, at: Column, first: int, last: int) -> Column:
    """What stands in some pieces next to one, from `first` to `last` places on, joined; those that aren't there are empty."""
    return F.array_join(F.transform(F.sequence(at + first, at + last), lambda j: F.get(ends, j)), "")


def _found(kind: str, pieces: Column, offsets: Column, tails: Column, heads: Column) -> Column:
    """The valid matches with their score, from the threshold on. tails, heads: the last and the first
    `REACH` characters of every piece."""

    def score(i: Column) -> Column:
        before = F.substring(_joined_around(tails, i, -NEIGHBOURS, -1), -REACH, REACH)
        after = F.substring(_joined_around(heads, i, 1, NEIGHBOURS), 1, REACH)
        return _span(kind, F.get(offsets, i), F.get(offsets, i) + F.length(F.get(pieces, i)), before, after)

    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)))
    return _counted(kind, F.transform(F.filter(places, lambda i: VALID[kind](F.get(pieces, i))), score))


def _account_numbers(offsets: Column, tails: Column, heads: Column) -> Column:
    """As _found, for iban: of each start the longest end that passes mod-97, since what follows a
    number may look like its end; none begins inside the one before. heads: first characters of
    what begins at every start, enough for the longest number and the context after it."""
    body = PATTERNS["iban"].removeprefix(NOT_BEFORE).removesuffix(NOT_AFTER)

    def longest(i: Column) -> Column:
        text = F.get(heads, i)
        first = lambda n: F.substring(text, F.lit(1), n)
        fits = lambda n: (F.length(first(n)) == n) & first(n).rlike(f"^{body}\\z") & ~F.substring(text, n + 1, F.lit(1)).rlike("[A-Za-z0-9]")
        return F.get(F.filter(F.sequence(F.lit(LONGEST_IBAN), F.lit(15), F.lit(-1)), lambda n: F.when(fits(n), mod97(first(n))).otherwise(False)), F.lit(0))

    def score(x: Column) -> Column:
        i, n = x["i"], x["n"]
        before = F.substring(_joined_around(tails, i, -NEIGHBOURS, -1), -REACH, REACH)
        return _span("iban", F.get(offsets, i), F.get(offsets, i) + n, before, F.substring(F.get(heads, i), n + 1, F.lit(REACH)))

    places = F.when(F.size(offsets) > 1, F.sequence(F.lit(1), F.size(offsets) - 1))
    ended = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), longest(i).alias("n"))), lambda x: x["n"].isNotNull())
    return F.transform(ended, score)


def _apart(spans: Column) -> Column:
    """Spans in order, without those that begin inside the one before that stays."""
    none = F.struct(F.array().cast(SPAN).alias("kept"), F.lit(0).cast("long").alias("free"))

    def step(got: Column, x: Column) -> Column:
        fits = x["start"] >= got["free"]
        return F.struct(F.when(fits, F.concat(got["kept"], F.array(x))).otherwise(got["kept"]).alias("kept"), F.when(fits, x["end"]).otherwise(got["free"]).alias("free"))

    touch = F.exists(F.sequence(F.lit(1), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] < F.get(spans, i - 1)["end"])
    return F.when((F.size(spans) > 1) & touch, F.aggregate(spans, none, step, lambda got: got["kept"])).otherwise(spans)


def _span(kind: str, start: Column, end: Column, before: Column, after: Column) -> Column:
    around = F.concat(before, F.lit(" "), after)
    adds = F.when(around.rlike(CONTEXT[kind]), CONTEXT_ADDS).otherwise(0.0) - F.when(around.rlike(DOUBTS[kind]), DOUBT_TAKES).otherwise(0.0)
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind]) + adds)), 2).alias("score"))


def _counted(kind: str, spans: Column) -> Column:
    return spans if kind in KINDS else F.filter(spans, lambda x: x["score"] >= THRESHOLD)


def _spanned(docs: DataFrame) -> DataFrame:
    """doc_id, __text and spans. Each step's arrays stand in columns of their own: within a
    lambda they would be made anew for every match."""
    marked = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(STAND_IN))
    c = lambda name, k: F.col(f"__{name}_{k}")
    every = lambda f, name: [f(k).alias(f"__{name}_{k}") for k in PATTERNS]
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"), marked.alias("__marked"))
    d = d.select("doc_id", "__text", *every(lambda k: _pieces(F.col("__marked"), k), "pieces"))
    several = lambda k, x: F.when(F.size(c("pieces", k)) > 1, x)
    d = d.select(
        "*", *every(lambda k: several(k, F.transform(c("pieces", k), lambda p: F.length(p).cast("long"))), "lengths"),
        *every(lambda k: several(k, F.transform(c("pieces", k), lambda p: F.substring(p, -REACH, REACH))), "tails"),
        *every(lambda k: several(k, F.transform(c("pieces", k), lambda p: F.substring(p, 1, LONGEST_IBAN + REACH if k == "iban" else REACH))), "heads"),
    )
    d = d.select("*", *every(lambda k: several(k, _bases(c("lengths", k))), "bases"))
    d = d.select("*", *every(lambda k: several(k, _offsets(c("lengths", k), c("bases", k))), "offsets"))
    # an account number may go on over the starts inside it: every start with what follows it
    whole = F.transform(F.sequence(F.lit(0), F.size(c("heads", "iban")) - 1), lambda i: F.substring(_joined_around(c("heads", "iban"), i, 0, (LONGEST_IBAN + REACH) // 4), 1, LONGEST_IBAN + REACH))
    d = d.withColumn("__starts", several("iban", whole))
    d = d.withColumn("__numbers", several("iban", _account_numbers(c("offsets", "iban"), c("tails", "iban"), F.col("__starts"))))
    none = F.array().cast(SPAN)
    spans = {k: several(k, _found(k, c("pieces", k), c("offsets", k), c("tails", k), c("heads", k))) for k in PATTERNS if k != "iban"}
    spans["iban"] = _counted("iban", _apart(F.col("__numbers")))
    return d.select("doc_id", "__text", F.concat(*[F.coalesce(spans[k], none) for k in PATTERNS]).alias("spans"))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end, score>> by kind
    as listed, then start."""
    return _spanned(docs).select("doc_id", "spans")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame, hidden: str = "*") -> DataFrame:
    """doc_id and masked_text: every span's characters replaced, one for one."""

    def cover(text: Column, s: Column) -> Column:
        n = (s["end"] - s["start"]).cast("int")
        return F.overlay(text, F.repeat(F.lit(hidden), n), (s["start"] + 1).cast("int"), n)

    return _spanned(docs).select("doc_id", F.aggregate("spans", F.col("__text"), cover).alias("masked_text"))
