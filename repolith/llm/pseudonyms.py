"""PII (3): format-preserving pseudonyms by keyed Feistel permutations.

E-mail addresses, account numbers (IBAN), phone numbers, social security numbers, dates, IPv4 and IPv6 addresses and card
numbers (Luhn) are found by pattern and validated; each becomes another valid value of its own format. The mapping is a
permutation of the format's values that the key picks, so equal values stay equal in all documents, different ones stay
different, and who holds the key can undo it. A value is a number v below a * b, split into (v / b, v mod b); each of ten
rounds adds a keyed digest of one half to the other. Sets of another size lie in the next square, and a value walks on
until it is back in its set. DataFrame functions only.

No pattern backtracks over more than a bounded stretch: runs are possessive or have a most length, and no group that
repeats without bound can be given back. So texts of any length and form pass in linear time and constant stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 10
#: Steps that a walk back into its set may take: each fails with a chance under a third.
WALK = 64
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: In the order in which they are tried at one place. An e-mail's local part has 64 characters at most, as its standard says.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?=[A-Za-z0-9.-]*?\.[A-Za-z]{2})[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "iban": r"(?<![\w-])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "phone_abroad": r"(?<![\w.+-])\+[1-9](?:\d{0,2}(?:[ .-]\(?\d{1,5}\)?){1,6}|\d{7,14})(?![\w-])",
    "ssn": r"(?<![\w.-])(?!000|666|9)(?:\d{3}-(?!00)\d\d-(?!0000)\d{4}|\d{3} (?!00)\d\d (?!0000)\d{4})(?![\w-])",
    "date": r"(?<![\w./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d{1,2}/\d{1,2}/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?:(?![\w-])|(?=T\d\d:\d\d))",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w-]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])",
    "card": r"(?<![\w.-])(?:\d{4} \d{4} \d{4} \d{1,4}|\d{4}-\d{4}-\d{4}-\d{1,4}|\d{13,19})(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: 1900-01-01 to 2099-12-31 are 73,049 days: 229 times 319.
_DAY0, _DAY_HALVES = "1900-01-01", (229, 319)
_ALPHABET, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
#: Characters that make one number: 26 ** 12 has room for its square root's rounding in 63 bits.
PIECE = 12


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def permute(value: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 to a * b - 1 (longs; ``tweak``: a string that picks one of many)."""

    def digest(i: Column, half: Column, m: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), m)

    def round_(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, (acc["l"] + digest(i, acc["r"], a)) % a).otherwise(acc["l"])
        right = F.when(even, acc["r"]).otherwise((acc["r"] + digest(i, acc["l"], b)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(_div(value, b).alias("l"), (value % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda acc: acc["l"] * b + acc["r"])


def _power(base: int, n: Column) -> Column:
    """base ** n as a long; exact, as it stays under 2 ** 53."""
    return F.round(F.pow(F.lit(float(base)), n)).cast("long")


def _digits(text: Column, key: str, kind: str) -> Column:
    """A string of 1 to 18 digits as another of the same length."""
    n = F.length(text)
    half = F.shiftright(n, 1)
    out = permute(text.cast("long"), _power(10, half), _power(10, n - half), key, F.concat(F.lit(kind), n.cast("string")))
    return F.lpad(out.cast("string"), n, "0")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once: a one-element array gives it a name."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _walk(value: Column, n: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 to n - 1, whatever n's divisors."""
    side = F.ceil(F.sqrt(n.cast("double")) + 1e-3).cast("long")
    move = lambda v: permute(v, side, side, key, tweak)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), move(value), lambda v, _: F.when(v >= n, move(v)).otherwise(v))


def _own(c: Column) -> Column:
    """The letters or digits among which a character stays."""
    return F.when(c.between("0", "9"), _DIGITS).otherwise(_ALPHABET)


def _piece(text: Column, alphabet: Callable[[Column], Column], key: str, tweak: Column) -> Column:
    """Up to PIECE characters, as one number of mixed base, go to others of the same alphabets, place by place."""
    chars, one = F.split(text, ""), F.lit(1).cast("long")
    base = lambda c: F.length(alphabet(c)).cast("long")
    size = F.aggregate(chars, one, lambda n, c: n * base(c))
    value = F.aggregate(chars, one - 1, lambda v, c: v * base(c) + F.call_function("locate", c, alphabet(c)).cast("long") - 1)
    step = lambda acc, c: F.struct(_div(acc["v"], base(c)).alias("v"), F.concat(F.substring(alphabet(c), (acc["v"] % base(c) + 1).cast("int"), F.lit(1)), acc["out"]).alias("out"))
    return F.aggregate(F.reverse(chars), F.struct(_walk(value, size, key, tweak).alias("v"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def _chars(text: Column, alphabet: Callable[[Column], Column], key: str, kind: str) -> Column:
    """A permutation of whole strings: the first piece's mapping is picked by all that follows it, each other one's by the new piece before it."""
    pieces = F.regexp_extract_all(text, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    rest = F.sha2(F.substring(text, F.lit(PIECE + 1), F.length(text)), 256)

    def step(acc: Column, piece: Column) -> Column:
        new = _piece(piece, alphabet, key, F.concat_ws("|", F.lit(kind), F.length(piece).cast("string"), acc["last"]))
        return _let(new, lambda x: F.struct(F.concat(acc["out"], x).alias("out"), x.alias("last")))

    return F.aggregate(pieces, F.struct(F.lit("").alias("out"), rest.alias("last")), step, lambda acc: acc["out"])


def _fill(shape: Column, new: Column, where: str = "[0-9]") -> Column:
    """``shape`` with the characters that are ``where`` replaced, in order, by those of ``new``, upper-case where they were."""

    def step(acc: Column, c: Column) -> Column:
        own = F.substring(new, acc["i"], F.lit(1))
        put = F.when(c.rlike("[A-Z]"), F.upper(own)).otherwise(own)
        return F.when(c.rlike(where), F.struct(F.concat(acc["out"], put).alias("out"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i")))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda acc: acc["out"])


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn's sum; ``doubled_last``: a check digit is still to follow."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == (0 if doubled_last else 1)
        return acc + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def _email(text: Column, key: str) -> Column:
    """Letters and digits before the @ go to others, whatever their case: one mailbox keeps one name. Marks, case and domain stay."""
    local = F.substring_index(text, "@", 1)
    new = _let(_chars(F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", "")), _own, key, "mail"), lambda x: _fill(local, x, "[A-Za-z0-9]"))
    return F.concat(new, F.lit("@"), F.substring_index(text, "@", -1))


def _mod97(text: Column) -> Column:
    """Of letters and digits, a letter being a number from 10, as account numbers are checked."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda v, c: F.when(c.between("0", "9"), v * 10 + value(c)).otherwise(v * 100 + value(c)) % 97)


def _iban(text: Column, key: str) -> Column:
    """The country stays; check digits follow from the new account."""
    all_ = F.regexp_replace(text, " ", "")
    land = F.substring(all_, 1, 2)
    account = F.upper(_chars(F.lower(F.substring(all_, F.lit(5), F.length(all_))), _own, key, "iban"))
    check = lambda x: F.lpad((F.lit(98) - _mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0")
    return _fill(text, _let(account, lambda x: F.concat(land, check(x), x)), "[A-Z0-9]")


def _abroad(text: Column, key: str) -> Column:
    """The country code stays: what stands before the first gap, or two digits of a number without gaps."""
    code = F.regexp_extract(text, "^\\+(\\d{1,3}(?=\\D)|\\d\\d)", 1)
    rest = F.substring(text, F.length(code) + 2, F.length(text))
    own = F.regexp_replace(rest, "[^0-9]", "")
    new = _chars(own, _own, key, "abroad")
    return F.concat(F.lit("+"), code, _fill(rest, new))


def _phone(text: Column, key: str) -> Column:
    """Area code and exchange stay between 200 and 999 where both are; all other numbers go to one of the others. A country code stays."""
    all_ = F.regexp_replace(text, "[^0-9]", "")
    long = lambda x: F.lit(x).cast("long")
    value = F.right(all_, F.lit(10)).cast("long")
    area, exchange = (lambda v: _div(v, 10_000_000)), (lambda v: _div(v, 10_000) % 1000)
    real = lambda v: (area(v) >= 200) & (exchange(v) >= 200)
    place = (area(value) - 200) * 8_000_000 + (exchange(value) - 200) * 10_000 + value % 10_000
    out = permute(place, long(800), long(8_000_000), key, F.lit("phone"))
    out = (_div(out, 8_000_000) + 200) * 10_000_000 + out % 8_000_000 + 2_000_000
    move = lambda v: permute(v, long(100_000), long(100_000), key, F.lit("other phone"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(99)), move(value), lambda v, _: F.when(real(v), move(v)).otherwise(v))
    new = F.lpad(F.when(real(value), out).otherwise(walked).cast("string"), 10, "0")
    return _fill(text, F.concat(F.when(F.length(all_) > 10, F.substring(all_, 1, 1)).otherwise(F.lit("")), new))


def _ssn(text: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(text, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    value = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    out = permute(value, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn"))
    upper = _div(out, 9999)
    a = _div(upper, 99) + 1
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    gap = F.substring(text, 4, 1)
    return F.concat(pad(a + F.when(a >= 666, 1).otherwise(0), 3), gap, pad(upper % 99 + 1, 2), gap, pad(out % 9999 + 1, 4))


def _date_parts(text: Column) -> tuple[Column, Column, Column]:
    """(day, year first?, day before month?) of a date; a valid reading with the day first goes before one with the month first."""
    parts = F.split(text, "[/.]")
    part = lambda i: F.lpad(F.get(parts, F.lit(i)), 2, "0")
    read = lambda d, m: F.try_to_timestamp(F.concat_ws("-", F.get(parts, F.lit(2)), part(m), part(d)), F.lit("yyyy-MM-dd")).cast("date")
    iso, first = text.rlike("^\\d{4}-"), read(0, 1)
    day = F.when(iso, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")).otherwise(F.coalesce(first, read(1, 0)))
    return day, iso, first.isNotNull()


def _date(text: Column, key: str) -> Column:
    """A date that only reads month first goes to another such one, on a day after the 12th: it walks on until it is there.

    One day goes to one day in all notations; a date with one-digit days or months stays without leading zeros.
    """
    day, iso, day_first = _date_parts(text)
    epoch, (a, b) = F.lit(_DAY0).cast("date"), (F.lit(x).cast("long") for x in _DAY_HALVES)
    move = lambda v: permute(v, a, b, key, F.lit("date"))
    at = lambda v: F.date_add(epoch, v.cast("int"))
    value = F.datediff(day, epoch).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(99)), move(value), lambda v, _: F.when(F.dayofmonth(at(v)) <= 12, move(v)).otherwise(v))
    new = at(F.when(iso | day_first, move(value)).otherwise(walked))
    as_ = lambda p: F.date_format(new, p)
    slash, short = text.contains("/"), text.rlike("^\\d/|^\\d\\d/\\d/")
    return (
        F.when(iso, as_("yyyy-MM-dd"))
        .when(day_first & short, as_("d/M/yyyy"))
        .when(short, as_("M/d/yyyy"))
        .when(day_first & slash, as_("dd/MM/yyyy"))
        .when(day_first, as_("dd.MM.yyyy"))
        .when(slash, as_("MM/dd/yyyy"))
        .otherwise(as_("MM.dd.yyyy"))
    )


def _ip(text: Column, key: str) -> Column:
    octet = lambda i: F.split_part(text, F.lit("."), F.lit(i)).cast("long")
    half = F.lit(65_536).cast("long")
    out = permute(((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4), half, half, key, F.lit("ip"))
    return F.concat_ws(".", *((F.shiftright(out, n) % 256).cast("string") for n in (24, 16, 8, 0)))


def _full_ipv6(text: Column) -> Column:
    """32 hexadecimal digits; null if the text is no address: eight groups, or fewer and one ::. Two groups or more hold something, a digit among it."""
    groups = F.filter(F.split(text, ":"), lambda g: g != "")
    n, gap = F.size(groups), text.contains("::")
    pad = lambda g: F.lpad(F.lower(g), 4, "0")
    side = lambda i: F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(i)), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0000"), F.lit(8) - n)
    good = text.rlike("[0-9]") & (n >= 2) & F.when(gap, (n < 8) & ~text.rlike("::.*::|:::|^:[^:]|[^:]:$")).otherwise((n == 8) & ~text.rlike("^:|:$"))
    return F.when(good, F.array_join(F.when(gap, F.concat(F.transform(side(1), pad), zeros, F.transform(side(2), pad))).otherwise(F.transform(groups, pad)), ""))


def _ipv6(text: Column, key: str) -> Column:
    """All notations of one address go to one address, written in full."""
    new = _chars(_full_ipv6(text), lambda _: F.lit(_HEX), key, "ipv6")
    return F.array_join(F.regexp_extract_all(new, F.lit(".{4}"), F.lit(0)), ":")


def _card(text: Column, key: str) -> Column:
    """The first digit stays; the last becomes the check digit of the new number."""
    all_ = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(all_)
    body = F.concat(F.substring(all_, 1, 1), _digits(F.substring(all_, F.lit(2), n - 2), key, "card"))
    return _fill(text, _let(body, lambda x: F.concat(x, ((10 - _luhn_sum(x, True) % 10) % 10).cast("string"))))


def _found(text: Column, key: str) -> Column:
    """(kind, new) of one match; kind is null and new the match itself where it is not valid."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    moved = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(moved, F.lit(5), F.length(moved)), F.substring(moved, 1, 4))
    kind = (
        F.when(text.contains("@"), F.when(text.rlike("@[A-Za-z0-9-]+\\.(?:.*\\.)?[A-Za-z]{2}"), "email"))
        .when(text.rlike("^[A-Z]{2}\\d\\d[ A-Z0-9]+$"), F.when(_mod97(moved) == 1, "iban"))
        .when(text.contains(":"), F.when(_full_ipv6(text).isNotNull(), "ipv6"))
        .when(text.rlike("^\\d{3}([- ])\\d\\d\\1\\d{4}$"), "ssn")
        .when(text.rlike("^(\\d{4}-\\d\\d-\\d\\d|\\d{1,2}[/.]\\d{1,2}[/.]\\d{4})$"), F.when(_date_parts(text)[0].isNotNull(), "date"))
        .when(text.rlike("^\\d+[.]\\d+[.]\\d+[.]\\d+$"), "ip")
        .when(text.rlike("^(\\d{13,19}|\\d{4}[ -]\\d{4}[ -]\\d{4}[ -]\\d+)$"), F.when(_luhn_sum(digits, False) % 10 == 0, "card"))
        .when(text.rlike(f"^(?:{PATTERNS['phone']})$"), "phone")
        .otherwise(F.when(F.length(digits).between(8, 15), "phone_abroad"))
    )
    new = {"email": _email, "iban": _iban, "phone": _phone, "phone_abroad": _abroad, "ssn": _ssn, "date": _date, "ip": _ip, "ipv6": _ipv6, "card": _card}
    choose = lambda k: F.coalesce(*(F.when(k == name, f(text, key)) for name, f in new.items()), text)
    return _let(kind, lambda k: F.struct(k.alias("kind"), choose(k).alias("new")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (text among its columns; one named pii is replaced) with new text, and pii: the kinds found, in text order.

    ``key`` is the caller's secret: one key gives one mapping. A null text stays null (pii: empty), all else in a text
    stays to the byte. Numbers and dates that are not valid stay too. A digit run longer than its format is no match.
    """
    cols = [c for c in docs.columns if c != "pii"]
    some = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    none = F.array().cast("array<string>")
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("doc"), F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none).alias("matches"))
    out = out.withColumn("found", F.transform("matches", lambda m: _found(m, key)))
    gaps = F.split(F.col("doc.text"), ANY, -1)
    text = F.array_join(F.flatten(F.zip_with(gaps, F.col("found.new"), lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), "")
    text = F.when(F.size("matches") > 0, text).otherwise(F.col("doc.text"))
    kinds = F.filter("found.kind", lambda k: k.isNotNull())
    return out.select(*((text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in cols), kinds.alias("pii"))


#: The queries' key; a real run passes its own secret.
QUERY_KEY = "repolith-example-key"


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    n = lambda kind: F.size(F.filter("pii", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *map(n, PATTERNS))
