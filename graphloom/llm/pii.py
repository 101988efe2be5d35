"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

A value is validated, turned into digits (each with its own radix), permuted by a keyed Feistel network over the two
halves of those digits, and written back in its own format.  The permutation depends on the key and the kind alone:
equal values get equal pseudonyms in every document, different ones get different ones, and ``reverse`` gives the
values back.  Text that fails validation stays.

Kinds: e-mail local parts (letters and digits by class), IPv4 addresses, dates of 1900-2099, US social security
numbers, phone numbers (last ten digits), payment cards (Luhn check digit recomputed), hexadecimal secrets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The formats. Each starts where no word runs on, and runs are possessive, so long words cost one pass.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\w|[.-]\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w)"
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
HEX = r"(?<!\w)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?!\w)"
ANY = "|".join([EMAIL, IPV4, DATE, SSN, PHONE, CARD, HEX])
MAYBE = "[0-9]{2}|@|[0-9][.][0-9]|[0-9a-f]{32}"  # texts without it hold none of the formats: one alternative each at least
DATE_FORMATS = (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"))
DATE_RADIX = (17, 4297)  # 17 * 4297 days, all from 1900-01-01 to 2099-12-31
ROUNDS = 4
KINDS = ("email", "ipv4", "date", "ssn", "phone", "card", "secret")


def _half(half: Column, radix: Column, at, other: Column, key: str, turn: int, sign: int) -> Column:
    """One Feistel half-round: each digit moves by a keyed hash of the other half and its place."""
    seen = F.array_join(F.transform(other, lambda x: x.cast("string")), ",")

    def move(x: Column, i: Column, s: Column) -> Column:
        h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(f"{key}|{turn}"), s, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
        return F.pmod(x + sign * h, F.get(radix, i + at)).cast("int")

    return let(seen, lambda s: F.transform(half, lambda x, i: move(x, i, s)))


def feistel(digits: Column, radix: Column, key: str, reverse: bool = False) -> Column:
    """The permuted digits: an array of ints below their radixes, of any length, halves of any radixes."""
    cut = (F.size(digits) / 2).cast("int")

    def rounds(left: Column, right: Column, turns: list[int]) -> Column:
        if not turns:
            return F.concat(left, right)
        t, rest, sign = turns[0], turns[1:], -1 if reverse else 1
        if t % 2 == 0:
            return let(_half(left, radix, F.lit(0), right, key, t, sign), lambda new: rounds(new, right, rest))
        return let(_half(right, radix, F.size(left), left, key, t, sign), lambda new: rounds(left, new, rest))

    order = list(range(ROUNDS))[::-1] if reverse else list(range(ROUNDS))
    return let(F.slice(digits, F.lit(1), cut), lambda a: let(F.slice(digits, cut + 1, F.size(digits) - cut), lambda b: rounds(a, b, order)))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _ints(s: Column) -> Column:
    return F.transform(_chars(s), lambda c: c.cast("int"))


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _fill(form: Column, digits: Column) -> Column:
    """``form`` with its decimal digits replaced in turn."""
    put = lambda c, i: F.when(c.rlike("[0-9]"), F.get(digits, F.length(_only_digits(F.substring(form, F.lit(1), i)))).cast("string")).otherwise(c)
    return F.array_join(F.transform(_chars(form), put), "")


def _decimal(s: Column, keep_head: Column, key: str, reverse: bool) -> Column:
    """Digits of ``s`` after the first ``keep_head`` permuted."""

    def done(d: Column) -> Column:
        tail = F.slice(d, keep_head + 1, F.size(d) - keep_head)
        return F.concat(F.slice(d, F.lit(1), keep_head), let(tail, lambda v: feistel(v, F.transform(v, lambda x: F.lit(10)), key, reverse)))

    return let(_ints(_only_digits(s)), done)


def luhn_sum(d: Column) -> Column:
    """Luhn sum of an array of digits, the last one being undoubled."""
    n = F.size(d)
    one = lambda x, i: F.when((n - 1 - i) % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.transform(d, one), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str, reverse: bool) -> Column:
    def done(d: Column) -> Column:
        body = F.slice(d, F.lit(1), F.size(d) - 1)
        new = let(body, lambda v: feistel(v, F.transform(v, lambda x: F.lit(10)), key, reverse))
        full = let(new, lambda v: F.concat(v, F.array(F.pmod(-luhn_sum(F.concat(v, F.array(F.lit(0)))), F.lit(10)).cast("int"))))
        return F.when(luhn_sum(d) % 10 == 0, let(full, lambda v: _fill(m, v))).otherwise(m)

    return let(_ints(_only_digits(m)), done)


def _classed(s: Column, key: str, reverse: bool) -> Column:
    """Letters and digits permuted within their classes; other characters stay."""
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(F.ascii(c))
    span = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-zA-Z]"), 26).otherwise(1)

    def done(cs: Column) -> Column:
        v = F.transform(cs, lambda c: (F.ascii(c) - base(c)).cast("int"))
        new = let(v, lambda d: let(F.transform(cs, span), lambda r: feistel(d, r, key, reverse)))
        return F.array_join(let(new, lambda n: F.transform(cs, lambda c, i: F.char(F.get(n, i) + base(c)))), "")

    return let(_chars(s), done)


def _secret(m: Column, key: str, reverse: bool) -> Column:
    v = F.transform(_chars(m), lambda c: F.conv(c, 16, 10).cast("int"))
    new = let(v, lambda d: feistel(d, F.transform(d, lambda x: F.lit(16)), key, reverse))
    return F.array_join(F.transform(new, lambda x: F.lower(F.hex(x))), "")


def _ipv4(m: Column, key: str, reverse: bool) -> Column:
    def done(v: Column) -> Column:
        new = feistel(v, F.transform(v, lambda x: F.lit(256)), key, reverse)
        return F.when(F.exists(v, lambda x: x > 255), m).otherwise(F.array_join(F.transform(new, lambda x: x.cast("string")), "."))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), done)


def _date(m: Column, key: str, reverse: bool) -> Column:
    start = F.lit("1900-01-01").cast("date")

    def done(fmt: str) -> Column:
        def moved(n: Column) -> Column:
            v = F.array((n / DATE_RADIX[1]).cast("int"), (n % DATE_RADIX[1]).cast("int"))
            new = let(v, lambda d: feistel(d, F.array(*map(F.lit, DATE_RADIX)), key, reverse))
            day = let(new, lambda d: F.date_format(F.date_add(start, (F.get(d, F.lit(0)) * DATE_RADIX[1] + F.get(d, F.lit(1))).cast("int")), fmt))
            return F.when((n >= 0) & (n < DATE_RADIX[0] * DATE_RADIX[1]), day).otherwise(m)

        return F.coalesce(let(F.date_diff(F.try_to_timestamp(m, F.lit(fmt)).cast("date"), start), moved), m)

    return reduce(lambda rest, f: F.when(F.contains(m, F.lit(f[0])), done(f[1])).otherwise(rest), DATE_FORMATS, m)


def kind_of(m: Column) -> Column:
    """Which format a match has; matches are whole values, so the formats' ends do not matter here."""
    return (
        F.when(F.contains(m, F.lit("@")), "email").when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$"), "date").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^(\+|\()|^\d{3}[-.]\d{3}[-.]\d{4}$"), "phone").when(m.rlike("^[0-9 -]{13,19}$"), "card").otherwise("secret")
    )


def pseudonym(m: Column, key: str, reverse: bool = False) -> Column:
    """The pseudonym of one matched value, or the value itself where it is not valid."""
    k = lambda kind: f"{key}|{kind}"
    kind = kind_of(m)
    email = F.concat(_classed(F.substring_index(m, "@", 1), k("email"), reverse), F.lit("@"), F.substring_index(m, "@", -1))
    phone = _fill(m, _decimal(m, F.greatest(F.length(_only_digits(m)) - 10, F.lit(0)), k("phone"), reverse))
    by = {
        "email": email, "ipv4": _ipv4(m, k("ipv4"), reverse), "date": _date(m, k("date"), reverse), "ssn": _fill(m, _decimal(m, F.lit(0), k("ssn"), reverse)),
        "phone": phone, "card": _card(m, k("card"), reverse), "secret": _secret(m, k("secret"), reverse),
    }
    return let(kind, lambda w: reduce(lambda rest, x: F.when(w == x[0], x[1]).otherwise(rest), by.items(), m))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None, reverse: bool = False) -> DataFrame:
    """``docs`` with every valid value in ``text_col`` replaced; rows, order of columns and all other columns stay.

    ``found_col`` adds the changed values as an array of (kind, value, pseudonym); a column of that name is an error, as
    nothing is to be overwritten.  Null text stays null.  A text is cut
    around its matches, the matches are mapped, and both are joined again, so a text is read as a whole, once."""
    if found_col and found_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {found_col} already")
    t = F.col(text_col)
    taken = {c.lower() for c in docs.columns}
    tmp = next(n for i in range(len(taken) + 1) if (n := f"_pii{i}") not in taken)
    hits = F.when(t.rlike(MAYBE), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    with_hits = docs.withColumn(tmp, F.when(F.size(hits) > 0, F.transform(hits, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value"), pseudonym(m, key, reverse).alias("pseudonym")))))
    new = F.when(F.col(tmp).isNull(), t).otherwise(F.array_join(F.flatten(F.zip_with(F.split(t, ANY, -1), F.transform(F.col(tmp), lambda x: x["pseudonym"]), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""))
    out = with_hits.withColumn(text_col, new)
    if found_col:
        out = out.withColumn(found_col, F.filter(F.coalesce(F.col(tmp), F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")), lambda x: x["value"] != x["pseudonym"]))
    return out.drop(tmp)
