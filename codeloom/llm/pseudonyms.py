"""Format-preserving pseudonyms for personal numbers and dates, by DataFrame functions only.

Card numbers, phone numbers, IPv4 addresses, social security numbers, account numbers (IBAN), e-mail addresses
and calendar dates are found by pattern, validated, and permuted within their format by a keyed Feistel
network, a permutation of the values of each format. So a value has one pseudonym everywhere, different
values stay different, and the signs between the digits stay where they are.

* card (13 to 19 digits, Luhn): all digits but the last are permuted, the last is the new check digit.
* ip: the 32 bits are permuted. * ssn: the valid numbers are permuted among themselves (no area 000, 666 or 9xx, no
  group 00, no serial 0000). * iban (mod 97 = 1): the last 10 characters are permuted, digits among
  digits and letters among letters, and the two check digits anew. * phone: the last 9 digits.
* date (1900 to 2099, ISO, day.month.year or month/day/year): the 73,049 days are permuted.
* email: letters of the local part are permuted among letters and digits among digits, small and capital letters and other
  signs staying where they are; the domain stays.

A permutation can be undone with its key, so the key is a secret: there is no default. Equal values of a kind, ties and
repeated rows get equal pseudonyms.

Each text is rewritten alone and whole; nothing is shuffled. Null texts stay null, empty texts empty. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import pieces_and_matches

ROUNDS = 8

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d)"
DATE = r"(?<!\d)(?:(?:19|20)\d\d-\d\d-\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
#: Cheap test: every pattern needs one of these signs.
NEEDS = "[@0-9]"
FOUND = "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, SSN, IBAN, PHONE, CARD))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _number(key: str, what: Column, modulus: Column) -> Column:
    """A keyed number below the modulus (at most 10**10)."""
    digest = F.sha2(F.concat(F.lit(key + "|"), what), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(key: str, left: Column, right: Column, left_size: Column, right_size: Column, tweak: str) -> Column:
    """struct(left, right): a permutation of the pairs below the sizes; an even number of rounds keeps the sides."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def one(state: Column, r: Column) -> Column:
        size = F.when(r % 2 == 0, left_size).otherwise(right_size)
        shift = _number(key, F.concat_ws("|", F.lit(tweak), left_size.cast("string"), right_size.cast("string"), r.cast("string"), state["b"].cast("string")), size)
        return F.struct(state["b"].alias("a"), F.pmod(state["a"] + shift, size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one)


def permute_digits(key: str, digits: Column, tweak: str) -> Column:
    """A permutation of the digit strings of each length from 2 to 18."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    power = lambda x: F.pow(F.lit(10.0), x).cast("long")
    state = feistel(key, digits.substr(F.lit(1), u), digits.substr(u + 1, n), power(u), power(n - u), tweak)
    return F.concat(F.lpad(state["a"].cast("string"), u, "0"), F.lpad(state["b"].cast("string"), n - u, "0"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the rightmost not doubled."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(each, lambda x: x != ""), lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def refill(value: Column, digits: Column, sign: str = "^[0-9]$") -> Column:
    """value with its digits (or other signs) replaced, in order, by other ones."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        digit = F.rlike(c, F.lit(sign))
        return F.struct(
            (state["at"] + F.when(digit, 1).otherwise(0)).alias("at"),
            F.concat(state["out"], F.when(digit, digits.substr(state["at"], F.lit(1))).otherwise(c)).alias("out"),
        )

    return F.aggregate(chars, start, step, lambda s: s["out"])


def _card(key: str, value: Column) -> Column:
    body = permute_digits(key, _digits(value).substr(F.lit(1), F.length(_digits(value)) - 1), "card")
    check = F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return refill(value, F.concat(body, check))


def _ip(key: str, value: Column) -> Column:
    part = lambda k: F.split(value, r"\.")[k].cast("long")
    half = F.lit(65536).cast("long")
    s = feistel(key, part(0) * 256 + part(1), part(2) * 256 + part(3), half, half, "ip")
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)])


def _phone(key: str, value: Column) -> Column:
    digits = _digits(value)
    keep = F.greatest(F.length(digits) - 9, F.lit(0))
    return refill(value, F.concat(digits.substr(F.lit(1), keep), permute_digits(key, digits.substr(keep + 1, F.length(digits)), "phone")))


def _letters_as_numbers(value: Column) -> Column:
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(F.rlike(c, F.lit("[A-Z]")), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def _mod97(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def _iban_rest(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def _iban_valid(value: Column) -> Column:
    plain = _iban_rest(value)
    return F.length(plain).between(15, 34) & (_mod97(_letters_as_numbers(F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4)))) == 1)


def _signs(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _radix(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit("[0-9]")), 10).otherwise(26).cast("long")


def _as_number(value: Column) -> Column:
    """Digits and capitals as a number, each place over its own alphabet."""
    place = lambda c: F.ascii(c) - F.when(F.rlike(c, F.lit("[0-9]")), 48).otherwise(65)
    return F.aggregate(_signs(value), F.lit(0).cast("long"), lambda a, c: a * _radix(c) + place(c))


def _as_signs(number: Column, like: Column) -> Column:
    """_as_number backwards; like: a text with the same alphabets."""
    start = F.struct(number.alias("left"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        at = F.pmod(state["left"], _radix(c))
        sign = F.char(at + F.when(F.rlike(c, F.lit("[0-9]")), 48).otherwise(65))
        return F.struct(F.floor((state["left"] - at) / _radix(c)).cast("long").alias("left"), F.concat(sign, state["out"]).alias("out"))

    return F.aggregate(F.reverse(_signs(like)), start, step, lambda s: s["out"])


def permute_signs(key: str, signs: Column, tweak: str) -> Column:
    """A permutation of the texts of 10 digits and capitals that have them at the same places; of digits, that of permute_digits."""
    a, b = signs.substr(1, 5), signs.substr(6, 5)
    size = lambda v: F.aggregate(_signs(v), F.lit(1).cast("long"), lambda n, c: n * _radix(c))
    state = feistel(key, _as_number(a), _as_number(b), size(a), size(b), tweak)
    return F.concat(_as_signs(state["a"], a), _as_signs(state["b"], b))


def _iban(key: str, value: Column) -> Column:
    plain = _iban_rest(value)
    n = F.length(plain)
    country, body = plain.substr(1, 2), F.concat(plain.substr(F.lit(5), n - 14), permute_signs(key, plain.substr(n - 9, F.lit(10)), "iban"))
    check = F.lpad((98 - _mod97(_letters_as_numbers(F.concat(body, country, F.lit("00"))))).cast("string"), 2, "0")
    return refill(value, F.concat(country, check, body), "^[A-Z0-9]$")


def _date_of(value: Column) -> Column:
    """The date, or null if there is no such day."""
    p = lambda k, n: value.substr(k, n)
    iso = F.when(F.rlike(value, F.lit("^....-")), value).when(F.rlike(value, F.lit(r"^..\.")), F.concat_ws("-", p(7, 4), p(4, 2), p(1, 2))).otherwise(F.concat_ws("-", p(7, 4), p(1, 2), p(4, 2)))
    return F.try_to_date(iso, "yyyy-MM-dd")


#: Days from 1900 to 2099 as the product of two numbers, and the first as days since 1970.
DAYS = (17, 4297)
FIRST_DAY = -25567


def _date(key: str, value: Column) -> Column:
    sizes = [F.lit(n).cast("long") for n in DAYS]
    number = F.unix_date(_date_of(value)) - FIRST_DAY
    s = feistel(key, (number / DAYS[1]).cast("long"), F.pmod(number, F.lit(DAYS[1])), *sizes, "date")
    new = F.date_from_unix_date((s["a"] * DAYS[1] + s["b"] + FIRST_DAY).cast("int"))
    return (
        F.when(F.rlike(value, F.lit("^....-")), F.date_format(new, "yyyy-MM-dd"))
        .when(F.rlike(value, F.lit(r"^..\.")), F.date_format(new, "dd.MM.yyyy"))
        .otherwise(F.date_format(new, "MM/dd/yyyy"))
    )


#: Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = (value.substr(*x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    s = feistel(key, place * GROUPS + group - 1, serial - 1, F.lit(AREAS * GROUPS).cast("long"), F.lit(SERIALS).cast("long"), "ssn")
    new = F.floor(s["a"] / GROUPS)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat_ws("-", pad(new + F.when(new >= 665, 2).otherwise(1), 3), pad(F.pmod(s["a"], F.lit(GROUPS)) + 1, 2), pad(s["b"] + 1, 4))


def _sign_size(c: Column) -> Column:
    """How many signs a character may become: ten digits, 26 letters, itself alone."""
    return F.when(F.rlike(c, F.lit("^[0-9]$")), 10).when(F.rlike(c, F.lit("^[a-z]$")), 26).otherwise(1)


def _email(key: str, value: Column) -> Column:
    """The halves of the local part shift each other in turn, character by character, each within its own alphabet."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    low = F.lower(local)
    half = F.floor(F.length(low) / 2).cast("int")
    form = F.regexp_replace(F.regexp_replace(low, "[0-9]", "0"), "[a-z]", "a")
    start = F.struct(low.substr(F.lit(1), half).alias("a"), low.substr(half + 1, F.length(low)).alias("b"))

    def shifted(signs: Column, by: Column, r: Column) -> Column:
        # 32 bytes, as many as a half may have characters
        stream = F.sha2(F.concat_ws("|", F.lit(f"{key}|email"), F.lower(domain), form, r.cast("string"), by), 256)

        def one(c: Column, i: Column) -> Column:
            first = F.when(F.rlike(c, F.lit("[0-9]")), 48).otherwise(97)
            moved = F.pmod(F.ascii(c) - first + F.conv(stream.substr(2 * i + 1, F.lit(2)), 16, 10).cast("int"), _sign_size(c))
            return F.when(_sign_size(c) > 1, F.char(moved + first)).otherwise(c)

        return F.array_join(F.transform(_signs(signs), one), "")

    def round_(state: Column, r: Column) -> Column:
        return F.struct(F.when(r % 2 == 0, shifted(state["a"], state["b"], r)).otherwise(state["a"]).alias("a"), F.when(r % 2 == 1, shifted(state["b"], state["a"], r)).otherwise(state["b"]).alias("b"))

    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda s: F.concat(s["a"], s["b"]))
    cased = F.zip_with(_signs(local), _signs(new), lambda old, c: F.when(F.rlike(old, F.lit("[A-Z]")), F.upper(c)).otherwise(c))
    return F.concat(F.array_join(cased, ""), F.lit("@"), domain)


def kind_of(value: Column) -> Column:
    """The kind of a match, or null if it isn't valid."""
    is_ = lambda p: F.rlike(value, F.lit(_whole(p)))
    octets = F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    digits = _digits(value)
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(F.rlike(value, F.lit(r"^[0-9]+(\.[0-9]+){3}$")), F.when(octets, "ip"))
        .when(F.rlike(value, F.lit(r"^(\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})$")), F.when(_date_of(value).isNotNull(), "date"))
        .when(F.rlike(value, F.lit(r"^\d{3}-\d{2}-\d{4}$")), F.when(~F.rlike(value, F.lit("^(000|666|9..)|-00-|-0000$")), "ssn"))
        .when(F.rlike(value, F.lit("^[A-Z]")), F.when(_iban_valid(value), "iban"))
        .when(is_(PHONE.replace(r"(?<![\w+])", "").replace(r"(?!\d)", "")), F.when(F.length(digits).between(9, 15), "phone"))
        .when(is_(CARD.replace(r"(?<!\d)", "").replace(r"(?!\d)", "")), F.when(_luhn_sum(digits) % 10 == 0, "card"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "card", _card(key, value))
        .when(kind == "ip", _ip(key, value))
        .when(kind == "phone", _phone(key, value))
        .when(kind == "email", _email(key, value))
        .when(kind == "date", _date(key, value))
        .when(kind == "ssn", _ssn(key, value))
        .when(kind == "iban", _iban(key, value))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, how many numbers, dates, e-mail addresses and values of all kinds were replaced, and the new text of each document. key: a secret of the caller."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("text").cast("string")
    pieces, matches = pieces_and_matches(text, FOUND)
    hit = F.regexp_like(text, F.lit(NEEDS)) & F.regexp_like(text, F.lit(FOUND))
    kinds = "array<struct<value:string,kind:string>>"
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.when(hit, pieces).alias("pieces"),
        F.when(hit, F.transform(matches, lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))).otherwise(F.array().cast(kinds)).alias("found"),
    )
    n = lambda test: F.size(F.filter("found", lambda x: test(x["kind"]))).cast("long")
    new = F.array_join(F.transform(F.arrays_zip("pieces", F.transform("found", lambda x: pseudonym(x["value"], x["kind"], key)).alias("new")), lambda x: F.concat(x["pieces"], F.coalesce(x["new"], F.lit("")))), "")
    return found.select(
        "doc_id",
        n(lambda k: k.isin("card", "ip", "phone", "ssn", "iban")).alias("n_numbers"),
        n(lambda k: k == "date").alias("n_dates"),
        n(lambda k: k == "email").alias("n_emails"),
        n(lambda k: k.isNotNull()).alias("n_replaced"),
        F.when(F.col("pieces").isNotNull(), new).otherwise(F.col("text")).alias("text"),
    )
