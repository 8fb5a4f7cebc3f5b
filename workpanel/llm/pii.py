"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates; each is validated (Luhn for cards, mod 97 for
bank accounts, the calendar for dates, octets for addresses ...) and, if it
holds, replaced by a keyed permutation of itself within its format: a Feistel
network over the two halves of its domain.  The permutation is one-to-one, so
equal values stay equal across documents and different ones stay different.
A candidate that fails its check stays as it is.  E-mail names and secret
tokens, which are no numbers, become keyed digests of the same kind (e-mail: 60 bits,
so among 10^9 addresses about one pair in two such corpora would meet; secrets: any length, dots included).

One-to-one within a format: cards, accounts (printed in groups or not), numbers, addresses.
Dates keep their written form, and equal dates stay equal in every form; ``03/04/2000`` is read
day first.  Days 1 to 12 and days 13 to 31 are permuted among themselves, so a date that only
reads month first still does, and no two dates meet across the two readings.

What stays readable: dates outside 1901-01-01 to 2100-08-04, IPv6 addresses, telephone
numbers with blanks alone and no country's code (``555 123 4567``), compact or printed
accounts in lower case, and whatever has no form above (names, postal addresses).

Defined cases: a null text stays null, an empty one empty; repeated rows, an
empty table and other columns go through, whatever their names; a column named like the count
output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workpanel.llm.common import unused

ROUNDS = 10
#: Steps in which a date finds another on its side of day 12; fewer than 10^-13 would need more.
WALK = 64
#: Dates permuted: FIRST_DAY and the SIDE * SIDE - 1 days after it (to 2100-08-04).
FIRST_DAY, SIDE = "1901-01-01", 270

# The formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = (r"(?<![A-Za-z0-9])(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)"
          r"\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{16}[A-Za-z0-9_+/.-]*(?<=[A-Za-z0-9_+/-])")
# printed in groups of four: those after the bank's have a digit, so that words in capitals are none
IBAN = (r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|[A-Z]{2}\d{2} [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}"
        r"(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)"
DATE = r"(?<![\w.])(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})(?:(?!\w)|(?=T\d{2}:\d{2}))"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = (r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}"
         r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])")
CARD = r"(?<!\w)(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?)(?!\w)"
KINDS = {"secret": SECRET, "email": EMAIL, "iban": IBAN, "ip": IPV4, "date": DATE, "ssn": SSN,
         "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def prf(key: str, *parts: Column) -> Column:
    """A keyed pseudo-random long of 60 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, radix_a: Column, radix_b: Column, tweak: Column, key: str) -> Column:
    """A permutation of the pairs (a, b), 0 <= a < radix_a and 0 <= b < radix_b, as struct ``x, y``."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"),
                     radix_a.cast("long").alias("p"), radix_b.cast("long").alias("q"))

    def turn(s: Column, i: Column) -> Column:
        mixed = F.pmod(s["x"] + F.pmod(prf(key, tweak, i.cast("string"), s["y"].cast("string")), s["p"]), s["p"])
        return F.struct(s["y"].alias("x"), mixed.alias("y"), s["q"].alias("p"), s["p"].alias("q"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """A string of 2 to 36 digits to another of the same length, one-to-one."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    s = feistel(F.substr(digits, F.lit(1), u), F.substr(digits, u + 1), power(u), power(n - u),
                F.concat_ws("|", F.lit(kind), n.cast("string")), key)
    return F.concat(F.lpad(s["x"].cast("string"), u, "0"), F.lpad(s["y"].cast("string"), n - u, "0"))


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""
    filled = F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(
            F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))))
    return filled["out"]


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn_sum(digits: Column, doubled_parity: int) -> Column:
    """The Luhn sum; positions from the right (0 first) with this parity count double."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == doubled_parity, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda s, x: s + x)


def card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
    check = F.pmod(-luhn_sum(body, 0), F.lit(10)).cast("string")
    return F.when(F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0) & ~d.rlike(r"^0+$"), refill(m, F.concat(body, check)))


def mod97(account: Column) -> Column:
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0).cast("long"), lambda s, c: F.when(
        c.rlike(r"^\d$"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def iban(m: Column, key: str) -> Column:
    tail = F.substr(m, F.lit(5))
    inner = digits_of(tail)
    fresh = refill(tail, permuted_digits(inner, "iban", key))
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    blank = F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lit("00"), plain(fresh))
    check = F.lpad((98 - mod97(blank)).cast("string"), 2, "0")
    return F.when((mod97(plain(m)) == 1) & (F.length(inner) >= 2), F.concat(F.substr(m, F.lit(1), F.lit(2)), check, fresh))


def ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    at = lambda k: F.get(o, F.lit(k))
    s = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    parts = [F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256]
    return F.when(F.forall(o, lambda x: x <= 255), F.concat_ws(".", *[p.cast("long").cast("string") for p in parts]))


def date(m: Column, key: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")

    def permuted(n: Column) -> Column:
        s = feistel(F.floor(n / SIDE), n % SIDE, F.lit(SIDE), F.lit(SIDE), F.lit("date"), key)
        return (s["x"] * SIDE + s["y"]).cast("int")

    def late(n: Column) -> Column:
        return F.dayofmonth(F.date_add(first, n)) > 12

    def moved(day: Column, form: str) -> Column:
        n = F.datediff(day, first)
        fresh = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permuted(n), lambda k, _: F.when(late(k) == late(n), k).otherwise(permuted(k)))
        return F.when(n.between(0, SIDE * SIDE - 1), F.date_format(F.date_add(first, fresh), form))

    out = None
    # a day that exists in the calendar, in the first form that reads it
    for form, shape in (("yyyy-MM-dd", r"^\d{4}-"), ("dd/MM/yyyy", r"^\d\d/\d\d/"), ("MM/dd/yyyy", r"^\d\d/\d\d/"),
                        ("dd.MM.yyyy", r"^\d\d\.\d\d\.")):
        day = F.when(m.rlike(shape), F.try_to_timestamp(m, F.lit(form)).cast("date"))
        read = F.when(day.isNotNull(), moved(day, form))
        out = read if out is None else F.coalesce(out, read)
    return out


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99 and serials 0001 to 9999, permuted among themselves."""
    area, group, serial = [F.regexp_extract(m, r"^(\d+)-(\d+)-(\d+)$", k).cast("long") for k in (1, 2, 3)]
    s = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
    padded = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    fresh = F.concat_ws("-", padded(s["x"] + 1 + (s["x"] >= 665).cast("int"), 3), padded(F.floor(s["y"] / 9999) + 1, 2),
                        padded(s["y"] % 9999 + 1, 4))
    return F.when(~m.rlike(r"^(000|666|9\d\d)|-00-|-0000$"), fresh)


def phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-])|\+\d)?", 1)  # the country's code stays
    rest = F.substr(m, F.length(head) + 1)
    d = digits_of(rest)
    return F.when(F.length(digits_of(m)).between(8, 15) & (F.length(d) >= 6), F.concat(head, refill(rest, permuted_digits(d, "phone", key))))


def email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user"), F.lpad(prf(key, F.lit("email"), F.lower(m)).cast("string"), 19, "0"), F.lit("@mail.invalid"))


def secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(.*?[=:]\s*[\"']?)[A-Za-z0-9_+/.-]+$", 1)
    value = F.substr(m, F.length(head) + 1)
    seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 128).cast("int")),
                         lambda k: F.sha2(F.concat_ws("|", F.lit(key), seed, k.cast("string")), 512))
    return F.concat(head, F.substr(F.array_join(blocks, ""), F.lit(1), F.length(value)))


MAKERS = {"secret": secret, "email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}


def pseudonym(m: Column, key: str) -> Column:
    """The candidate's pseudonym, or null when it fails its check."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        # lookarounds see only the candidate here, which is what they allow
        out = F.when(m.rlike(f"^(?:{pattern})$"), MAKERS[kind](m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count: str | None = "n_pseudonyms") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; ``count``: how many values were."""
    was, now = unused(docs, "_found"), unused(docs, "_made")
    found = docs.withColumn(was, F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0)))
    made = found.withColumn(now, F.transform(was, lambda m: pseudonym(m, key)))
    between = F.split(F.col(text_col), ANY, -1)
    texts = F.zip_with(between, F.zip_with(was, now, lambda m, p: F.coalesce(p, m)),
                       lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    out = made.withColumn(text_col, F.when(F.size(was) == 0, F.col(text_col)).otherwise(F.array_join(texts, "")))
    if count:
        out = out.withColumn(count, F.coalesce(F.size(F.filter(now, lambda p: p.isNotNull())), F.lit(0)).cast("long"))
    return out.drop(was, now)
