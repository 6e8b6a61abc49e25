"""Personal data replaced by pseudonyms of the same format.

Validated numbers and dates are mapped within their format by a keyed Feistel permutation: a
value is read as a pair of numbers, rounds add a keyed hash of one to the other modulo its range,
and the result is written back in the value's own layout. Equal values so become equal
pseudonyms in all texts, different ones stay different, and each is valid again: card numbers
keep a right check digit, phone numbers an area and exchange code, addresses four bytes, dates a
day of the calendar. Mail addresses and access keys have no finite range; their letters and
digits are replaced by a keyed hash, in the same layout.

All of it is column expressions: a text is split at the matches and joined with their pseudonyms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6

# Formats looked for, by kind; the first that matches at a place is taken.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:password|passwd|token|secret|api_key)\s?[=:]\s?\"?[A-Za-z0-9_\-]{8,128}\"?"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
DATE = r"(?<![\d-])(?:1[89]|20|21)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\d)|(?<![\d+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"
KINDS = {"email": EMAIL, "key": KEY, "secret": SECRET, "ip": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
# No text without one of these holds a match.
HINT = r"[0-9@=:]"
SPLIT = "|".join(KINDS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(digits: Column) -> Column:
    return F.coalesce(digits.cast("long"), F.lit(0).cast("long"))


def keyed(secret: str, *parts: Column) -> Column:
    """A number below 2^48 that nobody without the key can tell from chance."""
    text = F.concat_ws("|", F.lit(secret), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.sha2(text, 256)), 256), 1, 12), 16, 10).cast("long")


def feistel(x: Column, y: Column, of_x: Column, of_y: Column, secret: str, kind: str) -> Column:
    """A permutation of pairs below `(of_x, of_y)`, as `struct<x, y>`; the rounds are even in number."""
    start = F.struct(x.alias("x"), y.alias("y"), of_x.cast("long").alias("p"), of_y.cast("long").alias("q"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda s, i: F.struct(
            s["y"].alias("x"),
            F.pmod(s["x"] + F.pmod(keyed(secret, F.lit(kind), i, s["y"], s["p"], s["q"]), s["p"]), s["p"]).alias("y"),
            s["q"].alias("p"), s["p"].alias("q"),
        ),
    )


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second one from the right doubled, the last one plain."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
            i % 2 == 0, _number(c)
        ).otherwise(F.floor(_number(c) * 2 / 10) + (_number(c) * 2) % 10)),
        F.lit(0).cast("long"), lambda total, v: total + v,
    )


def _filled(layout: Column, digits: Column) -> Column:
    """The digits put in place of those of the layout, one after the other."""
    state = F.aggregate(
        F.split(layout, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return state["out"]


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _permuted(digits: Column, secret: str, kind: str) -> Column:
    """Digits of any number up to 30, permuted among those as many."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    pair = feistel(_number(F.substr(digits, F.lit(1), half)), _number(F.substr(digits, half + 1, rest)), _power(half), _power(rest), secret, kind)
    return let(pair, lambda p: F.concat(F.lpad(p["x"].cast("string"), half, "0"), F.lpad(p["y"].cast("string"), rest, "0")))


def _card(value: Column, secret: str) -> Column:
    """All digits but the last permuted, the last set so that the check holds."""
    body = let(digits_of(value), lambda d: _permuted(F.substr(d, F.lit(1), F.length(d) - 1), secret, "card"))
    return let(body, lambda b: _filled(value, F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))


def _phone(value: Column, secret: str) -> Column:
    """Ten last digits of a North American number; else all but the first two."""
    american = value.rlike(r"^(?:\+?1[ .-]?)?\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]?\d{4}$")

    def north(d: Column) -> Column:
        last = F.substr(d, F.length(d) - 9, F.lit(10))
        pair = feistel(_number(F.substr(last, F.lit(1), F.lit(3))) - 200, _number(F.substr(last, F.lit(4), F.lit(7))) - 2_000_000,
                       F.lit(800), F.lit(8_000_000), secret, "phone")
        written = let(pair, lambda p: F.concat((p["x"] + 200).cast("string"), (p["y"] + 2_000_000).cast("string")))
        return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), written)

    other = lambda d: F.concat(F.substr(d, F.lit(1), F.lit(2)), _permuted(F.substr(d, F.lit(3), F.length(d) - 2), secret, "phone"))
    return F.when(american, let(digits_of(value), lambda d: _filled(value, north(d)))).otherwise(
        let(digits_of(value), lambda d: _filled(value, other(d)))
    )


def _ip(value: Column, secret: str) -> Column:
    parts = F.transform(F.split(value, r"\."), _number)
    pair = let(parts, lambda v: feistel(v[0] * 256 + v[1], v[2] * 256 + v[3], F.lit(65536), F.lit(65536), secret, "ip"))
    byte = lambda n, high: (F.floor(n / 256) if high else n % 256).cast("string")
    return let(pair, lambda p: F.concat_ws(".", byte(p["x"], True), byte(p["x"], False), byte(p["y"], True), byte(p["y"], False)))


def _ssn(value: Column, secret: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    def moved(d: Column) -> Column:
        area = _number(F.substr(d, F.lit(1), F.lit(3)))
        x = F.when(area > 666, area - 2).otherwise(area - 1)
        y = (_number(F.substr(d, F.lit(4), F.lit(2))) - 1) * 9999 + _number(F.substr(d, F.lit(6), F.lit(4))) - 1
        return feistel(x, y, F.lit(898), F.lit(99 * 9999), secret, "ssn")

    area = lambda n: F.when(n >= 665, n + 2).otherwise(n + 1)
    return let(let(digits_of(value), moved), lambda p: F.concat_ws(
        "-", F.lpad(area(p["x"]).cast("string"), 3, "0"), F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"),
        F.lpad((p["y"] % 9999 + 1).cast("string"), 4, "0"),
    ))


# Days that change places with one another: 128 times 229, about eighty years.
_DAYS = (128, 229)


def _date(value: Column, secret: str) -> Column:
    """A day within the same eighty years or so, counted from 1800."""
    span = _DAYS[0] * _DAYS[1]

    def moved(day: Column) -> Column:
        within = F.pmod(day, F.lit(span)).cast("long")
        pair = feistel(F.floor(within / _DAYS[1]), within % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), secret, "date")
        return let(pair, lambda p: F.date_add(F.lit("1800-01-01").cast("date"), (day - within + p["x"] * _DAYS[1] + p["y"]).cast("int")))

    day = F.date_diff(F.try_to_date(value, "yyyy-MM-dd"), F.lit("1800-01-01").cast("date"))
    return F.when(day.isNull(), value).otherwise(let(day, moved).cast("string"))


def _spelled(value: Column, secret: str, kind: str) -> Column:
    """Letters and digits replaced by a keyed hash of the whole; hexadecimal stays so."""
    stream = let(keyed(secret, F.lit(kind), value), lambda seed: F.transform(
        F.split(value, ""), lambda c, i: let(
            keyed(secret, seed, i),
            lambda n: F.when(c.rlike("^[0-9]$"), (n % 10).cast("string"))
            .when(c.rlike("^[a-f]$"), F.substr(F.lit("abcdef"), (n % 6 + 1).cast("int"), F.lit(1)))
            .when(c.rlike("^[g-z]$"), F.substr(F.lit("ghijklmnopqrstuvwxyz"), (n % 20 + 1).cast("int"), F.lit(1)))
            .when(c.rlike("^[A-Z]$"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n % 26 + 1).cast("int"), F.lit(1)))
            .otherwise(c),
        )))
    return F.array_join(stream, "")


def _email(value: Column, secret: str) -> Column:
    """Everything before the last label of the domain."""
    return F.concat(_spelled(F.regexp_extract(value, r"^(.*\.)([A-Za-z]+)$", 1), secret, "email"), F.regexp_extract(value, r"^(.*\.)([A-Za-z]+)$", 2))


def _secret(value: Column, secret: str) -> Column:
    """The value after the name and its sign."""
    layout = r"^([a-z_]+\s?[=:]\s?\"?)(.*)$"
    return F.concat(F.regexp_extract(value, layout, 1), _spelled(F.regexp_extract(value, layout, 2), secret, "secret"))


def kind_of(value: Column) -> Column:
    """The kind of a match, NULL for a number that only looks like one."""
    whole = lambda name: value.rlike("^(?:" + KINDS[name] + ")$")
    card = let(digits_of(value), lambda d: luhn_sum(d) % 10 == 0)
    return (
        F.when(F.contains(value, F.lit("@")), "email").when(value.startswith("AKIA"), "key")
        .when(value.rlike("^[a-z]"), "secret").when(whole("ip"), "ip").when(whole("date"), F.when(F.try_to_date(value, "yyyy-MM-dd").isNotNull(), "date"))
        .when(whole("ssn"), "ssn").when(whole("phone"), F.when(F.length(digits_of(value)).between(7, 15), "phone"))
        .when(card, "card")
    )


def pseudonym(value: Column, kind: Column, secret: str) -> Column:
    """The value's stand-in; the value itself where it is of no kind."""
    return (
        F.when(kind == "email", _email(value, secret)).when(kind == "key", F.concat(F.lit("AKIA"), _spelled(F.substring(value, 5, 16), secret, "key")))
        .when(kind == "secret", _secret(value, secret)).when(kind == "ip", _ip(value, secret)).when(kind == "date", _date(value, secret))
        .when(kind == "ssn", _ssn(value, secret)).when(kind == "phone", _phone(value, secret)).when(kind == "card", _card(value, secret))
        .otherwise(value)
    )


def pseudonymised(df: DataFrame, secret: str, text: str = "text", found: str = "pii_kinds") -> DataFrame:
    """The table with its texts rewritten, and the kinds found in order of place.

    A NULL text stays NULL, an empty one empty, both without kinds; texts without personal data
    stay as they are to the character. Repeated rows are rewritten alike. Other columns stay,
    one named as `found` is replaced. An empty table stays empty.
    """
    if not secret:
        raise ValueError("pseudonyms need a secret")
    t = df[text]
    hits = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(SPLIT), F.lit(0))).otherwise(F.array().cast("array<string>"))
    made = F.transform(hits, lambda v: let(kind_of(v), lambda k: F.struct(k.alias("kind"), pseudonym(v, k, secret).alias("value"))))
    names = ("__pii_made", "__pii_text")
    step = df.withColumn(names[0], F.coalesce(made, F.array().cast("array<struct<kind:string,value:string>>")))
    joined = F.array_join(F.flatten(F.zip_with(
        F.split(F.col(text), SPLIT, -1), F.col(names[0]), lambda between, m: F.array(F.coalesce(between, F.lit("")), F.coalesce(m["value"], F.lit("")))
    )), "")
    step = step.withColumn(text, F.when(F.size(names[0]) > 0, joined).otherwise(F.col(text)))
    return step.withColumn(found, F.filter(F.transform(names[0], lambda m: m["kind"]), lambda k: k.isNotNull())).drop(*names)
