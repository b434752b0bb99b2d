"""Operator 8: format-preserving pseudonyms for personal data.

Found and validated: e-mail addresses, IPv4 addresses (each part up to 255), telephone
numbers, payment-card numbers (13 to 19 digits in a usual grouping, Luhn check), social-security
numbers (area, group and serial in use), international bank account numbers (mod 97), and
calendar dates (the day must exist; read day-first, or month-first where only that gives a day).
Their digits, or for dates the day number in 1900..2099, are permuted by a keyed Feistel
network of ROUNDS rounds, so that the format stays, equal values get equal pseudonyms
wherever they stand, and different values different ones. Cards and bank accounts get new
check digits; dates walk the cycle until they fall into the range, and form, again. Digits that
look like a card but fail its check stay as they are, and no other kind takes parts of them.

Letters of e-mail addresses are permuted, as lower-case, in the same way as base-26 digits;
their case stays. Addresses of reserved networks may come out of ordinary ones.

All columns are built-in functions; nothing is shuffled, so a value that a third of all
rows hold costs what any other does. The round function is a keyed SHA-256 prefix. The key
comes to the tasks as a one-row table, which is broadcast, so it isn't in plans or logs.

Cases: null text stays null; an empty text stays empty; overlapping finds go to the kind
named first; repeated rows get equal results; extra columns are kept; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import SPAN, find_spans, replaced
from tessera.llm.spans import let as _let

ROUNDS = 8
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# Fixed patterns, in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "date": r"(?<![0-9])(?:(?:19|20)[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
    # without separators, in other groups after a country code, or with the area in brackets only
    r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{1,4}\)?){2,7}(?![0-9])"
    r"|(?<![0-9A-Za-z])\([0-9]{2,4}\)[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
KINDS = list(PATTERNS)
NONE = -1
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"


def _round(key: Column, n, half: Column, below: Column) -> Column:
    """A keyed number below a bound, from 15 hexadecimal digits of SHA-256."""
    h = F.sha2(F.concat(key, F.lit("|"), F.lit(n).cast("string"), F.lit("|"), below.cast("string"), F.lit("|"), half.cast("string")), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % below


def feistel(x: Column, left: Column, right: Column, key: Column) -> Column:
    """A keyed permutation of pairs (a, b) with a below left and b below right.

    Rounds alternate between the halves, each adding a keyed function of the other, so their
    sizes may differ.
    """

    def step(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        a = F.when(even, (s["a"] + _round(key, n, s["b"], left)) % left).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise((s["b"] + _round(key, n, s["a"], right)) % right)
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), x, step)


def _sub(key: Column, name: str) -> Column:
    return F.concat(key, F.lit(f"|{name}"))


def _power(radix: int, size: Column) -> Column:
    return F.pow(F.lit(float(radix)), size).cast("long")


def permute_digits(digits: Column, key: Column) -> Column:
    """A keyed permutation of the digit strings of each length (up to 36 digits); '' stays."""
    n = F.length(digits)

    def body(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        a = F.coalesce(F.substring(d, F.lit(1), left).try_cast("long"), F.lit(0).cast("long"))
        b = F.coalesce(F.substring(d, left + 1, right).try_cast("long"), F.lit(0).cast("long"))
        out = feistel(F.struct(a.alias("a"), b.alias("b")), _power(10, left), _power(10, right), key)
        return _let(out, lambda s: F.concat(F.when(left > 0, F.lpad(s["a"].cast("string"), left, "0")).otherwise(""), F.lpad(s["b"].cast("string"), right, "0")))

    return F.when(n == 0, digits).otherwise(_let(digits, body))


def permute_letters(word: Column, key: Column) -> Column:
    """A keyed permutation of lower-case words: in groups of up to 10 letters, as base-26 numbers."""

    def body(w: Column) -> Column:
        groups = F.regexp_extract_all(w, F.lit("[a-z]{1,10}"), F.lit(0))

        def group(g: Column) -> Column:
            left = F.floor(F.length(g) / 2).cast("int")
            right = F.length(g) - left
            number = lambda t: F.aggregate(
                F.filter(F.split(t, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + (F.ascii(c) - 97)
            )
            x = F.struct(number(F.substring(g, F.lit(1), left)).alias("a"), number(F.substring(g, left + 1, right)).alias("b"))
            text = lambda v, size: F.reverse(
                F.aggregate(
                    F.filter(F.sequence(F.lit(0), size), lambda i: i < size),
                    F.struct(v.alias("v"), F.lit("").alias("t")),
                    lambda acc, _: F.struct(
                        F.floor(acc["v"] / 26).cast("long").alias("v"), F.concat(acc["t"], F.char(acc["v"] % 26 + 97)).alias("t")
                    ),
                    lambda acc: acc["t"],
                )
            )
            return _let(feistel(x, _power(26, left), _power(26, right), key), lambda s: F.concat(text(s["a"], left), text(s["b"], right)))

        return F.array_join(F.transform(groups, group), "")

    return F.when(F.length(word) == 0, word).otherwise(_let(word, body))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _put_back(value: Column, digits: Column, inside: str = "[0-9]") -> Column:
    """value with its digits (characters of the class) replaced, one by one, by others."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        F.filter(F.split(value, ""), lambda c: c != ""),
        start,
        lambda acc, c: F.struct(
            F.when(c.rlike(inside), acc["at"] + 1).otherwise(acc["at"]).alias("at"),
            F.concat(acc["out"], F.when(c.rlike(inside), F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is its check digit."""
    return F.aggregate(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda acc, c: F.struct(
            (acc["i"] + 1).alias("i"),
            (
                acc["s"]
                + F.when(acc["i"] % 2 == 0, c.cast("int"))
                .when(c.cast("int") > 4, c.cast("int") * 2 - 9)
                .otherwise(c.cast("int") * 2)
            ).alias("s"),
        ),
        lambda acc: acc["s"],
    )


def card(value: Column, key: Column) -> Column:
    """All digits but the last are permuted; the last keeps the Luhn check as it was (its
    difference from a valid check digit stays the same), so this is a permutation."""

    def body(d: Column) -> Column:
        lead = F.substring(d, F.lit(1), F.length(d) - 1)
        # what the last digit lacks to make the sum a multiple of ten
        lack = (luhn_sum(d)) % 10
        moved = permute_digits(lead, key)
        return _let(moved, lambda m: F.concat(m, ((lack + 10 - luhn_sum(F.concat(m, F.lit("0"))) % 10) % 10).cast("string")))

    return _put_back(value, _let(_digits(value), body))


def _iso(value: Column) -> Column:
    return F.substring(value, 5, 1).isin("-", "/")


def _day(value: Column) -> Column:
    parts = F.regexp_replace(value, "[./]", "-")
    found = F.when(_iso(value), F.try_to_date(parts, "yyyy-MM-dd")).otherwise(
        F.coalesce(F.try_to_date(parts, "dd-MM-yyyy"), F.when(_month_first(value), F.try_to_date(parts, "MM-dd-yyyy")))
    )
    return F.when(found.between(FIRST_DAY, LAST_DAY), found)


def _month_first(value: Column) -> Column:
    """A date with slashes that has no day when read day-first."""
    return (F.substring(value, 3, 1) == "/") & (F.substring(value, 4, 2) > "12")


def _first() -> Column:
    return F.lit(FIRST_DAY).cast("date")


def _any_day(day: Column, key: Column) -> Column:
    """The day's number within FIRST_DAY..LAST_DAY, permuted: there are 17 x 4297 of them."""
    v = F.datediff(day, _first()).cast("long")
    s = F.struct(F.floor(v / 4297).cast("long").alias("a"), (v % 4297).alias("b"))
    out = feistel(s, F.lit(17).cast("long"), F.lit(4297).cast("long"), key)
    return _let(out, lambda o: F.date_add(_first(), (o["a"] * 4297 + o["b"]).cast("int")))


def _late_day(day: Column, key: Column) -> Column:
    """The same among days after the 12th of a month: pairs of a month and one of 19 days.

    Pairs that are no day (3 in 100) are permuted again until they are one. So many steps are
    too few for a value in 10^90.
    """
    start = F.struct(((F.year(day) - 1900) * 12 + F.month(day) - 1).cast("long").alias("a"), (F.dayofmonth(day) - 13).cast("long").alias("b"))
    once = lambda s: feistel(s, F.lit(2400).cast("long"), F.lit(19).cast("long"), key)
    month = lambda s: F.add_months(_first(), s["a"].cast("int"))
    is_day = lambda s: s["b"] + 13 <= F.dayofmonth(F.last_day(month(s)))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(60)), once(start), lambda s, i: F.when(is_day(s), s).otherwise(once(s)))
    return _let(out, lambda s: F.date_add(month(s), (s["b"] + 12).cast("int")))


def date(value: Column, key: Column) -> Column:
    """Another date in the same form. Month-first dates stay among those that only month-first
    reading gives, so that both ways of reading are permutations."""
    iso, day, turned = _iso(value), _day(value), _month_first(value)
    moved = F.when(turned, _late_day(day, _sub(key, "late"))).otherwise(_any_day(day, key))
    sep = F.when(iso, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))

    def shown(d: Column) -> Column:
        y, m, n = (F.date_format(d, x) for x in ("yyyy", "MM", "dd"))
        return F.when(iso, F.concat_ws("", y, sep, m, sep, n)).when(turned, F.concat_ws("", m, sep, n, sep, y)).otherwise(F.concat_ws("", n, sep, m, sep, y))

    return F.when(day.isNull(), value).otherwise(_let(moved, shown))


def ip(value: Column, key: Column) -> Column:
    """The address as a number of 32 bits, permuted."""
    parts = F.split(value, r"\.")
    part = lambda i: F.get(parts, F.lit(i)).cast("long")
    s = F.struct((part(0) * 256 + part(1)).alias("a"), (part(2) * 256 + part(3)).alias("b"))
    out = feistel(s, F.lit(1 << 16).cast("long"), F.lit(1 << 16).cast("long"), key)
    return _let(
        out,
        lambda o: F.concat_ws(
            ".",
            F.shiftright(o["a"], 8).cast("string"),
            o["a"].bitwiseAND(255).cast("string"),
            F.shiftright(o["b"], 8).cast("string"),
            o["b"].bitwiseAND(255).cast("string"),
        ),
    )


def numbers(value: Column, key: Column) -> Column:
    return _put_back(value, permute_digits(_digits(value), key))


def email(value: Column, key: Column) -> Column:
    """Letters and digits of the name and of the host but its last label. Addresses that
    differ in case alone are one, and get pseudonyms that differ in case alone."""
    tail = F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)
    head = F.substring(value, F.lit(1), F.length(value) - F.length(tail))
    low = F.lower(head)
    letters = permute_letters(F.regexp_replace(low, "[^a-z]", ""), key)
    moved = _put_back(_put_back(low, letters, "[a-z]"), permute_digits(_digits(head), key))
    cased = F.zip_with(F.split(moved, ""), F.split(head, ""), lambda m, c: F.when(c.rlike("[A-Z]"), F.upper(m)).otherwise(m))
    return F.concat(F.when(head == low, moved).otherwise(F.array_join(cased, "")), tail)


def mod97(account: Column) -> Column:
    """A bank account number without spaces, its first four characters last, modulo 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97,
    )


def iban(value: Column, key: Column) -> Column:
    """Letters stay; all digits but the check digits are permuted, and those made anew."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    moved = numbers(F.substring(value, F.lit(5), F.length(value)), _sub(key, "2"))

    def checked(rest: Column) -> Column:
        start = F.concat(F.substring(bare, 1, 2), F.lit("00"))
        check = F.lit(98) - mod97(F.concat(start, F.replace(rest, F.lit(" "), F.lit(""))))
        return F.concat(F.substring(value, 1, 2), F.lpad(check.cast("string"), 2, "0"), rest)

    return _let(moved, checked)


HOW = {"email": email, "iban": iban, "card": card, "date": date, "ip": ip, "ssn": numbers, "phone": numbers}


def valid(kind: str, value: Column) -> Column:
    d = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("int") <= 255)
    if kind == "card":
        return F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
    if kind == "ssn":
        return ~value.rlike("^(000|666|9..)|-00-|-0000$")
    if kind == "date":
        return _day(value).isNotNull()
    if kind == "phone":
        return F.length(d).between(7, 15)
    if kind == "iban":
        bare = F.replace(value, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & bare.substr(3, 2).between("02", "98") & (mod97(bare) == 1)
    return F.lit(True)


def _valid_spans(text: Column, k: int, kind: str) -> Column:
    spans = find_spans(text, PATTERNS[kind], k)
    if kind == "card":  # those that fail the check stay as spans of no kind, for no other to take
        return F.transform(spans, lambda s: s.withField("kind", F.when(valid(kind, s["value"]), s["kind"]).otherwise(NONE)))
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def _beside(found: Column, own: Column) -> Column:
    """found, and those of own that overlap none of them."""
    return F.concat(
        found,
        F.filter(own, lambda s: ~F.exists(found, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))),
    )


def find_personal(text: Column) -> Column:
    """Sorted spans (start, kind, end, value) without overlaps: the kind named first wins."""
    found = F.array().cast(SPAN)
    for k, kind in enumerate(KINDS):
        found = _let(found, partial(_beside, own=_valid_spans(text, k, kind)))
    return F.array_sort(F.filter(found, lambda s: s["kind"] != NONE))


def pseudonym(span: Column, key: Column) -> Column:
    out = F.lit("")
    for k, kind in enumerate(KINDS):
        out = F.when(span["kind"] == k, HOW[kind](span["value"], _sub(key, kind))).otherwise(out)
    return out


def pseudonymise(df: DataFrame, text: str = "text", secret: str | DataFrame = "", spans: str = "pii_spans") -> DataFrame:
    """df with the text's personal data replaced, and the spans found in the original text.

    secret: the key, or a table whose one row and column is the key.
    """
    if isinstance(secret, str):
        if not secret:
            raise ValueError("a secret key is needed")
        secret = df.sparkSession.createDataFrame([(secret,)], "key string")
    held = "__tessera_key"
    found = df.withColumn(spans, find_personal(F.coalesce(F.col(text), F.lit(""))))
    found = found.join(F.broadcast(secret.toDF(held).limit(1)), F.lit(True))
    new = replaced(F.col(text), F.col(spans), lambda s: pseudonym(s, F.col(held)))
    return found.withColumn(text, new).drop(held)
