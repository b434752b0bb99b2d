"""Pseudonyms, recomputed in plain Python: the finder, the checks and the Feistel networks."""

import hashlib
import random
import re
import string
from datetime import date, timedelta

from tessera.llm import pii
from tessera.llm.spans import find_spans, replaced

from pyspark.sql import functions as F

PATTERNS = [(k, re.compile(p.replace(r"\x20", " "), re.A)) for k, p in pii.PATTERNS.items()]
FIRST = date(1900, 1, 1)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def digits(v):
    return re.sub("[^0-9]", "", v)


def day(v):
    def made(y, m, d):
        try:
            return date(int(y), int(m), int(d)) if 1900 <= int(y) <= 2099 else None
        except ValueError:
            return None

    a, b, c = re.split("[-./]", v)
    if len(a) == 4:
        return made(a, b, c)
    return made(c, b, a) or (made(c, a, b) if month_first(v) else None)


def month_first(v):
    return v[2] == "/" and v[3:5] > "12"


def valid(kind, v):
    d, bare = digits(v), v.replace(" ", "")
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in v.split(".")),
        "card": lambda: 13 <= len(d) <= 19 and luhn(d) == 0,
        "ssn": lambda: not re.search("^(000|666|9..)|-00-|-0000$", v),
        "date": lambda: day(v) is not None,
        "phone": lambda: 7 <= len(d) <= 15,
        "iban": lambda: 15 <= len(bare) <= 34 and "02" <= bare[2:4] <= "98" and mod97(bare) == 1,
    }[kind]()


def feistel(a, b, left, right, key):
    f = lambda n, half, below: int(hashlib.sha256(f"{key}|{n}|{below}|{half}".encode()).hexdigest()[:15], 16) % below
    for n in range(8):
        if n % 2 == 0:
            a = (a + f(n, b, left)) % left
        else:
            b = (b + f(n, a, right)) % right
    return a, b


def permuted(d, key):
    if not d:
        return d
    k = len(d) // 2
    a, b = feistel(int(d[:k] or 0), int(d[k:]), 10**k, 10 ** (len(d) - k), key)
    return (str(a).zfill(k) if k else "") + str(b).zfill(len(d) - k)


def letters(w, key):
    out = ""
    for g in re.findall("[a-z]{1,10}", w):
        number = lambda t: sum((ord(c) - 97) * 26**i for i, c in enumerate(reversed(t)))
        text = lambda v, n: "".join(chr(97 + v // 26**i % 26) for i in reversed(range(n)))
        k = len(g) // 2
        a, b = feistel(number(g[:k]), number(g[k:]), 26**k, 26 ** (len(g) - k), key)
        out += text(a, k) + text(b, len(g) - k)
    return out


def put(v, new, inside="[0-9]"):
    new = iter(new)
    return "".join(next(new) if re.match(inside, c) else c for c in v)


def changed(kind, v, key):
    key = f"{key}|{kind}"
    if kind in ("ssn", "phone"):
        return put(v, permuted(digits(v), key))
    if kind == "card":
        moved = permuted(digits(v)[:-1], key)
        return put(v, moved + str(-luhn(moved + "0") % 10))
    if kind == "iban":
        rest = put(v[4:], permuted(digits(v[4:]), key + "|2"))
        return f"{v[:2]}{98 - mod97(v[:2] + '00' + rest.replace(' ', '')):02d}{rest}"
    if kind == "ip":
        a, b, c, d = map(int, v.split("."))
        x, y = feistel(a * 256 + b, c * 256 + d, 1 << 16, 1 << 16, key)
        return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if kind == "email":
        tail = re.search(r"(\.[A-Za-z]+)$", v)[1]
        head = v[: -len(tail)]
        low = head.lower()
        moved = put(put(low, letters(re.sub("[^a-z]", "", low), key), "[a-z]"), permuted(digits(head), key))
        return "".join(m.upper() if c in string.ascii_uppercase else m for m, c in zip(moved, head, strict=True)) + tail
    d = day(v)
    if month_first(v):
        a, b = (d.year - 1900) * 12 + d.month - 1, d.day - 13
        while True:
            a, b = feistel(a, b, 2400, 19, key + "|late")
            try:
                return date(1900 + a // 12, a % 12 + 1, b + 13).strftime("%m/%d/%Y")
            except ValueError:
                continue
    a, b = feistel(*divmod((d - FIRST).days, 4297), 17, 4297, key)
    new = FIRST + timedelta(days=a * 4297 + b)
    if len(re.split("[-./]", v)[0]) == 4:
        return new.strftime(f"%Y{v[4]}%m{v[4]}%d")
    return new.strftime(f"%d{v[2]}%m{v[2]}%Y")


def plain(text, key):
    """The text with pseudonyms, and how many were found."""
    found = []
    for kind, pattern in PATTERNS:
        own = [(m.start(), m.end(), kind if valid(kind, m[0]) else None, m[0]) for m in pattern.finditer(text)]
        own = [x for x in own if (x[2] or kind == "card") and not any(a < x[1] and x[0] < b for a, b, *_ in found)]
        found += own
    out, at = "", 0
    kept = sorted(x for x in found if x[2])
    for a, b, kind, v in kept:
        out, at = out + text[at:a] + changed(kind, v, key), b
    return out + text[at:], len(kept)


def test_pseudonyms_equal_plain_ones(spark):
    rng = random.Random(5)
    some = [
        "nt.26@mail6.example.com", "NT.Case@Mail6.Example.COM", "4417744280351547", "4417 7442 8035 1547", "4417744280351548", "3782-822463-10005",
        "97.51.17.173", "999.1.1.1", "+1 (017) 555-7713", "+14155552671", "(415)555-2671", "+33 1 23 45 67 89", "123-45-6789", "000-12-3456",
        "2024-02-29", "2024-02-30", "2024/02/28", "31.12.1999", "31/12/1999", "12/31/2024", "1899-05-05", "DE89 3704 0044 0532 0130 00",
        "DE88 3704 0044 0532 0130 00", "GB82WEST12345698765432", "a@b.co", "x1@y2-z.org", "2099-12-31", "1900-01-01", "\U0001f600", "plain words", "1.2.3",
    ]
    texts = ["".join(rng.choice(some) + rng.choice((" ", ", ", "\n", "; ")) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts += ["", None, " ".join(some * 60), "é\U0001f600 " * 2000 + some[0] + " é" * 2000 + some[2], texts[3], texts[3]]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "id int, text string, pii_spans string, key int").repartition(3)
    got = pii.pseudonymise(df, secret="k")
    assert got.columns == df.columns and "k|" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        assert r.key == 7
        if texts[r.id] is None:
            assert r.text is None and r.pii_spans == []
        else:
            assert (r.text, len(r.pii_spans)) == plain(texts[r.id], "k"), texts[r.id][:200]


def test_dates_are_permuted(spark):
    days = spark.range(0, 73049, 1).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for form in ("yyyy-MM-dd", "dd.MM.yyyy"):
        assert days.select(pii.date(F.date_format("d", form), F.lit("q")).alias("p")).distinct().count() == 73049
    late = days.where("day(d) > 12")
    moved = late.select(pii.date(F.date_format("d", "MM/dd/yyyy"), F.lit("q")).alias("p")).where("p rlike '^(0[1-9]|1[0-2])/(1[3-9]|[23][0-9])/[0-9]{4}$'")
    assert moved.distinct().count() == late.count()


def test_spans_of_very_many_matches(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("ab é\U0001f600") * rng.randint(1, 4) for _ in range(30_000))
    df = spark.createDataFrame([(text,), ("",), ("zzz",)], "t string")
    spans = find_spans(F.col("t"), "a+|é", 2)
    got = df.select(spans.alias("s"), replaced(F.col("t"), spans, lambda s: F.concat(F.lit("<"), s["value"], F.lit(">"))).alias("r")).collect()
    assert [(s.start, s.end) for s in got[0].s] == [m.span() for m in re.finditer("a+|é", text)]
    assert got[0].r == re.sub("(a+|é)", r"<\1>", text) and got[1].r == "" and got[2] == ([], "zzz")
