"""Trained and sketched decisions, recomputed in plain Python from whole tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import language, quality, secret

WORDS = {
    "en": "the and of that with from this there when other more than some into".split(),
    "fr": "le la et que pour dans une avec mais plus sans cette comme leur".split(),
    "de": "der die und nicht ein mit auf von aber noch ohne diese wie ihre".split(),
}


def codes(text):
    raw = text.lower().encode()
    return [(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) % (1 << 32)) >> 18 for i in range(len(raw) - 2)]


def plain_fusion(rows, langs, logs, limit, slack):
    """id -> (identified, confidence, accepted); rows: id, text, declared, host."""
    n, found, held = len(langs), [], defaultdict(lambda: [0.0] * len(langs))
    for i, text, declared, host in rows:
        c = codes(text or "")
        means = [sum(float(logs[k][x]) for x in c) / len(c) if c else 0.0 for k in range(n)]
        fits = bool(c) and any(m >= limit[k] - slack[k] / math.sqrt(len(c)) for k, m in enumerate(means))
        own = [m * min(len(c), 60) for m in means]
        top = max(own)
        w = [math.exp(x - top) for x in own]
        p = [x / sum(w) if fits else 0.0 for x in w]
        m = re.search(r"([^.]+\.[^.]+)$", host or "")
        domain, suffix = m[1] if m else "", m[1].split(".")[1] if m else ""
        keys = [("all",), ("domain", domain), ("host", domain, host), ("said", declared), ("suffix", suffix)]
        for k in keys:
            held[k] = [a + b for a, b in zip(held[k], p, strict=True)]
        found.append((i, own, fits, p, keys))
    out = {}
    for i, own, fits, p, keys in found:
        rest = [[max(a - b, 0.0) for a, b in zip(held[k], p, strict=True)] for k in keys]
        everywhere = [(x + 1) / (sum(rest[0]) + n) for x in rest[0]]
        shrunk = lambda s, prior: [(x + 20 * q) / (sum(s) + 20) for x, q in zip(s, prior, strict=True)]
        domain = shrunk(rest[1], everywhere)
        host, said, suffix = shrunk(rest[2], domain), shrunk(rest[3], everywhere), shrunk(rest[4], everywhere)
        total = [own[k] + math.log(host[k]) + math.log(said[k] / everywhere[k]) + math.log(suffix[k] / everywhere[k]) for k in range(n)]
        best = max(range(n), key=lambda k: total[k])
        sure = 1 / sum(math.exp(x - total[best]) for x in total)
        out[i] = (langs[best], sure, fits and sure >= 0.6)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    rows = []
    for i in range(260):
        lang = ("en", "fr", "de")[i % 3]
        said = lang if i % 10 else "en"  # some are labelled wrongly
        host = (f"{lang}.example.org", None, "mixed.example.org", "x.other.net")[i % 4]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 60))), said, host))
    junk = ["".join(chr(rng.randrange(33, 127)) for _ in range(400)) for _ in range(8)]
    rows += [(300 + k, t, None, "x.other.net") for k, t in enumerate(junk)]
    return rows + [(900, None, None, None), (901, "", "en", "s"), (902, "the of and " * 9000, "fr", None), (903, "de", "fr", "a.b"), rows[5], rows[5]]


def test_language_equals_plain_fusion(spark, texts):
    docs = spark.createDataFrame([(*r, "clash") for r in texts], "doc_id long, text string, lang string, source string, host string").repartition(3)
    model = language.train(docs, "doc_id", "text", "lang")
    count = np.zeros((3, language.BUCKETS))
    for _, t, said, _ in texts:
        if said is not None:
            c = codes(t or "")
            np.add.at(count[["de", "en", "fr"].index(said)], c, min(1, 2000 / max(1, len(c))))
    count += 0.5
    assert model.langs == ["de", "en", "fr"] and np.allclose(model.logs, np.log(count / count.sum(axis=1, keepdims=True)), atol=1e-4)
    want = plain_fusion(texts, model.langs, model.logs, model.limit, model.slack)
    got = language.identify_documents(docs, model=model).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, sure, accepted = want[r.doc_id]
        assert (r.identified, r.accepted) == (lang, accepted) and abs(r.confidence - sure) < 1e-6
    by = {r.doc_id: r for r in got}
    truth = {i: ("en", "fr", "de")[i % 3] for i in range(260)}
    long = [i for i, t, *_ in texts if i < 260 and len(t.split()) >= 8]
    assert sum(by[i].identified == truth[i] and by[i].accepted for i in long) >= 0.99 * len(long)
    wrong = [i for i in long if texts[i][2] != truth[i]]
    assert len(wrong) > 10 and all(by[i].identified == truth[i] for i in wrong)  # the text corrects the label
    assert not any(by[300 + k].accepted for k in range(8))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, _, ok) in want.items() if ok}


def test_a_row_is_no_evidence_for_itself(spark):
    rows = [(i, " ".join(WORDS["en" if i % 2 else "fr"] * 3), "en" if i % 2 else "fr", "s.org") for i in range(20)]
    rows.append((50, "que le avec the", None, "alone.net"))
    model = language.train(spark.createDataFrame(rows[:20], "doc_id long, text string, lang string, source string"), "doc_id", "text", "lang")
    one = plain_fusion(rows, model.langs, model.logs, model.limit, model.slack)[50]
    got = [r for r in language.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model=model).collect() if r.doc_id == 50][0]
    assert abs(got.confidence - one[1]) < 1e-9


def test_each_language_has_its_own_sample(spark):
    rows = [(i, "the and of " * 5, "en") for i in range(3000)] + [(5000, "que le avec " * 5, "fr")]
    some = language.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", rows=100)
    assert {r.lang: r["count"] for r in some.groupBy("lang").count().collect()} == {"en": 100, "fr": 1}


def test_visible_text():
    cases = {
        "a<b>c</b>d": "a c d", "x<script>1<2</script >y": "x y", "x<!-- <p> -->y": "x y", "<STYLE a=b>p{}</style><p>q": "   q",
        "a<!-- b": "a<!-- b", "a<!-- b>c": "a c", "a < b": "a < b", "": "", "a<scripty>b": "a b", "<script>a>b": " a>b",
    }
    for markup, text in cases.items():
        assert language.visible(markup).split() == text.split(), markup
    for part in ("<!--", "<script>", "<", "<!-- <style>", "<script></style>"):
        assert len(language.visible(part * 200_000)) >= 0  # in linear time: this would take hours otherwise


def test_quality_verdicts_equal_plain_fences(spark):
    rng = random.Random(8)
    words = [w + str(i) for w in WORDS["en"] for i in range(40)]

    def text():
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 14))) for _ in range(rng.randint(8, 14))]
        own += own[:1] * rng.choice((0,) * 60 + (1, 4)) + ["one two three"] * rng.choice((0,) * 30 + (1, 5))
        return "\n".join(own) + " #$" * rng.choice((0,) * 20 + (1,) * 8 + (2, 30))

    rows = [(i, text(), "en" if i < 260 else "fr", ("a", "b", None)[i % 3] if i < 260 else "c") for i in range(330)]
    rows += [(900, None, "en", "a"), (901, "", None, None), (902, "#" * 99, "en", "a"), rows[7], rows[7]]
    got = quality.judge(spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, source string, kept boolean").repartition(3)).collect()
    assert len(got) == len(rows)
    group = {i: (lang, source) for i, _, lang, source in rows}
    past = [r for r in got if not r.base_failed]
    fine, coarse = defaultdict(list), defaultdict(list)
    for r in past:
        fine[group[r.doc_id]].append(r)
        coarse[group[r.doc_id][0]].append(r)

    def at(values, q):
        return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]

    fallen = Counter()
    for r in got:
        ok = not r.base_failed
        if ok:
            own = fine[group[r.doc_id]]
            own = own if len(own) >= 100 else coarse[group[r.doc_id][0]] if len(coarse[group[r.doc_id][0]]) >= 100 else past
            for name, (_, _, least, below) in quality.RATIOS.items():
                values = [x[name] for x in own]
                low, high = at(values, 0.25), at(values, 0.75)
                up, down = max(high - low, at(values, 0.9) - high), max(high - low, low - at(values, 0.1))
                over = r[name] > high + (quality.WIDE * up or least) or below and r[name] < low - (quality.WIDE * down or least)
                fallen[name] += over
                ok = ok and not over
        assert r.kept == ok, r
    assert sum(fallen.values()) > 3


def test_markov_spans_equal_plain_stretches(spark):
    rng = random.Random(3)
    letters = secret.ALPHABET[:62]
    rows, sizes = [], {}
    for i in range(150):
        token = "".join(rng.choice(letters) for _ in range(rng.choice((16, 20, 32, 48))))
        around = [rng.choice(WORDS["en"] + WORDS["de"]) + rng.choice("/_- =") for _ in range(rng.randint(0, 14))]
        sizes[i] = len(token)
        rows.append((i, "".join(around) + token + rng.choice(("", "_end", " = x", "\U0001f600")) + (' password="abcdef1"' if i % 5 == 0 else "")))
    rows += [(900, None), (901, ""), (902, "12345678901234567890"), (903, "x" * 5000), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    ratios = secret.model(docs)
    n = len(secret.ALPHABET)
    step = lambda a, b: ratios[secret.ALPHABET.index(a) * n + secret.ALPHABET.index(b)]

    def stretches(run):
        steps = [0.0] + [step(a, b) for a, b in zip(run, run[1:], strict=False)]
        good = lambda score, size: score >= secret.THRESHOLD and score >= secret.RATE * size
        if good(sum(steps), len(run)):
            return [(0, len(run))]
        out, total, a, b, peak = [], 0.0, 0, 0, 0.0
        for i, r in enumerate(steps):
            total += r
            if total <= 0 or peak - total > secret.THRESHOLD:
                if good(peak, b - a):
                    out.append((a, b))
                total, a, b, peak = 0.0, i, i, 0.0
            elif total > peak:
                peak, b = total, i + 1
        if good(peak, b - a):
            out.append((a, b))
        return out

    for r in secret.find_secrets(docs, "text", ratios, "base", "found").collect():
        text = r.text or ""
        bare = list(text)
        for s in r.base:
            bare[s.start : s.end] = " " * (s.end - s.start)
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", "".join(bare)):
            for a, b in stretches(m[0]):
                while a and m[0][a - 1] not in "/_-=":
                    a -= 1
                while b < len(m[0]) and m[0][b] not in "/_-=":
                    b += 1
                if b - a >= 16 and re.search("[A-Za-z]", m[0][a:b]):
                    want.add((m.start() + a, m.start() + b))
        assert {(s.start, s.end) for s in r.found if s.kind == 3} == want, r
    planted = {r.doc_id: r for r in secret.find_secrets(docs, "text", ratios, "base", "found").collect() if r.doc_id < 150}
    for least, share in ((16, 0.7), (20, 0.8), (32, 0.9)):
        own = [r for i, r in planted.items() if sizes[i] >= least]
        assert sum(any(s.kind == 3 for s in r.found) for r in own) >= share * len(own)


def test_constants_in_capitals_are_no_secrets(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(WORDS["en"]) for _ in range(60))) for i in range(30)], "doc_id long, text string")
    ratios = secret.model(docs)
    names = ["_".join(x.upper() for x in rng.sample(WORDS["en"], 5)) for _ in range(200)] + ["/".join(rng.sample(WORDS["en"], 6)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(n for n in names if len(n) >= 16)), "doc_id long, text string")
    found = [r for r in secret.find_secrets(df, "text", ratios).collect() if r.spans]
    assert len(found) <= 0.01 * df.count()
