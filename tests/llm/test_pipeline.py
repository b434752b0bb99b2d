"""The pipeline against a plain Python version of its decisions."""

import random
from collections import defaultdict

import public_tokenizers

import corpus_pipeline
from tessera.llm.packing import tokenizer
from tessera.llm.queries import QUERIES


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = "the and of that with from this there when other more than some into".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    clean = {i: prose(80) for i in range(12)}
    texts = clean | {20: clean[3], 21: clean[4].upper(), 22: clean[5] + " end", 23: "", 24: None}
    texts[1] += " password = hunter2hunter2"
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 3:
            assert not any("hunter2" in r.text for r in docs.collect())
    kept = set(clean) | {20, 21, 22}
    assert left[0] == kept
    assert left[1] == kept - {3, 4}
    assert left[2] == left[3] == left[4] == kept - {3, 4, 22}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == left[4]


def test_stages_on_nulls_repeats_clashes_and_nothing(spark, tmp_path):
    """Every stage but the last keeps the columns and what it doesn't read; the last packs every row."""
    rng = random.Random(4)
    words = "the and of that with from this there when other more than some into".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    long, text = prose(60_000), prose(90)
    rows = [(1, long, "en", "s"), (2, text, None, None), (3, prose(70), "en", None), (3, prose(70), None, "s"), (None, prose(60), "en", "s"), (4, None, None, None), (5, "", "en", "s"), (6, text, "en", "s"), (6, text, "en", "s")]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, rep long, locator string, class_id long, identified string, host string"
    full = [(i, t, a, b, len(t or ""), "kept", None, 7, "x", 8, "y", None) for i, t, a, b in rows]
    # rows that must be left; the exact stage knows equal texts, and a null key is no key to go by
    left = {
        "language": lambda r: r.text, "exact_dedup": lambda r: r.doc_id not in (2, 4), "near_dedup": lambda r: r.doc_id not in (5, 6), "secrets": lambda r: True,
    }
    docs = spark.createDataFrame(full, names).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path)).collect()
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        if name == "packing":
            whole = {(r.doc_id, r.doc_tokens) for r in got}
            assert {i for i, _ in whole} == {1, 2, 3, 4, 5, 6, None} and (4, 1) in whole
            continue
        assert none.columns == docs.columns and none.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        want = [r for r in docs.collect() if left[name](r)]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
    assert next(n for n in QUERIES if n.startswith("op1_")) == "op1_packing"


def test_all_limits_bind_on_conversations(spark):
    held = defaultdict(lambda: [0, 0, 0])
    pieces = defaultdict(int)
    for r in QUERIES["packing_turns"](spark, "/root/testdata/sf0.001").collect():
        for k, v in enumerate((r.length, 1, r.loss_tokens)):
            held[r.sequence_id][k] += v
        pieces[r.conv_id, r.turn, r.doc_tokens] += r.length
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    lib = tokenizer(public_tokenizers.path("byte_bpe_50k.json")).lib
    want = defaultdict(int)
    for r in rows:
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id, r.turn, n] += n
    assert pieces == want
    for k, most in enumerate((1024, 16, 512)):
        assert max(x[k] for x in held.values()) <= most
    assert max(x[1] for x in held.values()) == 16 and max(x[2] for x in held.values()) > 200
