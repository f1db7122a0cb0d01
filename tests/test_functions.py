import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answergauge.functions import embed, scan, text, vectors
from answergauge.operators import correct, score


def nums(s):
    b = s.encode()
    return scan.numbers(b, scan.identifiers(b))


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("plain 42 here", [(42, False, False)]), ("1,234_567.5", [(1234567.5, False, False)]), ("$ 12.50", [(12.5, False, True)]), ("up 4.78%", [(4.78, True, False)]), ("$59 billion", [(59e9, False, True)]),
        ("12k and 5 bn", [(12e3, False, False), (5e9, False, False)]), ("7 minutes 5 mint", [(7, False, False), (5, False, False)]), ("1.5e9 2E-3", [(1.5e9, False, False), (2e-3, False, False)]),
        ("-3.5 x-4 5-10", [(-3.5, False, False), (4, False, False), (5, False, False), (-10, False, False)]), ("24-hour", [(24, False, False)]), ("no digits", []), ("100xabcdef1", [(100, False, False)]),
        ("$-5 and -$6", [(-5, False, True), (6, False, True)]), ("1e9999", [(math.inf, False, False)]), ("1e12345", [(1, False, False), (12345, False, False)]), ("3.", [(3, False, False)]), ("1,", [(1, False, False)]), ("2e", [(2, False, False)]),
    ],
)
def test_numbers(s, want):
    got = nums(s)
    assert [n.value for n in got] == pytest.approx([w[0] for w in want])
    assert [(n.percent, n.currency) for n in got] == [w[1:] for w in want]


def test_positions_are_bytes():
    (n,) = nums("é $1.5%")
    assert (n.start, n.end, n.currency, n.percent) == (3, 8, True, True)


def test_identifiers():
    found = scan.identifiers(b"CVE-2024-12345 on 2026-09-01, 0xABCdef12 and 0xfff, 12026-09-011, cve-2024-123")
    assert [(i.kind, i.text) for i in found] == [("cve", "CVE-2024-12345"), ("date", "2026-09-01"), ("hex", "0xabcdef12")]
    assert nums("0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48 has 7") [0].value == 7
    assert [i.kind for i in scan.identifiers(b"100xabcdef1")] == ["hex"]


@given(st.text(alphabet="0123456789abxEe.,_-$% kmCVEé", max_size=60))
def test_scanners_give_spans_in_order(s):
    b = s.encode()
    ids = scan.identifiers(b)
    found = scan.numbers(b, ids)
    assert all(0 <= x.start < x.end <= len(b) for x in [*ids, *found])
    assert [n.start for n in found] == sorted(n.start for n in found)
    assert all(not (i.start < n.start and n.start < i.end and chr(b[n.start]).isdigit()) for n in found for i in ids)


@given(st.integers(0, 10**15), st.integers(0, 999))
def test_values_of_plain_numbers(a, b):
    assert nums(f"{a}.{b:03d}")[0].value == pytest.approx(a + b / 1000)
    assert nums(f"{a:,}")[0].value == a


PAIRS = {
    "no digits in the truth": ("It rains.", "It is 5 degrees.", {"total": 0}),
    "contradiction": ("The price is $100.", "The price is $120.", {"total": -0.08, "numeric_coverage": 0}),
    "faithful": ("The price is $100.", "It costs $100.", {"total": 0, "numeric_coverage": 1}),
    "drift": ("The price is $496.35.", "It costs $496.37.", {"total": 0, "numeric_coverage": 1}),
    "silence": ("The price is $100.", "It costs something.", {"total": 0, "numeric_coverage": None}),
    "flood": ("The price is 100.", " ".join(map(str, range(900))), {"total": 0, "numeric_coverage": None}),
    "truth refuses": ("I don't have the exact price of 5.", "It is 7.", {"total": 0, "gt_refused": True}),
    "answer refuses": ("The price is $100.", "I'm sorry, I cannot say.", {"total": -0.06, "refusal": -0.06}),
    "dates are left out": ("On 2026-09-01 it was so.", "On 2026-08-26 it was so.", {"total": 0, "ident_coverage": None}),
    "wrong hash": ("See 0xabcdef123456.", "See 0xabcdef123457.", {"total": -0.06, "ident_coverage": 0}),
    "hash in other case": ("See 0xABCDEF123456.", "See 0xabcdef123456.", {"total": 0, "ident_coverage": 1}),
    "one digit too long": ("Of 0x" + "a" * 41, "Of 0x" + "a" * 40, {"total": 0, "ident_coverage": 1}),
    "prefix of 23 digits": ("Of 0x" + "a" * 23, "Of 0x" + "a" * 24, {"total": -0.06}),
    "clamped": ("Price $100, id 0xabcdef123456.", "Price $200, id 0x999999999999.", {"total": -0.12}),
    "blank": ("The price is $100.", " \t\n", {"total": 0, "gt_refused": False}),
    "blank, and the truth refuses": ("I cannot say.", "", {"total": 0, "gt_refused": False}),
    "zero balance": ("The balance is 0 ETH.", "The balance is 5 ETH.", {"total": -0.08}),
    "years and small numbers aside": ("In 2024 the top 5 of 3 sold 81234 units.", "They sold 81300 units.", {"total": 0, "numeric_coverage": 1}),
}


@pytest.mark.parametrize("name", PAIRS)
def test_corrections(name):
    truth, answer, want = PAIRS[name]
    got = correct.analyse_one(truth, answer, correct.DetectorConfig())
    assert {k: None if got[k] is None else pytest.approx(float(got[k]), abs=1e-6) for k in want} == want


def test_correction_settings():
    cfg = correct.DetectorConfig
    assert correct.analyse_one("1 2 3 50", "60", cfg(max_truth_numbers=3))["total"] == 0
    assert correct.analyse_one("On 2026-09-01", "On 2026-09-02", cfg(check_dates=True))["total"] == np.float32(-0.06)
    assert correct.analyse_one("It is $5.", "It is 6.", cfg(cross_type_fallback=False))["total"] == 0
    assert correct.analyse_one("It is $5.", "I am unable to say.", cfg())["refusal"] == 0
    assert correct.analyse_one("It is $5.", "I am unable to say.", cfg(markers=text.REFUSALS_MORE))["refusal"] == np.float32(-0.06)
    shipped = cfg()
    assert (shipped.max_correction, shipped.numeric_weight, shipped.ident_weight, shipped.refusal_weight, shipped.rel_tolerance, shipped.flood_threshold) == (0.12, 0.08, 0.06, 0.06, 0.005, 48)


@given(st.text(max_size=80), st.text(max_size=80))
def test_corrections_only_lower(truth, answer):
    total = correct.analyse_one(truth, answer, correct.DetectorConfig())["total"]
    assert -np.float32(0.12) <= total <= 0


def test_correction_column_and_apply(spark):
    rows = spark.createDataFrame([(t, a, 0.05) for t, a, _ in PAIRS.values()] + [(None, "x", 1.0), ("$5", None, 0.5)], "t string, a string, base double")
    got = rows.select("base", correct.analyse(F.col("t"), F.col("a")).alias("c")).select("c.*", correct.apply(F.col("base"), F.col("c.total")).alias("s")).collect()
    for r, (_, _, want) in zip(got, PAIRS.values(), strict=False):
        assert {k: None if r[k] is None else pytest.approx(float(r[k]), abs=1e-6) for k in want} == want
        assert 0 <= r.s <= 0.05 + 1e-6
    assert [r.s for r in got[-2:]] == [1.0, 0.5]


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_texts(spark):
    c = F.col("s")
    for s, blank, uni in (("", True, True), (" \t\n\r\x0b\x0c", True, True), (" ", False, True), ("x ", False, False), (None, True, True), ("\n\nx", False, False)):
        assert tuple(one(spark, "s string", (s,), text.is_blank(c), text.is_blank_unicode(c))) == (blank, uni)
    assert list(one(spark, "s string", ("É a Ab-cd_Ⅷx é ñandú 1²",), text.tokens(c))[0]) == ["É", "ab", "cd", "Ⅷx", "é", "ñandú", "1²"]
    assert tuple(one(spark, "s string", ("é" * 10,), text.byte_length(c), text.clip(c, 3), text.head_bytes(c, 5))) == (20, "ééé…", "éé")
    for pad, want in ((232, True), (233, False)):
        assert one(spark, "s string", ("x" * pad + "I CANNOT",), text.is_refusal(c))[0] is want
    assert one(spark, "s string", ("é" * 116 + "i cannot",), text.is_refusal(c))[0] is True
    assert one(spark, "s string", ("é" * 115 + "x€€€€€" + "i cannot",), text.is_refusal(c))[0] is False
    assert tuple(one(spark, "a double, b double", (1.0, 0.0), text.pct(F.col("a"), F.col("b")), text.trim_float(F.col("a")))) == (0.0, "1")


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    for x, y, want in (([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], 0), ([0.0, 0.0], [1.0, 1.0], 0)):
        assert one(spark, "a array<float>, b array<float>", (x, y), vectors.cosine(a, b))[0] == pytest.approx(want)
    assert list(one(spark, "a array<float>", ([0.0, 0.0],), vectors.normalise(a))[0]) == [0, 0]
    for x, y, want in ((100.0, 100.5, True), (100.0, 100.6, False), (0.0, 0.0, True), (1e-10, 0.0, True), (math.inf, -math.inf, True), (math.inf, math.inf, False)):
        assert one(spark, "a double, b double", (x, y), vectors.numbers_equal(a, b))[0] is want
        assert correct.equal(x, y, 0.005) is want
    assert one(spark, "a double", (0.0,), vectors.sigmoid(a))[0] == 0.5
    assert [one(spark, "a double", (v,), vectors.is_year(a))[0] for v in (1899.0, 1900.0, 2100.0, 2000.5)] == [False, True, True, False]


def test_lexical_match(spark):
    q, d = F.col("q"), F.col("d")
    m = lambda x, y: one(spark, "q string, d string", (x, y), score.bm25(q, d))[0]
    six = "alpha beta gamma delta epsilon zeta"
    assert m(six, six) == pytest.approx(0.4)
    assert 0.4 < m(six, f"{six} {six}") < 1
    assert m(six, "other words") == 0 and m("", six) == 0 and m(six, "") == 0 and m(None, six) == 0
    assert 0 < m(six, "alpha beta") < 1
    assert m("aa aa", "aa bb") == pytest.approx(m("aa", "aa bb"), abs=0.1)


def test_composite_of_blank_answer_is_zero(spark):
    rows = spark.createDataFrame([("1", "q", "t", " "), ("2", "some words", "some words", "some words")], "id string, question string, ground_truth string, miner_answer string")
    got = {r.id: r for r in score.LEXICAL_SCORER.apply(rows).collect()}
    assert got["1"].score == 0 and got["2"].score > 0.2 and got["2"].error is None
    broken = score.Scorer("x", "x", lambda q, t, a: F.when(a == "some words", F.lit(float("nan"))).otherwise(F.lit(0.5)))
    assert {r.id: r.error for r in broken.apply(rows).collect()} == {"1": None, "2": "the score isn't a number"}


def test_token_ids():
    ids = embed.token_ids("Hello, wörld")
    assert ids[0] == 101 and ids[-1] == 102 and len(ids) == 4 and ids == embed.token_ids("HELLO wörld")
    assert len(embed.token_ids("a " * 500)) == 128 and embed.token_ids("") == [101, 102]
    assert all(103 <= embed.hashed_id(w) < 30522 for w in ("a", "zebra", "é"))
    pieces = embed.wordpiece({"un": 5, "##aff": 6, "##able": 7, "##a": 8})
    assert pieces("unaffable") == [5, 6, 7] and pieces("unaffx") == [100] and pieces("u" * 201) == [100]


def test_projection(spark):
    v = embed.project("some words here")
    assert v.shape == (384,) and v.dtype == np.float32 and np.linalg.norm(v) == pytest.approx(1, abs=1e-5)
    assert (embed.project("some words here") == v).all() and not (embed.project("here words some") == v).all()
    x = (((embed.SEED ^ (3 << 32) ^ 101) * embed.LCG_MUL + embed.LCG_ADD) & embed.MASK) >> 40
    assert embed._projection()[101, 3] == (np.uint32(x | 0x3F800000).view(np.float32) - np.float32(1.5)) * 2
    got = spark.createDataFrame([("some words here",), (None,)], "s string").select(embed.projection_embedding("s")).collect()
    assert got[0][0] == v.tolist() and len(got[1][0]) == 384


def test_transformer_reads_its_weights():
    rng = np.random.default_rng(0)
    width, inner, vocabulary, positions = 8, 16, 110, 128
    table = lambda r, c: np.float32(0.01).tobytes() + rng.integers(-127, 127, r * c).astype(np.int8).tobytes()
    vec = lambda n, v: np.full(n, v, "<f4").tobytes()
    blob = b"MLM2" + np.array([1, width, 2, inner, vocabulary, positions], "<u4").tobytes() + table(vocabulary, width) + table(positions, width) + table(1, width) + vec(width, 1) + vec(width, 0)
    blob += b"".join(table(width, width) + vec(width, 0.1) for _ in range(4)) + vec(width, 1) + vec(width, 0) + table(inner, width) + vec(inner, 0) + table(width, inner) + vec(width, 0) + vec(width, 1) + vec(width, 0)
    weights, sizes = embed.read_weights(blob)
    assert sizes["layers"] == 1 and weights["0.up"].shape == (width, inner) and weights["0.down"].shape == (inner, width)
    model = embed.Transformer(weights, {"a": 105, "b": 106}, layers=1, heads=2)
    v = model.embed("a b a")
    assert v.shape == (width,) and np.linalg.norm(v) == pytest.approx(1, abs=1e-5) and (model.embed("a b a") == v).all()
    with pytest.raises(ValueError):
        embed.read_weights(b"MLM1" + blob[4:])


def test_words_of_embeddings_are_those_of_texts(spark):
    """Vowel signs are part of their word, in both forms."""
    texts = ["हिन्दी x_y", "ไทย ที่", "Ⅷ ½ a²", "don't É-b", "  ", "ͅa"]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    got = [r.w for r in table.select(F.transform(text.split_words(F.col("t")), text.lower_ascii).alias("w")).collect()]
    assert got == [embed.words(t) for t in texts] and got[0] == ["हिन", "दी", "x", "y"]  # the sign that joins consonants is no letter
