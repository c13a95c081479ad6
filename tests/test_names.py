"""Name functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import indic
from millrace.functions import names as N
from millrace.plans.oracle import ROMAN


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.fixture(scope="module")
def table(spark):
    """Apply a function of a column to many cases in one job."""

    def run(cases, column, kind="string"):
        rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], f"i int, x {kind}")
        got = {r["i"]: r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).collect()}
        return [(a, got[i]) for i, (a, _) in enumerate(cases)]

    return run


CLEAN = [
    ("** Birch & Loom Inc", "birch and loom inc"), ("{LIMITED} Quarry", "limited quarry"), ("tidewater.net", "tidewater"), ("Oak/Ash | north", "oak ash north"),
    ("Finch, Wren & Co", "finch wren and co"), ("Ella’s-Bakery", "ellas bakery"), ("M/s Copper Kiln", "copper kiln"), ("Lantern.Corp", "lantern corp"),
    ("", ""), (" n/a ", ""), (None, ""), ("kiln.co.in", "kiln"),
]


def test_base_clean(table):
    assert table(CLEAN, N.base_clean) == CLEAN


def test_boundaries_by_ascii(table):
    cases = [("wren .ioéé el", "wren éé el"), ("leuo .ioé", "leuo é"), ("wren.iox", "wren iox"), ("alder.com", "alder"), ("M/sé fern", "é fern")]
    assert table(cases, N.base_clean) == cases
    assert [y for _, y in table([(v, 0) for v in ("alder.inéé", "alder.inx")], N.is_domain_name)] == [True, False]


def test_dotted_legal(table):
    cases = [("P. V. T.", "pvt."), ("x l.l.c", "x llc"), ("y l . l . p", "y llp"), ("z pvt  ltd", "z private limited"), ("corp.", "corp."), ("inc", "inc"), ("l p dairy", "lp dairy")]
    assert table(cases, N.dotted_legal) == cases


def test_token_functions(table):
    cases = [("tern tern gull", "tern gull"), ("moss fern fern llp", "moss fern llp"), ("x y x", "x y x"), ("", "")]
    assert table(cases, lambda c: F.array_join(N.dedup_consecutive(N.tokens(c)), " ")) == cases
    cases = [("fern moss fern moss", "fern moss"), ("b b a", "b a"), ("plum", "plum")]
    assert table(cases, lambda c: F.array_join(N.dedup_all(N.tokens(c)), " ")) == cases
    cases = [("brid6e", "bridge"), ("m0ss", "moss"), ("5pruce", "spruce"), ("fie1d", "field"), ("60517", "60517"), ("willow", "willow")]
    assert table(cases, lambda c: F.array_join(N.fix_ocr(N.tokens(c)), " ")) == cases
    assert table(cases, lambda c: F.array_join(N.fix_ocr(N.tokens(c), False), " ")) == [(a, a) for a, _ in cases]
    cases = [("river mill private limited", "river mill"), ("heron corporation", "heron"), ("alder pllc", "alder"), ("harbor 7712", "harbor"), ("society", "society"), ("pra inc", "")]
    assert table(cases, lambda c: F.array_join(N.strip_suffixes(N.canonical_suffixes(N.tokens(c))), " ")) == cases


def test_folding(table):
    cases = [("fjörd", "fjord"), ("nāgara", "nagara"), ("ṭhāṇe", "thane"), ("ßx ﬁ", "x fi"), ("", "")]
    assert table(cases, N.to_ascii) == cases


def test_latin_name(spark):
    rows = spark.createDataFrame([("L.L.C.",), ("Corp.",), ("Wren Corp.",), ("Fjörd Prāiveṭa Limiteda",), (None,)], "x string")
    assert [r["y"] for r in N.with_latin_name(rows, "x", "y").collect()] == ["llc", "corp", "wren", "fjord", ""]


def test_variants(spark):
    rows = spark.createDataFrame([("tern gull tern gull",), ("wren heron alder",)], "x string")
    got = rows.select(*[c.alias(k) for k, c in N.name_variants(F.col("x")).items()]).collect()
    assert (got[0]["name_sorted"], got[1]["name_sorted"], got[1]["name_first2"], got[1]["name_full"]) == ("gull tern", "alder heron wren", "wren heron", "wren heron alder")


def test_script(table):
    cases = [
        ("Wren Alder", "latin"), ("नदी भवन", "devanagari"), ("கடல் வீடு", "tamil"), ("నది ఇల్లు", "telugu"), ("ನದಿ ಮನೆ", "kannada"), ("പുഴ വീട്", "malayalam"), ("ਨਦੀ ਘਰ", "gurmukhi"),
        ("নদী বাড়ি", "bengali"), ("નદી ઘર", "gujarati"), ("ନଦୀ ଘର", "oriya"), ("Wren नदी", "mixed"), (None, "latin"), ("42", "latin"),
    ]
    assert table(cases, N.script_type) == cases


def test_null_and_flags(table):
    assert [y for _, y in table([(v, 0) for v in ("NA", None, "x", "None")], N.null_fold)] == ["", "", "x", "None" if "None" not in N.K.NA_VALUES else ""]
    assert [y for _, y in table([(v, 0) for v in (" -- ", "\tNULL ", "x", None)], N.is_null_text)] == [True, True, False, True]
    assert [y for _, y in table([(v, 0) for v in ("a.com", "A.CO.IN x", "a.io", None)], N.is_domain_name)] == [True, True, False, False]
    assert [y for _, y in table([(v, 0) for v in ("US", "__", "", "Côte d'Ivoire")], N.slug)] == ["us", "unknown", "unknown", "côte_d_ivoire"]


def test_transliteration():
    assert indic.romanised_name("नदी भवन", "devanagari") == "nadi bhavana"
    assert indic.romanised_name("Wren", "latin") == "" and indic.romanised_name(None, "tamil") == ""
    for word, roman in ROMAN.items():
        assert indic.romanised_name(word, "devanagari") == roman
    for native, state in N.K.NATIVE_STATES.items():
        assert indic.romanised_name(native, indic.script_of(native[0])).isascii() and state in N.K.INDIA_STATES.values()
    assert indic.romanised_address("Sector 4, उत्तर प्रदेश") == "sector 4 uttara pradesha"
    assert indic.romanised_address("9 Alder Walk, TX") == "9 alder walk, tx"
    assert indic.romanised_address("n/a") == "" and indic.romanised_address(None) == ""
