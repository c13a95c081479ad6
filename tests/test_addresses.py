"""Address parsing against literal cases."""

import pytest

from millrace.functions.addresses import parse

CASES = [
    ("4410 Heron Ct, Tulsa, Oklahoma", "US", {"state_token": "oklahoma", "street_num": "4410", "locality_tokens": "heron tulsa"}),
    ("C-118 G/F, Lake Vihar, Delhi", "India", {"state_token": "delhi", "street_num": "c-118"}),
    ("Madurai, TN", "India", {"state_token": "tamil nadu"}),
    ("OR, CEDAR BAY, 907 12TH PLACE", "US", {"state_token": "oregon"}),
    ("77310 MOSSY LN, BOIS, ID", "US", {"zip_code": "", "state_token": "idaho"}),
    ("Kothrud, Nashik, Maharashtra 422009", "India", {"pin_code": "422009", "locality_tokens": "kothrud nashik"}),
    ("52 Elm St, Peoria, IL 61602", "US", {"zip_code": "61602", "locality_tokens": "elm peoria"}),
    ("52 Elm St, Peoria, IL 61602-0042", "US", {"zip_code": "61602-0042"}),
    ("9 Elm St, Concord, New Hampshire 03301", "US", {"state_token": "new hampshire", "zip_code": "03301"}),
    ("No 31 Plot, Elsewhere 88888", "Norway", {"pin_code": "", "zip_code": "", "street_num": "31"}),
    ("Near PT Fuel Pump, Quiet Lane Corner, Surat", "India", {"state_token": ""}),
    ("", "", {"has_address": False, "address_transliterated": ""}),
    ("none", "", {"has_address": False}),
    (":;:", "us", {"has_address": False, "address_transliterated": ":;:"}),
    (None, None, {"has_address": False, "state_token": ""}),
    ("Nashik, महाराष्ट्र 422009", "India", {"state_token": "maharashtra", "pin_code": "422009"}),
    ("कानपुर, उत्तर प्रदेश", "india", {"state_token": "uttar pradesh", "locality_tokens": ""}),
    ("7 Lake Road, पश्चिम बंगाल, दिल्ली 700001", "india", {"state_token": "west bengal", "pin_code": "700001", "street_num": "7"}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(CASES)], "i int, raw_address string, country string")
    return {r["i"]: r.asDict() for r in parse(rows).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_fields(parsed, i):
    for field, value in CASES[i][2].items():
        assert parsed[i][field] == value, (CASES[i], field, parsed[i])


def test_locality_words(parsed):
    for i in range(len(CASES)):
        words = (parsed[i]["locality_tokens"] or "").split()
        assert len(words) <= 5 and all(w.isascii() and w.strip("0123456789-") and w not in ("null", "oklahoma", "idaho") for w in words)


def test_ascii_plan_agrees(spark):
    rows = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(CASES) if a is None or a.isascii()], "i int, raw_address string, country string")
    a, b = ({r["i"]: r.asDict() for r in parse(rows, ascii_input=x).collect()} for x in (False, True))
    assert a == b
