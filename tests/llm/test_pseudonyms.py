from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabshift.llm import pseudonyms as P

from .helpers import documents

C = P.Cipher("key")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 100, 257])
def test_is_a_permutation(n):
    assert sorted(C.permute("k", v, n) for v in range(n)) == list(range(n))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_characters_keep_their_class(text):
    out = C.characters("k", text)
    assert [(c.isdigit(), c.islower(), c.isupper()) if c.isascii() else c for c in out] == [
        (c.isdigit(), c.islower(), c.isupper()) if c.isascii() else c for c in text
    ]


def found(text, cipher=C):
    return [(kind, text[a:b], new) for a, b, kind, new in P.find(text, cipher)]


@pytest.mark.parametrize(
    ("kind", "value"),
    [
        ("card", "4111111111111111"), ("card", "5500-0000-0000-0004"), ("card", "3782 822463 10005"), ("ip", "10.20.30.40"),
        ("email", "Ann.Lee+x@mail.example.com"), ("date", "2021-03-05"), ("date", "31/12/1999"), ("date", "5.3.1921"),
        ("phone", "+1 (017) 555-7713"), ("phone", "+49 30 901820"), ("phone", "(017) 555-7713"), ("ssn", "123-45-6789"),
        ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
    ],
)
def test_finds_and_keeps_the_format(kind, value):
    ((got, text, new),) = found(f"x {value}, y")
    assert (got, text) == (kind, value) and new != value
    if kind not in ("ip", "date"):
        shape = lambda s: [c if not c.isalnum() else "9" if c.isdigit() else "a" for c in s]
        assert shape(new) == shape(value)
    assert [k for k, *_ in found(f"x {new}, y")] == [kind], "a pseudonym is valid itself"


@pytest.mark.parametrize("text", ["4111111111111112", "300.1.1.1", "1.2.3.4.5", "version 4.0.", "2021-13-45", "000-12-3456", "DE00 3704 0044 0532 0130 00", "a4111111111111111", "x@y", "1234 5678"])
def test_leaves_what_is_not_valid(text):
    assert found(text) == []


@pytest.mark.parametrize(
    ("value", "rest"),
    [
        ("ES91 2100 0418 4502 0005 1332", " BIC"), ("BE68 5390 0754 7034", " EUR"), ("ES9121000418450200051332", " IBAN"),
        ("BE68539007547034", " 2024"), ("TR33 0006 1005 1978 6457 8413 26", " TRY"), ("MT84MALT011000012345MTLCAST001S", " X"),
        ("AE070331234567890123456", " AED 100"),
    ],
)
def test_account_numbers_end_where_their_country_says(value, rest):
    ((kind, text, new),) = [x for x in found(f"x {value}{rest}, y") if x[0] == "iban"]
    assert text == value and new != value and found(f"x {new}{rest}, y")[0][:2] == ("iban", new)


def test_a_failed_match_hides_no_account_number():
    value = "DE89 3704 0044 0532 0130 00"
    assert ("iban", value) in [x[:2] for x in found(f"AT12 {value}")]


@pytest.mark.parametrize("text", ["2024-01-02T10:00:00Z", "at 2024-01-02T10:00:00+01:00."])
def test_dates_of_timestamps(text):
    ((kind, value, new),) = found(text)
    assert (kind, value) == ("date", "2024-01-02") and new != value
    assert found("2024-01-02Tx") == found("2024-01-02x") == []


def test_equal_values_stay_linked():
    a = {new.replace("-", "").replace(" ", "") for _, _, new in found("4111111111111111 and 4111-1111-1111-1111 and 4111 1111 1111 1111")}
    assert len(a) == 1
    (one,), (two,) = found("2021-03-05"), found("am 05.03.2021")
    assert datetime.strptime(one[2], "%Y-%m-%d") == datetime.strptime(two[2], "%d.%m.%Y")
    assert found("10.20.30.40", P.Cipher("other")) != found("10.20.30.40")


def test_awkward_rows(spark):
    value = "ann.lee@example.com 4111111111111111"
    docs = documents(spark, [(1, None), (2, ""), (3, value), (3, value), (None, f"é {value}"), (4, "word 1 " * 60_000 + value)], clash=True)
    got = P.pseudonymise(docs, key="test")
    assert got.columns == [*docs.columns, "private_"] and got.count() == 6
    rows = got.collect()
    assert not any("4111111111111111" in (r["text"] or "") or "ann.lee" in (r["text"] or "") for r in rows)
    assert sum(r["text"] is None for r in rows) == 1
    by_id = [[s["pseudonym"] for s in r["private_"]] for r in rows if r["doc_id"] in (3, 4, None)]
    assert len(set(map(tuple, by_id))) == 1 and len(by_id[0]) == 2
    assert {r["lang"] for r in rows} == {"en"} and {r["private"] for r in rows} == {"own"}


def test_empty_table(spark):
    assert P.pseudonymise(documents(spark, []), key="test").collect() == []


@pytest.mark.parametrize(
    "spellings",
    [
        ["+49 30 1234567", "+49301234567", "+4930 1234567", "+49 (30) 123-4567", "+49.30.1234567"],
        ["+1 212 555 0123", "+12125550123", "+1 (212) 555-0123", "+1-212-555-0123"],
        ["+353 1 234 5678", "+35312345678", "+353 12 345 678"],
        ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "de89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00"],
    ],
)
def test_spellings_of_a_value_get_one_pseudonym(spellings):
    found = []
    for value in spellings:
        ((start, end, _, new),) = P.find(f"call {value}, now", C)
        assert (start, end) == (5, 5 + len(value)) and len(new) == len(value)
        found.append("".join(c for c in new if c.isalnum()).upper())
    assert len(set(found)) == 1 and found[0] != "".join(c for c in spellings[0] if c.isalnum())


def test_country_codes_stay():
    assert [P.country_code(d) for d in ("12125550123", "79161234567", "4930123", "353123", "998901")] == ["1", "7", "49", "353", "998"]
    assert P.find("+49 30 1234567", C)[0][3].startswith("+49 ")


def test_a_key_is_required(spark):
    with pytest.raises(ValueError, match="need a key"):
        P.pseudonymise(documents(spark, [(1, "x")]))
