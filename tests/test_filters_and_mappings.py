import pytest
from pyspark.sql import functions as F

from tabshift.functions.cells import is_populated
from tabshift.functions.names import POS
from tabshift.operators.filters import apply_filtering
from tabshift.operators.mappings import HANDLERS, Mapped
from tabshift.plans.migrate import migrate, migrate_with_quarantine
from tabshift.specs import SpecError
from workloads.specs import filtering, rule, schema, task


def keep(rows, df, *rules):
    return [r[0] for r in rows(apply_filtering(df, filtering(*rules)))]


@pytest.fixture
def amounts(table):
    return table(["weight"], [["3"], ["8"], ["15"], ["42"], [None]])


@pytest.mark.parametrize(
    "operator, expected",
    [
        (">=", ["15", "42"]), (">", ["42"]), ("<=", ["3", "8", "15"]), ("<", ["3", "8"]),
        ("==", ["15"]), ("!=", ["3", "8", "42", None]),
    ],
)
def test_numeric_operators(rows, amounts, operator, expected):
    assert keep(rows, amounts, {"field": "weight", "operator": operator, "value": 15}) == expected


def test_rules_are_anded_and_none_keeps_all(rows, amounts):
    low = {"field": "weight", "operator": ">=", "value": 4}
    high = {"field": "weight", "operator": "<=", "value": 15.0}
    assert keep(rows, amounts, low, high) == ["8", "15"]
    assert apply_filtering(amounts, None) is amounts


def test_large_whole_numbers_compare_exactly(rows, table):
    df = table(["n"], [["9007199254740993"], ["9007199254740992"]])
    assert keep(rows, df, {"field": "n", "operator": ">", "value": 9007199254740992}) == ["9007199254740993"]


def test_codes_of_any_width_compare_exactly(rows, table):
    df = table(["n"], [["90071992547409930001"], ["90071992547409930000"], ["7" * 38]])
    r = {"field": "n", "operator": ">", "value": 90071992547409930000}
    assert keep(rows, df, r) == ["90071992547409930001", "7" * 38]
    with pytest.raises(Exception, match="at most 38 digits"):
        apply_filtering(table(["n"], [["1" * 39]]), filtering(r)).count()
    with pytest.raises(SpecError, match="38 digits"):
        apply_filtering(df, filtering({**r, "value": 10**38}))


@pytest.mark.parametrize("value", [True, ["a"]])
def test_values_that_are_no_text_equal_none(rows, table, value):
    df = table(["t"], [["True"], ["None"], [None]])
    assert keep(rows, df, {"field": "t", "operator": "==", "value": value}) == []
    assert len(keep(rows, df, {"field": "t", "operator": "!=", "value": value})) == 3


@pytest.mark.parametrize("value", ["20230101", "2023-W01-1", "2023-1-1", "x"])
def test_bounds_of_formatted_dates_are_plain_iso_dates(table, value):
    r = {"field": "d", "operator": ">=", "value": value, "field_format": "DD.MM.YYYY"}
    with pytest.raises(SpecError, match="YYYY-MM-DD"):
        apply_filtering(table(["d"], [["05.06.2019"]]), filtering(r))


def test_text_compares_by_code_point(rows, table):
    df = table(["d"], [["2022-12-31"], ["2023-01-01"], ["2024-05-05"], [None]])
    assert keep(rows, df, {"field": "d", "operator": ">=", "value": "2023-01-01"}) == ["2023-01-01", "2024-05-05"]
    assert keep(rows, df, {"field": "d", "operator": "!=", "value": "2023-01-01"}) == ["2022-12-31", "2024-05-05", None]


def test_formatted_dates_compare_as_dates(rows, table):
    df = table(["d"], [["17.09.2018"], ["23.11.2020"], ["2.2.2020"]])
    r = {"field": "d", "operator": ">=", "value": "2020-02-02", "field_format": "DD.MM.YYYY"}
    assert keep(rows, df, r) == ["23.11.2020", "2.2.2020"]


@pytest.mark.parametrize("value", ["x", "1d", "61.11.2024"])
def test_unreadable_cells_stop_the_filter_even_on_other_rows(table, value):
    df = table(["n", "t"], [["5", "a"], [value, "b"]])
    rules = filtering(
        {"field": "t", "operator": "==", "value": "a"}, {"field": "n", "operator": ">", "value": 1}
    )
    with pytest.raises(Exception, match="is not a number"):
        apply_filtering(df, rules).count()


def test_missing_or_bad_dates_stop_the_filter(table):
    for bad in (None, "31.02.2023", "1.2.2023x"):
        df = table(["d"], [["01.01.2023"], [bad]])
        r = {"field": "d", "operator": ">", "value": "2020-01-01", "field_format": "DD.MM.YYYY"}
        with pytest.raises(Exception, match="is not a date"):
            apply_filtering(df, filtering(r)).count()


def test_unknown_operator(amounts):
    with pytest.raises(SpecError):
        apply_filtering(amounts, filtering({"field": "weight", "operator": "~", "value": 1}))


def test_text_filter_reaches_the_scan(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table(["d", "x"], [["2023-01-01", "1"]]).write.parquet(path)
    df = apply_filtering(
        spark.read.parquet(path), filtering({"field": "d", "operator": ">=", "value": "2023-01-01"})
    ).select("d")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(d,2023-01-01)" in plan.split("PushedFilters:")[1]
    assert "ReadSchema: struct<d:string>" in plan


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Nanette & Nullo", True), ("nan nan", False), ("None", False), ("<NA>", False), ("", False),
        ("   ", False), (None, False), ("nan / NULL, NaT", False), ("nan x", True), ("-", False),
        ("nano", True), ("Müller", True), ("nan None", False),
    ],
)
def test_populated(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(is_populated(F.col("t"))).first()[0] is expected


def one(table, rows, cells, **transformation):
    """Apply one mapping to a single-column table."""
    df = table(["src"], [[c] for c in cells])
    t = task("T", None, [rule("src", "out", transformation.pop("type"), **transformation)])
    return [r[0] for r in rows(migrate(df, t, schema("S", "out")))]


def test_copy_keeps_missing(table, rows):
    assert one(table, rows, ["a", None], type="copy") == ["a", None]


def test_concatenate(table, rows):
    df = table(["a b", "c.d"], [["x  y", "1"], ["x", None]])
    for separator, expected in ((" ", "x  y 1"), (None, "x  y1")):
        extra = {"separator": separator} if separator else {}
        t = task("T", None, [rule(["a b", "c.d"], "out", "concatenate", **extra)])
        assert rows(migrate(df, t, schema("S", "out"))) == [(expected,), (None,)]


def test_value_mapping_and_its_failures(table, rows):
    mapping = {"north": "N", "south": "S"}
    assert one(table, rows, ["north", "south"], type="value_mapping", mapping=mapping) == ["N", "S"]
    with pytest.raises(Exception, match="no value_mapping entry for 'west' in field 'src'"):
        one(table, rows, ["north", "west"], type="value_mapping", mapping=mapping)
    with pytest.raises(Exception, match="missing value"):
        one(table, rows, [None], type="value_mapping", mapping=mapping)
    with pytest.raises(SpecError):
        one(table, rows, ["north"], type="value_mapping", mapping={True: "x"})


def test_an_entry_may_be_missing_text(table, rows):
    mapping = {"north": None, "south": "S"}
    assert one(table, rows, ["north", "south"], type="value_mapping", mapping=mapping) == [None, "S"]
    many = {f"k{i}": None for i in range(200)}
    assert one(table, rows, ["k7"], type="value_mapping", mapping=many) == [None]


@pytest.mark.parametrize("read", [lambda df: df.count(), lambda df: df.select("k").collect()])
def test_strict_errors_do_not_depend_on_what_is_read(table, read):
    df = table(["c", "k"], [["north", "1"], ["west", "2"]])
    t = task("T", None, [rule("c", "out", "value_mapping", mapping={"north": "N"}), rule("k", "k", "copy")])
    with pytest.raises(Exception, match="no value_mapping entry for 'west'"):
        read(migrate(df, t, schema("S", "out", "k")))


def test_no_digits_means_no_padding(table, rows):
    t = task("T", None, [rule("k", "n", "sequential_number", start=5, digits=0)])
    assert rows(migrate(table(["k"], [["a"], ["b"]]), t, schema("S", "n"))) == [("5",), ("6",)]


def test_large_value_mapping(table, rows):
    mapping = {f"k{i}": f"v{i}" for i in range(500)}
    assert one(table, rows, ["k3", "k499"], type="value_mapping", mapping=mapping) == ["v3", "v499"]
    with pytest.raises(Exception, match="no value_mapping entry"):
        one(table, rows, ["k500"], type="value_mapping", mapping=mapping)


def test_unmapped_values_of_filtered_rows_do_not_matter(table, rows):
    df = table(["c", "n"], [["north", "1"], ["west", "0"]])
    t = task(
        "T",
        {"field": "n", "operator": "==", "value": 1},
        [rule("c", "out", "value_mapping", mapping={"north": "N"})],
    )
    assert rows(migrate(df, t, schema("S", "out"))) == [("N",)]


@pytest.mark.parametrize(
    "text, source, target, expected",
    [
        ("2017-08-24", "YYYY-MM-DD", "DDMMYYYY", "24082017"),
        ("27.02.05", "DD.MM.YY", "DD.MM.YYYY", "27.02.2005"),
        ("30.06.68", "DD.MM.YY", "DD.MM.YYYY", "30.06.2068"),
        ("30.06.69", "DD.MM.YY", "DD.MM.YYYY", "30.06.1969"),
        ("29.02.00", "DD.MM.YY", "YYYY-MM-DD", "2000-02-29"),
        ("1.4.2001", "DD.MM.YYYY", "DD.MM.YY", "01.04.01"),
        ("01122023", "DDMMYYYY", "YYYY-MM-DD", "2023-12-01"),
    ],
)
def test_date_format(table, rows, text, source, target, expected):
    got = one(table, rows, [text], type="date_format", input_format=source, output_format=target)
    assert got == [expected]


@pytest.mark.parametrize("bad", ["2024-13-01", "x", None])
def test_date_format_fails_on_unreadable_cells(table, rows, bad):
    with pytest.raises(Exception, match="in field 'src'"):
        one(table, rows, [bad], type="date_format", input_format="YYYY-MM-DD", output_format="DD")


def test_sequential_numbers_follow_the_filtered_order(table, rows):
    df = table(["k"], [[c] for c in "abcde"])
    t = task(
        "T",
        {"field": "k", "operator": "!=", "value": "b"},
        [
            rule("k", "n", "sequential_number", start=48100000000, digits=11),
            rule("k", "m", "sequential_number", start=99, increment=-50, digits=3),
            rule("k", "k", "copy"),
        ],
    )
    assert rows(migrate(df, t, schema("S", "n", "m", "k"))) == [
        ("48100000000", "099", "a"), ("48100000001", "049", "c"),
        ("48100000002", "-01", "d"), ("48100000003", "-51", "e"),
    ]


def test_numbers_longer_than_their_digits_are_kept(table, rows):
    assert one(table, rows, ["a", "b"], type="sequential_number", start=9999, digits=4) == ["9999", "10000"]


def test_projection_follows_the_schema(table, rows):
    df = table(["a", "b"], [["1", "2"]])
    t = task("T", None, [rule("b", "y", "copy"), rule("a", "x", "copy"), rule("b", "x", "copy")])
    out = migrate(df, t, schema("S", "x", "email", "y"))
    assert out.columns == ["x", "y", POS]
    assert rows(out) == [("2", "2")]  # the last rule for x wins


def test_projection_errors(table):
    df = table(["a"], [["1"]])
    copy_a = rule("a", "x", "copy")
    with pytest.raises(SpecError, match="'y'"):
        migrate(df, task("T", None, [copy_a, rule("a", "y", "copy")]), schema("S", "x"))
    with pytest.raises(SpecError, match="required target field 'y'"):
        migrate(df, task("T", None, [copy_a]), schema("S", "x", "y", required=("y",)))
    with pytest.raises(SpecError, match="'rot13'"):
        migrate(df, task("T", None, [rule("a", "x", "rot13")]), schema("S", "x"))
    with pytest.raises(SpecError, match="position"):
        numbering = task("T", None, [rule("a", "x", "sequential_number", start=1)])
        migrate(df.drop(POS), numbering, schema("S", "x"))


def test_handlers_can_be_added(table, rows):
    def upper(r, context):
        return Mapped(F.upper(F.col(r.source_field)))

    t = task("T", None, [rule("a", "x", "upper")])
    out = migrate(table(["a"], [["b"]]), t, schema("S", "x"), {**HANDLERS, "upper": upper})
    assert rows(out) == [("B",)]


def test_quarantine_keeps_every_row_once(table, rows):
    df = table(
        ["k", "c", "n"],
        [["1", "north", "1"], ["2", "west", "1"], ["3", "north", "x"], ["4", "west", "0"], ["5", "north", "2"]],
    )
    t = task(
        "T",
        {"field": "n", "operator": ">", "value": 0},
        [
            rule("k", "no", "sequential_number", start=1),
            rule("c", "c", "value_mapping", mapping={"north": "D"}),
            rule("k", "k", "copy"),
        ],
    )
    result = migrate_with_quarantine(df, t, schema("S", "no", "c", "k"))
    assert rows(result.table) == [("1", "D", "1"), ("2", "D", "5")]
    bad = {r["k"]: r["_violations"] for r in result.quarantine.collect()}
    assert set(bad) == {"2", "3"}
    assert bad["2"] == ["no value_mapping entry for 'west' in field 'c'"]
    assert bad["3"] == ["n: 'x' is not a number"]


def test_quarantine_without_checks_is_empty(table):
    t = task("T", None, [rule("a", "x", "copy")])
    result = migrate_with_quarantine(table(["a"], [["1"]]), t, schema("S", "x"))
    assert result.quarantine.count() == 0 and result.table.count() == 1
