import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabshift.functions.names import IDX, POS
from tabshift.operators.compare import value_leaks
from tabshift.operators.noise import apply_noise
from tabshift.operators.order import (
    dense_positions,
    first_per_key,
    first_seen,
    with_index,
    with_position,
)
from tabshift.operators.synth import SynthesisError, synthesize
from tabshift.specs import SpecError
from workloads.specs import noise, synthesis


def test_index_of_scattered_positions(spark):
    rng = random.Random(7)
    spread = {rng.randrange(1 << 60) for _ in range(300)} | set(range(70_000, 70_200)) | {0, 1 << 36}
    df = spark.createDataFrame([(p,) for p in spread], f"{POS} bigint")
    got = {r[POS]: r[IDX] for r in with_index(df).collect()}
    assert got == {p: i for i, p in enumerate(sorted(spread))}


def test_index_does_not_depend_on_partitions(spark):
    df = spark.range(200_000).select((F.col("id") * 3).alias(POS))
    for n in (1, 7):
        wrong = with_index(df.repartition(n)).filter(F.col(IDX) * 3 != F.col(POS))
        assert wrong.count() == 0


def test_dense_positions_and_sorting(spark, table, rows):
    df = table(["a"], [["x"], ["y"], ["z"]]).filter("a <> 'y'")
    assert [r[POS] for r in dense_positions(df).orderBy(POS).collect()] == [0, 1]
    placed = with_position(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), "k")
    assert rows(placed) == [("a",), ("b",), ("c",)]


def test_first_per_key_counts_null_as_a_key(table):
    df = table(["k", "v.w"], [["a", "1"], [None, "2"], ["a", "3"], [None, "4"], ["b", None]])
    got = {(r["k"], r["v.w"]) for r in first_per_key(df, ["k"]).collect()}
    assert got == {("a", "1"), (None, "2"), ("b", None)}


def test_first_seen_labels(table):
    df = table(["k"], [["b"], ["a"], ["b"], [None]])
    got = [tuple(r) for r in first_seen(df, "k").orderBy("first_pos").collect()]
    assert got == [("b", 2, 0), ("a", 1, 1)]


# --- noise ------------------------------------------------------------------


def test_typo_swaps_neighbours(table, rows):
    words = [["hello"], ["world"], ["Höxter"], ["a"], [""], [None], ["ab"], ["x" * 50 + "y"]]
    out = rows(apply_noise(table(["t"], words), noise(1, [], ("typo", 1.0))))
    for (old,), (new,) in zip(words, out):
        if old is None or len(old) < 2:
            assert new == old
            continue
        assert Counter(new) == Counter(old)
        differing = [i for i in range(len(old)) if old[i] != new[i]]
        assert differing in ([], [differing[0], differing[0] + 1] if differing else [])
    assert out[6] == ("ba",)


def test_probability_bounds(table, rows):
    cells = [["ab", "cd"], ["ef", None]]
    df = table(["k", "v"], cells)
    for kind in ("typo", "missing_value", "duplicate"):
        assert rows(apply_noise(df, noise(1, [], (kind, 0.0)))) == [tuple(c) for c in cells]
    assert rows(apply_noise(df, noise(1, ["k"], ("missing_value", 1.0)))) == [("ab", None), ("ef", None)]
    assert rows(apply_noise(df, noise(1, ["k"], ("duplicate", 1.0)))) == [
        ("ab", "cd"), ("ab", "cd"), ("ef", None), ("ef", None),
    ]


def test_shares_are_close_to_the_probabilities(spark):
    df = spark.range(20_000).select(
        F.lit("abcdef").alias("a"), F.lit("abcdef").alias("b"), F.col("id").alias(POS)
    )
    out = apply_noise(df, noise(9, [], ("typo", 0.2), ("missing_value", 0.1), ("duplicate", 0.3)))
    shares = out.agg(
        (F.count(F.lit(1)) / 20_000).alias("n"),
        F.avg(F.col("a").isNull().cast("int")).alias("nulls"),
        F.avg((F.col("b") != "abcdef").cast("int")).alias("typos"),
        F.avg((F.col("a").isNull() & F.col("b").isNull()).cast("int")).alias("both"),
    ).first()
    assert abs(shares["n"] - 1.3) < 0.02
    assert abs(shares["nulls"] - 0.1) < 0.01
    assert abs(shares["typos"] - 0.2) < 0.02
    assert abs(shares["both"] - 0.01) < 0.005


def test_order_of_steps_matters(table, rows):
    df = table(["t"], [[f"abcdefghij{i:02d}"] for i in range(40)])
    pairs = lambda out: list(zip(out[::2], out[1::2]))
    same = pairs(rows(apply_noise(df, noise(3, [], ("typo", 1.0), ("duplicate", 1.0)))))
    assert all(a == b for a, b in same)
    apart = pairs(rows(apply_noise(df, noise(3, [], ("duplicate", 1.0), ("typo", 1.0)))))
    assert any(a != b for a, b in apart)


def test_noise_depends_on_seed_only(table, rows):
    df = table(["k", "v"], [[str(i), f"value {i}"] for i in range(200)])
    steps = (("typo", 0.3), ("duplicate", 0.3), ("missing_value", 0.2))
    one = rows(apply_noise(df.repartition(1), noise(5, ["k"], *steps)))
    many = rows(apply_noise(df.repartition(7), noise(5, ["k"], *steps)))
    other = rows(apply_noise(df, noise(6, ["k"], *steps)))
    assert one == many != other
    assert {k for k, _ in one} == {str(i) for i in range(200)}


def test_noise_by_row_key_needs_no_position(table, rows):
    df = table(["k", "v"], [["a", "hello"], ["b", "world"]])
    keyed = apply_noise(df.drop(POS), noise(5, ["k"], ("typo", 1.0)), row_key=["k"])
    assert keyed.columns == ["k", "v"] and keyed.count() == 2
    with pytest.raises(SpecError, match="row_key"):
        apply_noise(df.drop(POS), noise(5, ["k"], ("typo", 1.0)))


def test_noise_registry(table, rows):
    def blank(df, step, seed, number, columns):
        return df.withColumns({c: F.lit(step.params["text"]) for c in columns})

    config = noise(1, ["k"], ("blank", 1.0))
    config.noise_types[0].params["text"] = "?"
    df = table(["k", "v"], [["a", "b"]])
    assert rows(apply_noise(df, config, models={"blank": blank})) == [("a", "?")]
    with pytest.raises(SpecError, match="'blank'"):
        apply_noise(df, config)


# --- synthesis --------------------------------------------------------------


def synthesized(rows, df, **columns):
    return rows(synthesize(df, synthesis(11, **columns)))


def test_numbers_stay_in_range_with_their_precision(table, rows):
    df = table(["a", "b", "c"], [["10.50", "3", "-1.5"], ["20.00", "9", "0.25"], ["15.75", "5", None]] * 20)
    one = {"strategy": "numeric_distribution"}
    got = synthesized(rows, df, a=one, b=one, c=one)
    assert all(10.5 <= float(a) <= 20 and len(a.split(".")[1]) == 2 for a, _, _ in got)
    assert {b for _, b, _ in got} <= {str(i) for i in range(3, 10)}
    assert all(-1.5 <= float(c) <= 0.25 and len(c.split(".")[1]) == 2 for _, _, c in got)
    assert any(c.startswith("-0.") for _, _, c in got)


@pytest.mark.parametrize("cells", [[None, None], ["1", "x"]])
def test_numbers_that_cannot_be_fitted(table, cells):
    with pytest.raises(SynthesisError):
        synthesize(table(["a"], [[c] for c in cells]), synthesis(1, a={"strategy": "numeric_distribution"}))


def test_dates_stay_in_their_span(table, rows):
    df = table(["d"], [["01.03.2020"], ["01.04.2020"], [None]] * 20)
    got = synthesized(rows, df, d={"strategy": "date_distribution", "field_format": "DD.MM.YYYY"})
    assert all(d.endswith(".03.2020") for (d,) in got) and len(set(got)) > 10
    single = table(["d"], [["01.03.2020"]])
    assert synthesized(rows, single, d={"strategy": "date_distribution", "field_format": "DD.MM.YYYY"}) == [("01.03.2020",)]


@pytest.mark.parametrize(
    "fmt, start, expected",
    [("{:04d}-0000", 9000, "9000-0000"), ("C{}", 7, "C7"), ("{:07d}", None, "0000000"), ("{:d}x", 1, "1x")],
)
def test_sequences(table, rows, fmt, start, expected):
    extra = {} if start is None else {"start": start}
    got = synthesized(rows, table(["k"], [["a"], [None]]), k={"strategy": "unique_sequence", "format": fmt, **extra})
    assert got[0] == (expected,) and got[0] != got[1]


def test_sequence_formats_are_checked(table):
    for fmt in ("{:>5}", "{}{}", "plain", "{:.2f}"):
        with pytest.raises(SpecError):
            synthesize(table(["k"], [["a"]]), synthesis(1, k={"strategy": "unique_sequence", "format": fmt}))


def test_labels_are_resampled_by_frequency(table, rows):
    df = table(["c", "one"], [["deu", "x"]] * 900 + [["aut", "x"]] * 100 + [[None, None]])
    got = synthesized(rows, df, c={"strategy": "categorical_resample"}, one={"strategy": "categorical_resample"})
    counts = Counter(c for c, _ in got)
    assert set(counts) == {"deu", "aut"} and 50 < counts["aut"] < 160
    assert {o for _, o in got} == {"x"}


def test_too_many_labels_are_refused(table):
    df = table(["c"], [["a"], ["b"], ["c"]])
    ok = {"strategy": "categorical_resample", "max_cardinality": 3}
    assert synthesize(df, synthesis(1, c=ok)).count() == 3
    with pytest.raises(SynthesisError, match="max_cardinality=2"):
        synthesize(df, synthesis(1, c={**ok, "max_cardinality": 2}))


def test_providers_give_plausible_values(table, rows):
    names = ["company", "postcode", "city", "street_name", "building_number", "bs", "user_name"]
    df = table(names, [[None] * 7] * 50)
    got = synthesized(rows, df, **{n: {"strategy": "faker", "provider": n} for n in names})
    assert all(cell for row in got for cell in row)
    assert all(len(p) == 5 and p.isdigit() for _, p, *_ in got)
    assert len({row[0] for row in got}) > 30
    with pytest.raises(SpecError, match="no provider 'iban'"):
        synthesize(table(["a"], [["x"]]), synthesis(1, a={"strategy": "faker", "provider": "iban"}))


def test_table_synthesis_rules(table, rows):
    df = table(["a", "b"], [["1", "x"], ["2", None]])
    identity = {"strategy": "identity"}
    assert synthesized(rows, df, b=identity, a=identity, unused=identity) == [("1", "x"), ("2", None)]
    with pytest.raises(SpecError, match="'b'"):
        synthesize(df, synthesis(1, a=identity))
    with pytest.raises(SpecError, match="'magic'"):
        synthesize(df, synthesis(1, a=identity, b={"strategy": "magic"}))


def test_synthesis_does_not_depend_on_partitions(table, rows):
    df = table(["a", "b"], [[str(i), f"l{i % 3}"] for i in range(100)])
    config = synthesis(1, a={"strategy": "unique_sequence", "format": "{}"}, b={"strategy": "categorical_resample"})
    assert rows(synthesize(df.repartition(1), config)) == rows(synthesize(df.repartition(7), config))


def test_leaks_are_counted_per_column(table):
    source = table(["a", "b", "c"], [["1", "x", None], ["2", "y", "q"]])
    synthetic = table(["a", "b", "c"], [["1", "z", None], ["1", "w", None], ["2", "v", None]])
    leaks = {r["column"]: r["leaked_values"] for r in value_leaks(source, synthetic, ["a", "b", "c"]).collect()}
    assert leaks == {"a": 2, "b": 0, "c": 0}


@pytest.mark.parametrize("n", [1, 2, 3, 10**15, (1 << 64) + 1, 10**38])
def test_wide_draws_are_the_high_half_of_a_product(spark, n):
    import hashlib

    from tabshift.functions.draws import wide_uniform

    keys = [str(k) for k in range(40)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [int(r[0]) for r in df.select(wide_uniform(F.md5("k"), n)).collect()]
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) * n >> 128 for k in keys]


def test_wide_numbers_stay_in_range_with_their_precision(table, rows):
    cells = [["123456789012345678901234567890", "-0.000000000000000000000001"], ["999999999999999999999999999999", "2.5"], [None, None]] * 20
    config = synthesis(3, a={"strategy": "numeric_distribution"}, b={"strategy": "numeric_distribution"})
    made = rows(synthesize(table(["a", "b"], cells), config))
    assert len(made) == 60 and len({a for a, _ in made}) > 50
    for a, b in made:
        assert len(a) == 30 and "123456789012345678901234567890" <= a <= "9" * 30
        assert len(b.partition(".")[2]) == 24 and -Decimal("0.000000000000000000000001") <= Decimal(b) <= Decimal("2.5")


def test_numbers_of_too_many_digits_are_named(table):
    config = synthesis(3, a={"strategy": "numeric_distribution"})
    with pytest.raises(SynthesisError, match="more than 38 digits"):
        synthesize(table(["a"], [["1" * 40]]), config)


def test_many_labels_are_drawn_by_frequency(table, rows):
    cells = [["hot"]] * 400 + [[f"l{k}"] for k in range(100)] + [[None]] * 20
    config = synthesis(3, a={"strategy": "categorical_resample", "max_cardinality": 101})
    made = [r[0] for r in rows(synthesize(table(["a"], cells), config))]
    assert len(made) == 520 and set(made) <= {"hot", *(f"l{k}" for k in range(100))}
    assert 0.7 < made.count("hot") / 520 < 0.9 and len(set(made)) > 40
    with pytest.raises(SynthesisError, match="more than max_cardinality=100"):
        synthesize(table(["a"], cells), synthesis(3, a={"strategy": "categorical_resample", "max_cardinality": 100}))
