import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tabshift.operators.match as match
from tabshift.functions.names import POS
from tabshift.operators.compare import multiset_overlap, positional_diff, row_multiset
from tabshift.operators.match import best_match, encoded, match_rows
from tabshift.operators.metrics import METRICS, Scoring, reproduction_score
from tabshift.plans.batch import Run, evaluate_many
from tabshift.plans.evaluate import evaluate, failed_run, score
from workloads.specs import noise, rule, task


def brute_best(truth, output):
    found = []
    for t, left in enumerate(truth):
        best, at = -1, None
        for o, right in enumerate(output):
            n = sum(a == b for a, b in zip(left, right))
            if n > best:
                best, at = n, o
        found.append((t, at, max(best, 0)))
    return found


def matched(df):
    return [tuple(r) for r in df.orderBy("truth_pos").collect()]


def random_rows(rng, n, width):
    """Rows with hot values, rare values and nulls."""
    cell = lambda: rng.choice([None, "hot", "hot", "hot", "b"]) if rng.random() < 0.7 else str(rng.randrange(9))
    return [[cell() for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("width, n, m", [(1, 6, 4), (2, 0, 3), (3, 5, 0), (5, 60, 80), (9, 25, 30)])
def test_best_match_equals_all_pairs(table, width, n, m):
    rng = random.Random(width)
    truth, output = random_rows(rng, n, width), random_rows(rng, m, width)
    names = [f"c.{i}" for i in range(width)]
    got = matched(best_match(table(names, truth), table(names, output)))
    assert got == brute_best(truth, output)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.lists(st.sampled_from([None, "a", "b", "1:a"]), min_size=3, max_size=3), max_size=6),
    st.lists(st.lists(st.sampled_from([None, "a", "b", "-"]), min_size=3, max_size=3), max_size=6),
)
def test_best_match_on_arbitrary_tables(table, truth, output):
    names = ["x", "y", "z"]
    assert matched(best_match(table(names, truth), table(names, output))) == brute_best(truth, output)


# read entries, sets of a round, cost of lists, rows from which keys are salted
@pytest.mark.parametrize(
    "read, sets, cost, salt",
    [(64, 4096, 2, 10**9), (0, 4096, 0, 10**9), (0, 4096, 10**9, 0), (2, 0, 2, 0), (2, 4096, 10**9, 10**9), (1, 3, 10**9, 0)],
)
def test_ways_of_matching_agree(table, monkeypatch, read, sets, cost, salt):
    """Lists, subsets of columns and salted keys give what all pairs give."""
    for name, value in {"READ_ROWS": read, "ROUND_SUBSETS": sets, "LIST_COST": cost, "SALT_FROM": salt}.items():
        monkeypatch.setattr(match, name, value)
    if not salt:
        monkeypatch.setattr(match, "ROWS_PER_SALT", 2)
        monkeypatch.setattr(match, "SENT_KEYS", 0)
    rng = random.Random(read + sets)
    truth, output = random_rows(rng, 30, 5), random_rows(rng, 35, 5)
    truth += [["never", "seen", "in", "the", "output"], ["never", "seen", "in", "the", "output"], truth[0], truth[0]]
    names = list("abcde")
    assert matched(best_match(table(names, truth), table(names, output))) == brute_best(truth, output)


def test_groups_are_matched_apart(spark):
    """Tables of several runs, of different widths, in one search."""
    rng = random.Random(8)
    pairs = {g: (random_rows(rng, 12, w), random_rows(rng, 15, w)) for g, w in ((0, 3), (5, 4), (9, 3))}
    pairs[9] = (pairs[0][0], pairs[9][1])

    def rows(side, name):
        found = [(g, k, ["" if c is None else "=" + c for c in r]) for g, p in pairs.items() for k, r in enumerate(p[side])]
        return spark.createDataFrame(found, f"_g int, {name} bigint, _c array<string>")

    got = match_rows(rows(0, "_t"), rows(1, "_o")).collect()
    want = [(g, t, o if n else None, n) for g, (a, b) in pairs.items() for t, o, n in brute_best(a, b)]
    assert sorted((r["_g"], r["_t"], r["_o"], r["matched"]) for r in got) == sorted(want, key=lambda r: r[:2])


def test_wide_rows_that_match_badly(table):
    """Beyond 64 columns, and rows with few equal cells among many frequent values."""
    rng = random.Random(7)
    wide = [[rng.choice("ab") if i % 9 else f"v{k}" for i in range(70)] for k in range(20)]
    changed = [[c if rng.random() < 0.3 else f"x{rng.randrange(9)}" for c in r] for r in wide]
    names = [f"c{i}" for i in range(70)]
    assert matched(best_match(table(names, changed), table(names, wide))) == brute_best(changed, wide)
    narrow = [[str(rng.randrange(3)) for _ in range(14)] for _ in range(100)]
    other = [[str(rng.randrange(1, 5)) for _ in range(14)] for _ in range(100)]
    assert matched(best_match(table(names[:14], narrow), table(names[:14], other))) == brute_best(narrow, other)


def test_cells_tell_null_from_text(table):
    rows = table(["a", "b"], [[None, ""], ["=", "x"]]).select(encoded(["a", "b"])).collect()
    assert [r[0] for r in rows] == [["", "="], ["==", "=x"]]


def test_other_columns_cannot_be_matched(table):
    assert best_match(table(["a"], [["1"]]), table(["b"], [["1"]])) is None


def test_multiset_overlap_counts_copies(table):
    a = table(["x", "y"], [["1", None], ["1", None], ["2", "b"]])
    b = table(["x", "y"], [["1", None], ["2", "c"], ["1", None], ["1", None]])
    assert tuple(multiset_overlap(a, b).first()) == (3, 4, 2)
    assert {tuple(r) for r in row_multiset(a).collect()} == {("1", None, 2), ("2", "b", 1)}


def test_cell_borders_matter_for_equality(table):
    a = table(["x", "y"], [["ab", "c"], [None, "-"]])
    b = table(["x", "y"], [["a", "bc"], ["-", None]])
    assert tuple(multiset_overlap(a, b).first())[2] == 0


def test_positional_diff(table):
    a = table(["x", "y"], [["1", None], ["2", "b"], ["3", "c"]])
    b = table(["x", "y"], [["1", None], ["2", "B"]])
    got = [tuple(r) for r in positional_diff(a, b).orderBy("row_index").collect()]
    assert got == [(1, None, ["y"]), (2, "right", [])]


# --- metrics ----------------------------------------------------------------


def value(name, output, truth, **more):
    return METRICS[name](Scoring(output=output, truth=truth, **more)).first()["score"]


@pytest.fixture
def two(table):
    return lambda truth, output, names=("a", "b"): (table(list(names), output), table(list(names), truth))


def test_schema_accuracy(table):
    truth = table(["a", "b"], [])
    for names, expected in ((["a", "b"], 1.0), (["b", "a"], 0.0), (["a", "b", "c"], 1.0), (["a"], 0.5)):
        assert value("schema_accuracy", table(names, []), truth) == expected
    assert value("schema_accuracy", truth, truth.select(POS)) == 1.0


def test_row_accuracy(two, table):
    right = [["7", "q"], ["8", "r"], ["9", "s"]]
    assert value("row_accuracy", *two(right, right[::-1])) == 1.0
    assert value("row_accuracy", *two(right, [*right[:2], ["3", "w"]])) == pytest.approx(2 / 3)
    assert value("row_accuracy", *two([["1", "x"]] * 2, [["1", "x"]])) == 0.5
    assert value("row_accuracy", *two([], [["1", "x"]])) == 1.0
    assert value("row_accuracy", table(["b", "a"], []), table(["a", "b"], right)) == 0.0


@pytest.mark.parametrize("truth, output, expected", [(4, 3, 0.75), (4, 5, 0.75), (2, 9, 0.0), (0, 0, 1.0), (0, 1, 0.0)])
def test_filtering_accuracy(two, truth, output, expected):
    assert value("filtering_accuracy", *two([["1", "2"]] * truth, [["1", "2"]] * output)) == expected


def test_field_mapping_accuracy(two, table):
    truth = [["1", "x"]] * 2
    assert value("field_mapping_accuracy", *two(truth, [["1", "nan nan"], ["2", "Nanette 7"]])) == 0.75
    assert value("field_mapping_accuracy", *two(truth, [])) == 0.0
    assert value("field_mapping_accuracy", table(["b", "z"], [["x", "y"]]), table(["a", "b"], truth)) == 0.5
    details = METRICS["field_mapping_accuracy"](Scoring(*two(truth, truth))).first()["details"]
    assert details == {"a": "1.0", "b": "1.0"}


def test_a_column_may_be_called_name(table):
    t = table(["name", "score"], [["a", "b"]])
    assert value("field_mapping_accuracy", t, t) == 1.0


def test_transformation_accuracy(two, table):
    assert value("transformation_accuracy", *two([["1", "x"], ["2", "y"]], [["2", "w"], ["1", "x"]])) == 0.75
    assert value("transformation_accuracy", *two([], [["1", "x"]])) == 1.0
    assert value("transformation_accuracy", *two([["1", None]], [["2", None]])) == 0.5
    assert value("transformation_accuracy", table(["z"], []), table(["a"], [["1"]])) == 0.0


def test_record_accuracy(table):
    names = list("abcde")
    truth = table(names, [list("12345"), list("67890")])
    output = table(names, [list("1234x"), list("678xx")])
    assert value("record_accuracy", output, truth) == 0.5  # 4 of 5 cells is enough
    assert value("record_accuracy", output, table(names, [])) == 1.0
    assert value("record_accuracy", table(["z"], []), truth) == 0.0


@pytest.fixture
def damaged(table):
    """Two source rows of which the noise changed one name."""
    clean = table(["id", "first", "last", "n"], [["1", "a", "b", "5"], ["2", "c", "d", "5"], ["3", "e", "f", "0"]])
    noisy = table(["id", "first", "last", "n"], [["1", "X", "b", "5"], ["1", "a", "b", "5"], ["2", "c", "d", "5"], ["3", "Y", "f", "0"]])
    rules = task(
        "T",
        {"field": "n", "operator": ">", "value": 1},
        [rule("id", "id", "copy"), rule(["first", "last"], "name", "concatenate"), rule("first", "given", "copy")],
    )
    truth = table(["id", "name", "given"], [["1", "ab", "a"], ["2", "cd", "c"]])
    config = noise(1, ["id"], ("typo", 0.1))
    return dict(clean=clean, noisy=noisy, task=rules, truth=truth, noise=config)


def correction(damaged, output, **change):
    row = METRICS["error_correction_accuracy"](Scoring(output=output, **{**damaged, **change})).first()
    return row["score"], row["details"]


def test_error_correction(damaged, table):
    names = ["id", "name", "given"]
    assert correction(damaged, damaged["truth"])[0] == 1.0
    half = table(names, [["2", "cd", "c"], ["1", "ab", "X"]])
    score_, details = correction(damaged, half)
    assert score_ == 0.5 and details == {"applicable": "true", "checked": "2", "correct": "1"}
    assert correction(damaged, table(names, [["1", "Xb", "X"], ["2", "cd", "c"]]))[0] == 0.0
    assert correction(damaged, table(names, []))[0] == 0.0
    assert correction(damaged, table(["z"], [["1"]]))[0] == 0.0


def test_error_correction_where_it_does_not_apply(damaged, table):
    truth = damaged["truth"]
    cases = [
        {"noise": None},
        {"noise": noise(1, [], ("typo", 0.1))},
        {"noise": noise(1, ["nope"], ("typo", 0.1))},
        {"noisy": damaged["clean"]},
        {"truth": truth.filter("id = '1'")},
        {"task": task("T", {"field": "n", "operator": ">", "value": 1}, [])},
    ]
    for case in cases:
        assert correction(damaged, truth, **case)[0] == 1.0


def test_reproduction(two):
    again, original = two([["1", "x"], ["2", "y"]], [["1", "x"], ["9", "y"]])
    row = reproduction_score(original, again).first()
    assert (row["name"], row["score"]) == ("reproducibility", 0.5)


def test_evaluate(damaged, table):
    truth = damaged["truth"]
    good = evaluate(Scoring(output=truth, **damaged), "agent", 2.0, reproduced=truth.limit(1))
    assert good.passed and [m.name for m in good.metrics] == list(METRICS)
    assert good.reproducibility.score == 0.5
    bad = evaluate(Scoring(output=table(["z"], []), **damaged), "agent", 2.0)
    assert not bad.passed and bad.error is None
    failed = failed_run("T", "agent", "timeout", 1.0)
    assert failed.metrics == [] and not failed.passed and failed.error == "timeout"


def test_metrics_can_be_replaced(damaged):
    def rows_found(s):
        return s.output.agg(F.count(F.lit(1)).cast("double").alias("score")).selectExpr(
            "'rows' AS name", "score", "map('a', 'b') AS details"
        )

    results = score(Scoring(output=damaged["truth"], **damaged), {"rows": rows_found})
    assert [(m.name, m.score) for m in results] == [("rows", 2.0)]


def test_whole_rows_match_at_any_width(table):
    names = [f"c{i}" for i in range(64)]
    rows = [[f"v{i}{k}" for i in range(64)] for k in range(3)]
    assert matched(best_match(table(names, rows), table(names, rows[::-1]))) == [(0, 2, 64), (1, 1, 64), (2, 0, 64)]


def test_many_runs_score_as_each_alone(spark, damaged, table):
    """Shared and own expectations, a failed run, other columns, no rows."""
    names = [c for c in damaged["truth"].columns if c != POS]
    truth = damaged["truth"]
    outputs = [
        truth, truth.limit(1), truth.filter("false"), truth.drop(names[0]), truth.withColumn(names[-1], F.lit("nan")).unionAll(truth),
    ]
    scorings = [Scoring(output=o, **damaged) for o in outputs]
    plain = table(["a", "b"], [["1", None], ["2", "x"]])
    scorings.append(Scoring(output=table(["a", "b"], [["2", "y"], ["1", None], ["1", None]]), truth=plain))
    runs = [Run(f"agent {k}", s, float(k)) for k, s in enumerate(scorings)] + [Run("failed", scorings[0], error="timeout")]
    rows = evaluate_many(runs).orderBy(POS).collect()
    assert [r["agent_name"] for r in rows] == [r.agent_name for r in runs]
    for row, s in zip(rows, scorings):
        alone = {m.name: round(m.score, 9) for m in score(s)}
        assert {m["name"]: round(m["score"], 9) for m in row["metrics"]} == alone
        assert row["passed"] == all(v == 1.0 for v in alone.values())
    assert rows[-1]["metrics"] == [] and rows[-1]["error"] == "timeout" and rows[-1]["passed"] is False


def test_jobs_do_not_depend_on_the_number_of_runs(spark, damaged):
    def jobs(n):
        scoring = Scoring(output=damaged["truth"], **damaged)
        group = f"runs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        evaluate_many([Run(f"a{k}", scoring) for k in range(n)]).collect()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert abs(jobs(2) - jobs(6)) <= 2


def test_rounds_write_subsets_once_for_rows_alike(table, monkeypatch):
    from tabshift.operators import match

    for name, value in (("READ_ROWS", 0), ("ROUND_COST", 0), ("LIST_COST", 10**9)):
        monkeypatch.setattr(match, name, value)
    written, cut = [], match.cut_lineage
    monkeypatch.setattr(match, "cut_lineage", lambda df: written.append(set(df.columns)) or cut(df))
    truth = [["a", "b", "x"], ["b", "a", "y"], ["q", None, "z"]]
    output = [["a", "a", "z"], ["b", "b", "x"], [None, "a", "w"]]
    assert matched(best_match(table(["k", "l", "m"], truth), table(["k", "l", "m"], output))) == brute_best(truth, output)
    assert any("_cols" in c for c in written)
    assert not any({"_t", "_cols"} <= c for c in written)


@pytest.mark.parametrize("settings", [{"SENT_KEYS": 0}, {"UNROLLED": 0, "THIN_FROM": 0}])
def test_rounds_project_only_cells_that_can_agree(table, monkeypatch, settings):
    """Output rows are projected on columns with cells of truth rows alone, once for rows alike, and
    truth rows with the same unread cells ask once."""
    for name, value in {"READ_ROWS": 0, "ROUND_COST": 0, "LIST_COST": 10**9, **settings}.items():
        monkeypatch.setattr(match, name, value, raising=False)
    projected, asked, wanted, lookup = [], [], match._wanted, match._lookup
    monkeypatch.setattr(match, "_wanted", lambda rows, keys: projected.append(rows.count()) or wanted(rows, keys))

    def counted(left, index, rows):
        if "_size" in left.columns:
            asked.append(left.count())
        return lookup(left, index, rows)

    monkeypatch.setattr(match, "_lookup", counted)
    # one or two cells of a row agree, in any column
    truth = [[f"id{k}", "a", "b", "c", "d", "e"] for k in range(12)]
    output = [[f"o{k}", *(c if k % 5 in (i, (i + k % 2) % 5) else f"x{k}{i}" for i, c in enumerate("abcde"))] for k in range(40)]
    names = ["id", *"klmno"]
    assert matched(best_match(table(names, truth), table(names, output))) == brute_best(truth, output)
    # postings, cells that can agree, and then less than one projection for each output row
    assert sum(projected) < 2 * 40 * 6 + 40
    # each subset of two or more of five columns at most once
    assert sum(asked) <= 26
