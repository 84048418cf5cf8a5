"""Quality rules: robust multivariate outliers by minimum covariance determinant.

A document's statistics (length, word length, symbols, repeated lines, repeated word windows)
are transformed into a vector. For each language and source the MCD gives a centre and a
scatter that outliers cannot pull: from a start by medians and quartiles, concentration steps
take the half of the rows with the smallest Mahalanobis distances and estimate anew, until a
group's determinant falls no further. Every group has its own estimate, shrunk towards its
language's, and that towards the estimate of all, by n / (n + `SHRINK_ROWS`) for n rows: the
weight of a group grows smoothly with its rows. A document far from its group is rejected.

Everything is DataFrame functions. A concentration step is one aggregation: distances fall
into fine logarithmic buckets, and each (group, bucket) keeps its count, sums and products,
so the half is a running total over at most `BUCKETS` rows a group, and a group of any size
is pre-aggregated before its shuffle. Estimates are written and sent to the rows, or, where
there are too many of them, met by rows dealt over salted copies: no task takes a whole
group. Statistics and estimates cover all rows.

Defined cases: a null or empty text has no words and fails the base rules; null languages
and sources are groups of their own; windows are compared by 64-bit hashes; a statistic
that is constant in a group gets the scatter floor of that statistic; repeated rows count
as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabshift.llm.common import BROADCAST_BYTES, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows at which a group's own estimate weighs as much as its parent's.
SHRINK_ROWS = 50
#: A step goes on where the determinant falls by more than this share.
LEAST_FALL = 1e-6
#: Copies of an estimate, where they are too many to be sent to all tasks.
SALTS = 32
#: 0.99999 quantile and median of chi-square with five degrees of freedom.
CUTOFF, MEDIAN = 30.856, 4.3515
#: Least standard deviation of each statistic, so that constant ones can be inverted.
FLOORS = [0.3, 0.05, 0.05, 0.15, 0.15]
DIM = len(FLOORS)
BUCKETS_PER_UNIT, BUCKETS = 64, 4096
START_GRID = 100

_SPACE = "[ \\t-\\r]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


# ---------------------------------------------------------------- statistics of a text


def _repeated(windows: str) -> tuple[Column, Column, Column]:
    """Words inside three-word windows that occur twice or more. `windows`: their hashes.
    Sorted with their positions, equal windows stand side by side; the positions of those
    that do, in order, cover at most three words each."""
    places = F.expr(f"sort_array(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))")
    hit = F.expr(
        "sort_array(transform(filter(sequence(0, size(z) - 1), k -> coalesce(get(z, k).h = get(z, k - 1).h, false)"
        " or coalesce(get(z, k).h = get(z, k + 1).h, false)), k -> get(z, k).i))"
    )
    total = F.expr(
        "aggregate(sequence(0, size(p) - 1), 0L, (n, k) -> n + least(3, coalesce(get(p, k + 1) - get(p, k), 3)))"
    )
    return places, hit, total


def statistics(docs: DataFrame) -> DataFrame:
    """`docs` with _text replaced by n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and _n_lines."""
    kept = [c for c in docs.columns if c != "_text"]
    rows = docs.select(*kept, F.coalesce("_text", F.lit("")).alias("_t"))
    rows = rows.select(
        *kept,
        F.filter(F.split("_t", _SPACE), lambda w: w != "").alias("_w"),
        F.char_length(F.translate("_t", _SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: F.translate(x, _SPACES, "") != "").alias("_l"),
    )
    rows = rows.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "_n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.when(
                F.size("_w") > 3,
                F.expr("transform(sequence(0, size(_w) - 3), k -> xxhash64(get(_w, k), get(_w, k + 1), get(_w, k + 2)))"),
            ),
        }
    ).drop("_w", "_l")
    places, hit, total = _repeated("_h")
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn("z", F.when(again, places)).drop("_h")
    rows = rows.withColumn("p", hit).drop("z")
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("_n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p(n.cast("double")),
        F.log(chars / n),
        F.sqrt(F.least(F.col("n_symbols") / chars, F.lit(1.0))),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


# ---------------------------------------------------------------- estimates


def _x(k: int) -> Column:
    return F.col(f"_x{k}")


def _start(rows: DataFrame) -> DataFrame:
    """_g, centre and inverse factor from medians and quartiles on a grid: rows whose
    factor is diagonal."""
    cells = rows.select("_g", F.posexplode(F.array(*(F.floor(_x(k) * START_GRID) for k in range(DIM)))).alias("_k", "_c"))
    counts = cells.groupBy("_g", "_k", "_c").agg(F.count("*").alias("_n"))
    part = Window.partitionBy("_g", "_k")
    up = part.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_up": F.sum("_n").over(up), "_all": F.sum("_n").over(part)})
    at = lambda q: F.min(F.when(F.col("_up") >= q * F.col("_all"), F.col("_c"))) / START_GRID
    by_dim = counts.groupBy("_g", "_k").agg(at(0.25).alias("_q1"), at(0.5).alias("_q2"), at(0.75).alias("_q3"))
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, c))
    spread = lambda k: F.sqrt(F.pow((F.col("_q3") - F.col("_q1")) / 1.349, 2) + FLOORS[k] ** 2)
    return by_dim.groupBy("_g").agg(
        *(pick(k, F.col("_q2")).alias(f"_m{k}") for k in range(DIM)),
        *(
            (1.0 / pick(k, spread(k)) if j == k else F.lit(0.0)).alias(f"_i{k}{j}")
            for k in range(DIM)
            for j in range(k + 1)
        ),
    )


def _squared() -> Column:
    terms = []
    for k in range(DIM):
        z = sum((F.col(f"_i{k}{j}") * (_x(j) - F.col(f"_m{j}")) for j in range(k + 1)), F.lit(0.0))
        terms.append(z * z)
    return sum(terms, F.lit(0.0))


def _with(rows: DataFrame, table: DataFrame, key: str = "_g", how: str = "inner") -> DataFrame:
    """Rows with the entry of their group in a written table of one row a group."""
    if table.count() * 8 * len(table.columns) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*(f"_x{k}" for k in range(DIM))), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """`rows` with the squared distance _d: |W (x - m)|^2 with W the inverse factor."""
    return _with(rows, estimate).withColumn("_d", _squared())


def _bucket(d: Column) -> Column:
    return F.least(F.floor(F.log1p(d) * BUCKETS_PER_UNIT), F.lit(BUCKETS - 1))


def _inverse_factor(moments: DataFrame) -> DataFrame:
    """From _s (scatter, lower triangle) to the inverse of its Cholesky factor, one column
    a step, so that no expression holds another one twice."""
    out = moments
    for j in range(DIM):
        inner = sum((F.col(f"_l{j}{t}") * F.col(f"_l{j}{t}") for t in range(j)), F.lit(0.0))
        out = out.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(F.col(f"_s{j}{j}") - inner, F.lit(FLOORS[j] ** 2 / 4))))
        out = out.withColumns(
            {
                f"_l{k}{j}": (
                    F.col(f"_s{k}{j}") - sum((F.col(f"_l{k}{t}") * F.col(f"_l{j}{t}") for t in range(j)), F.lit(0.0))
                )
                / F.col(f"_l{j}{j}")
                for k in range(j + 1, DIM)
            }
        )
    for k in range(DIM):
        out = out.withColumn(f"_i{k}{k}", 1.0 / F.col(f"_l{k}{k}"))
        out = out.withColumns(
            {
                f"_i{k}{j}": -sum((F.col(f"_l{k}{t}") * F.col(f"_i{t}{j}") for t in range(j, k)), F.lit(0.0))
                / F.col(f"_l{k}{k}")
                for j in range(k)
            }
        )
    return out


_PAIRS = [(k, j) for k in range(DIM) for j in range(k + 1)]
_FACTOR = [f"_m{k}" for k in range(DIM)] + [f"_i{k}{j}" for k, j in _PAIRS]
#: Centre and scatter.
_SHAPE = [f"_m{k}" for k in range(DIM)] + [f"_s{k}{j}" for k, j in _PAIRS]


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: centre, scatter, inverse factor, rows and determinant."""
    near = _distance(rows, estimate).withColumn("_b", _bucket(F.col("_d")))
    sums = near.groupBy("_g", "_b").agg(
        F.count("*").alias("_n"),
        *(F.sum(_x(k)).alias(f"_a{k}") for k in range(DIM)),
        *(F.sum(_x(k) * _x(j)).alias(f"_p{k}{j}") for k in range(DIM) for j in range(k + 1)),
    )
    part = Window.partitionBy("_g")
    up = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_n").over(up), F.lit(0)), "_all": F.sum("_n").over(part)})
    half = sums.filter(F.col("_before") < F.floor((F.col("_all") + DIM + 1) / 2))
    total = half.groupBy("_g").agg(
        F.sum("_n").alias("_h"),
        F.first("_all").alias("_rows"),
        *(F.sum(f"_a{k}").alias(f"_a{k}") for k in range(DIM)),
        *(F.sum(f"_p{k}{j}").alias(f"_p{k}{j}") for k in range(DIM) for j in range(k + 1)),
    )
    h = F.col("_h")
    moments = total.select(
        "_g",
        "_rows",
        *((F.col(f"_a{k}") / h).alias(f"_m{k}") for k in range(DIM)),
        *(
            (
                F.col(f"_p{k}{j}") / h - F.col(f"_a{k}") / h * (F.col(f"_a{j}") / h) + (FLOORS[k] ** 2 if j == k else 0.0)
            ).alias(f"_s{k}{j}")
            for k in range(DIM)
            for j in range(k + 1)
        ),
    )
    log_det = sum((2 * F.log(F.col(f"_l{k}{k}")) for k in range(DIM)), F.lit(0.0))
    return _inverse_factor(moments).select("_g", "_rows", log_det.alias("_det"), *_SHAPE, *_FACTOR[DIM:])


def _scale(near: DataFrame, group: str) -> DataFrame:
    """`group`, _scale: median squared distance _d over the chi-square median, at least 1:
    the scatter of the inner half understates that of all clean rows."""
    counts = near.groupBy(group, _bucket(F.col("_d")).alias("_b")).agg(F.count("*").alias("_n"))
    part = Window.partitionBy(group)
    up = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_up": F.sum("_n").over(up), "_all": F.sum("_n").over(part)})
    median = F.min(F.when(F.col("_up") * 2 >= F.col("_all"), F.col("_b") + 1))
    return counts.groupBy(group).agg(F.greatest(F.expm1(median / BUCKETS_PER_UNIT) / MEDIAN, F.lit(1.0)).alias("_scale"))


def estimates(rows: DataFrame) -> DataFrame:
    """Centre, scatter and rows of each group _g of rows with _x0.._x4. A group takes steps
    until its determinant falls no further; each step is one pass for all open groups."""
    state = written(_concentrate(rows, written(_start(rows))))
    done = None
    while not state.isEmpty():
        open_rows = _with(rows, written(state.select("_g")))
        before = state.select("_g", *(F.col(c).alias(f"{c}_") for c in state.columns if c != "_g"))
        both = written(_concentrate(open_rows, state.select("_g", *_FACTOR)).join(before, "_g"))
        falls = F.col("_det") < F.col("_det_") - LEAST_FALL
        rest = both.filter(~falls).select("_g", F.col("_rows_").alias("_rows"), *(F.col(f"{c}_").alias(c) for c in _SHAPE))
        done = rest if done is None else done.unionAll(rest)
        state = written(both.filter(falls).select(*state.columns))
    return state.select("_g", "_rows", *_SHAPE) if done is None else done


def _shrunk(own: DataFrame, parent: DataFrame, up: str) -> DataFrame:
    """`own` (_g, `up`, _rows, shape) drawn towards the shape of its parent group."""
    w = F.col("_rows") / (F.col("_rows") + SHRINK_ROWS)
    above = parent.select(F.col("_g").alias(up), *(F.col(c).alias(f"{c}_") for c in _SHAPE))
    mixed = {c: w * F.col(c) + (1 - w) * F.col(f"{c}_") for c in _SHAPE}
    return own.join(above, up).select(*own.drop(*_SHAPE).columns, *(v.alias(c) for c, v in mixed.items()))


def _own_groups() -> dict[str, Column]:
    """The groups of a row, finest first; text, so that nulls are groups too."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return {
        "_g0": F.concat_ws("\0", F.lit("source"), part("_lang"), part("_source")),
        "_g1": F.concat_ws("\0", F.lit("language"), part("_lang")),
        "_g2": F.lit("all"),
    }


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]


def quality(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """`docs` without the text, with the statistics, base_failed, distance (null where no
    row has an estimate) and kept; these replace columns of the same names."""
    others = [c for c in docs.columns if c != text and c.lower() not in RESULT]
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("_o"),
        *(F.col(f"`{c}`").alias(n) for c, n in ((text, "_text"), (language, "_lang"), (source, "_source"))),
    )
    stats = written(statistics(packed))
    rows = stats.withColumns({f"_x{k}": v for k, v in enumerate(vector())} | _own_groups())
    clean = rows.filter(~base_failed()).select("_g0", "_g1", "_g2", *(f"_x{k}" for k in range(DIM)))
    groups = written(clean.select("_g0", "_g1", "_g2").distinct())
    spread = clean.select(F.explode(F.array("_g0", "_g1", "_g2")).alias("_g"), *(f"_x{k}" for k in range(DIM)))
    raw = written(estimates(spread))
    named = lambda g, *up: groups.select(F.col(g).alias("_g"), *up).distinct().join(raw, "_g")
    languages = _shrunk(named("_g1", "_g2"), raw, "_g2")
    factors = _inverse_factor(_shrunk(named("_g0", "_g1"), languages, "_g1"))
    learned = written(factors.select(F.col("_g").alias("_g0"), "_rows", *_FACTOR))
    near = _with(clean, learned, "_g0").select("_g0", "_g2", _squared().alias("_d"))
    # the scale of few rows is drawn towards that of all rows as well
    everywhere = _scale(near, "_g2").select(F.col("_scale").alias("_scale_"))
    w = F.col("_rows") / (F.col("_rows") + SHRINK_ROWS)
    scaled = learned.join(_scale(near, "_g0"), "_g0").crossJoin(F.broadcast(everywhere))  # one row
    learned = written(scaled.withColumn("_scale", w * F.col("_scale") + (1 - w) * F.col("_scale_")).drop("_scale_", "_rows"))
    found = _with(rows, learned, "_g0", "left")
    far = _squared() / F.col("_scale")
    return found.select(
        *(F.col(f"_o.`{c}`") for c in others),
        *RESULT[:5],
        base_failed().alias("base_failed"),
        F.sqrt(far).alias("distance"),
        (~base_failed() & F.coalesce(far <= CUTOFF, F.lit(True))).alias("kept"),
    )
