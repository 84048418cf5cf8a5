"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a white-space separated word with at least `LONG` characters among which is a
digit, or one of at least `SHORT` that is assigned to a name of a secret. The forest looks at
its length, its character classes and transitions (how well its letter pairs fit the
corpus's words), how much of it dictionary words cover, the path of its document and the
words beside it. It is trained from labelled findings; `rule_labels` gives such labels where
nobody has labelled any: clear assignments are secrets, numbers, addresses, links and words
are not, and everything else stays unlabelled and is for the forest to judge.

All of it is DataFrame functions and Spark's own forest. Words are counted over all
documents: the letter pairs are those of all words, the dictionary has each word with at
least `WORD_SHARE` of all, so at most one over that share of them. A word is 2 to 20 letters
of a text without its tokens that hold a digit: copies of a secret are not words. The forest
is fitted on a bounded sample of findings (`MAX_FINDINGS`, chosen by a hash); candidates are
searched in all whole texts.

Defined cases: null and empty texts have no candidate; without labels of both kinds there is
no forest and the score is 1 for candidates that the labels call secrets, else 0; repeated
rows give repeated findings; a null path is empty.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import written

LONG, SHORT = 16, 8
WORD_SHARE = 1e-4
MAX_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5

# Names under which secrets are written down, and words of samples.
NAMES = "(token|secret|passw|pwd|api_?-?key|access_?-?key|auth|credential|bearer|private)"
SAMPLES = "(example|sample|dummy|test|placeholder|changeme|xxxx)"

_SPACE = "[ \\t-\\r]+"
_ASSIGN = "('=', ':', ':=', '=>')"


# ---------------------------------------------------------------- candidates


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """id, position (word number), candidate, before (two words), after, path."""
    rows = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
        F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), _SPACE).alias("w"),
    )
    assigned = (
        f"get(w, i - 1) in {_ASSIGN} and lower(get(w, i - 2)) rlike '{NAMES}'"
        f" or lower(x) rlike '{NAMES}[a-z_-]*[\"\\']?[=:].'"
        f" or get(w, i - 1) rlike '[=:]$' and lower(get(w, i - 1)) rlike '{NAMES}'"
    )
    found = F.expr(
        "filter(transform(w, (x, i) -> case when length(x) < 8 then null"
        f" when length(x) >= {LONG} and x rlike '[0-9]' or ({assigned}) then named_struct("
        "'position', i, 'word', x, 'before', concat_ws(' ', get(w, i - 2), get(w, i - 1)), 'after', get(w, i + 1))"
        " end), c -> c is not null)"
    )
    each = rows.select("id", "path", F.explode(found).alias("c"))
    core = F.regexp_replace(F.regexp_replace("c.word", "^[A-Za-z_-]+[\"']?[=:]+", ""), "^[\"'(\\[{<]+|[\"')\\]}>,.;:!?#*$%&]+$", "")
    return each.select(
        "id",
        "path",
        F.col("c.position").alias("position"),
        F.col("c.word").alias("word"),
        core.alias("candidate"),
        F.lower("c.before").alias("before"),
        F.lower(F.coalesce("c.after", F.lit(""))).alias("after"),
    ).filter(F.length("candidate") >= SHORT)


# ---------------------------------------------------------------- features


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: all words of all documents, written."""
    plain = F.regexp_replace(F.lower(F.col(f"`{text}`")), "(?<![^ \\t-\\r])[^ \\t-\\r0-9]*+[0-9][^ \\t-\\r]*+", " ")
    words = docs.select(F.explode(F.split(plain, "[^a-z]+")).alias("word"))
    return written(words.filter(F.length("word").between(2, 20)).groupBy("word").agg(F.count("*").alias("n")))


def frequent_words(counts: DataFrame, share: float = WORD_SHARE) -> list[tuple[str, int]]:
    """The words with at least this share of all: at most one over the share of them."""
    least = share * (counts.agg(F.sum("n")).first()[0] or 0)
    return [(r["word"], r["n"]) for r in counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()]


def corpus_words(docs: DataFrame, text: str = "text") -> list[tuple[str, int]]:
    """The frequent words of all documents: a list of bounded length."""
    return frequent_words(word_counts(docs, text))


def letter_pairs(counts: DataFrame) -> dict[str, int]:
    """How often a letter follows a letter in all words; at most 26 x 26 entries."""
    pair = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    pairs = counts.select(F.explode(pair).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in pairs.collect()}


def _pair_table(pairs: dict[str, int]) -> list[float]:
    """Log probability of a letter after a letter, 26 x 26."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    total = {a: sum(pairs.get(a + b, 0) for b in letters) for a in letters}
    return [log((pairs.get(a + b, 0) + 1) / (total[a] + 26)) for a in letters for b in letters]


def _any_of(words: list[str]) -> str:
    """Pattern of the longest of the words at a place: beginnings in common stand once, so
    its cost does not grow with their number."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        further = [c + pattern(at[c]) for c in sorted(at) if c]
        if not further:
            return ""
        body = further[0] if len(further) == 1 and "" not in at else f"(?:{'|'.join(further)})"
        return body + "?" if "" in at else body

    return pattern(tree)


def features(words: list[tuple[str, int]], pairs: dict[str, int] | None = None) -> dict[str, Column]:
    """`words`: the dictionary. `pairs`: letter pairs of all words, else those of `words`."""
    if pairs is None:
        pairs = {}
        for word, k in words:
            for a, b in zip(word, word[1:], strict=False):
                pairs[a + b] = pairs.get(a + b, 0) + k
    t, low = F.col("candidate"), F.lower("candidate")
    n = F.length(t).cast("double")
    share = lambda p: F.regexp_count(t, F.lit(p)) / n
    flag = lambda c: c.cast("double")
    known = _any_of([w for w, _ in words if len(w) >= 4])
    covered = 1 - F.length(F.regexp_replace(low, known, "")) / n if known else F.lit(0.0)
    table = F.array(*map(F.lit, _pair_table(pairs)))
    plain = F.regexp_replace(low, "[^a-z]", "")
    fit = F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.length(plain), F.lit(2))),
        F.lit(0.0),
        lambda s, i: s
        + F.coalesce(
            F.get(table, (F.ascii(plain.substr(i - 1, F.lit(1))) - 97) * 26 + F.ascii(plain.substr(i, F.lit(1))) - 97),
            F.lit(0.0),
        ),
    ) / F.greatest(F.length(plain) - 1, F.lit(1))
    characters = F.split(t, "")
    entropy = F.aggregate(
        F.array_distinct(characters),
        F.lit(0.0),
        lambda s, c: s - F.when(c == "", 0.0).otherwise(
            (n - F.length(F.replace(t, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(t, c, F.lit("")))) / n)
        ),
    )
    steps = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    return {
        "f_length": n,
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_lower": share("[a-z]"),
        "f_other": share("[^A-Za-z0-9]"),
        "f_hex": flag(low.rlike("^[0-9a-f]+$")),
        "f_steps": F.regexp_count(t, F.lit(steps)) / n,
        "f_pairs": fit,
        "f_entropy": entropy,
        "f_covered": covered,
        "f_address": flag(F.col("word").rlike("@|://|^[0-9.,:/+-]+$")),
        "f_named": flag(F.col("before").rlike(NAMES) | F.lower("word").rlike(f"{NAMES}.*[=:]")),
        "f_assigned": flag(F.col("before").rlike("[=:]>?$") | F.col("word").rlike("^[A-Za-z_-]+[\"']?[=:]")),
        "f_quoted": flag(F.col("word").rlike("[\"'`]")),
        "f_sample": flag(F.concat_ws(" ", "before", low, "after").rlike(SAMPLES)),
        "f_before": F.length("before").cast("double"),
        "f_after": F.length("after").cast("double"),
        "f_path_depth": F.regexp_count("path", F.lit("[/\\\\]")).cast("double"),
        "f_path_sample": flag(F.lower("path").rlike(SAMPLES)),
        "f_path_code": flag(F.lower("path").rlike("[.](py|js|ts|java|go|rb|sh|env|ya?ml|json|ini|cfg|conf|toml)$")),
    }


FEATURES = """f_length f_digits f_upper f_lower f_other f_hex f_steps f_pairs f_entropy f_covered f_address f_named
f_assigned f_quoted f_sample f_before f_after f_path_depth f_path_sample f_path_code""".split()


def rule_labels() -> Column:
    """1 for clear secrets, 0 for clear false positives, else null."""
    clear = (F.col("f_named") == 1) & (F.col("f_assigned") == 1) & (F.col("f_sample") == 0) & (F.col("f_entropy") >= 3.0) & (F.col("f_length") >= LONG)
    return (
        F.when(F.col("f_address") == 1, 0)
        .when(clear & (F.col("f_covered") < 0.5), 1)
        .when((F.col("f_named") == 0) & ((F.col("f_assigned") == 0) | (F.col("f_covered") >= 0.5)), 0)
    )


# ---------------------------------------------------------------- the forest


def train(labelled: DataFrame, most: int = MAX_FINDINGS) -> RandomForestClassificationModel | None:
    """`labelled`: the features and label (0 or 1). None without both labels."""
    counts = {r["label"]: r["n"] for r in labelled.filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.lit("findings"), "id", "position"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    keep = F.when(F.col("label") == 1, min(1.0, most / counts[1])).otherwise(min(1.0, most / counts[0]))
    weight = F.when(F.col("label") == 1, 1.0 / counts[1]).otherwise(1.0 / counts[0]) * (counts[0] + counts[1]) / 2
    rows = labelled.filter("label is not null").filter(draw < keep).withColumns({"weight": weight, "label": F.col("label").cast("double")})
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", labelCol="label")
    return forest.fit(rows.select("features", "label", "weight"))


def scan(
    docs: DataFrame,
    findings: DataFrame | None = None,
    id: str = "doc_id",
    text: str = "text",
    path: str = "source",
) -> DataFrame:
    """All candidates with score and secret. `findings`: (id, position, label) where
    people have labelled some; else the rules label."""
    counts = word_counts(docs, text)
    found = candidates(docs, id, text, path).withColumns(features(frequent_words(counts), letter_pairs(counts)))
    if findings is None:
        found = found.withColumn("label", rule_labels())
    else:
        found = found.join(findings.select("id", "position", "label"), ["id", "position"], "left")
    found = written(found)
    forest = train(found)
    if forest is None:
        scored = found.withColumn("score", F.coalesce(F.col("label"), F.lit(0)).cast("double"))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = forest.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        F.col("id").alias(id), "position", "candidate", "score", (F.col("score") >= THRESHOLD).alias("secret")
    )
