"""Size-aware heavy-light join on word shingles.

Documents with equal shingle sets are one class; classes are joined, copies never expanded.
A class links to another when the Jaccard similarity of their sets reaches the threshold.

*Light* classes, up to a boundary, enumerate the subsets of the size which two sets of given
sizes must share: a common subset is a link, once the sets confirm its hash. *Heavy* classes
scan inverted lists: with all shingles in one order, sets that share enough also share
enough of their first ones, so only those are listed, rare ones first. Two classes of which
one is heavy meet in the lists; light ones near the boundary are therefore listed as well.
The boundary is where enumerating costs least, from the histogram of the set sizes. A class
that lists too few shingles in common with all others together leaves the lists.

Only components are asked for, so a list is not turned into all its pairs. First each
member of a list is paired with two of its members alone, the one that shares most and the
least, which joins the members of a group of near copies; then pairs are formed only between
members of different components, all of them. Before sets are fetched, parity sketches rule
pairs out: each differing shingle flips one of `SKETCH_BITS` bits, so sketches differ in no
more bits than sets in shingles. Whole sets are then compared exactly. No list, pair or
candidate is capped.

The order of the shingles decides speed alone: those frequent in a bounded sample come last.
Shingles are compared by 64-bit hashes, classes by 128 bits of a digest.

Defined cases: null and empty texts and texts without words have no shingle and link with
nothing; fewer than three words are one shingle; repeated rows are equal documents; a null
id is in no place as a component's id unless all ids of the component are null.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import checked_broadcast, column, map_arrow, slices, written
from tabshift.llm.graph import components
from tabshift.llm.text import BLACK, mix, sequence_hash, windows, words

SHINGLE = 3
PERCENT = 90
#: Sets up to this size keep all their shingles in the class table and may be light.
MAX_LIGHT = 64
#: Cost of a listed shingle, with what its list brings, in enumerated subsets.
LISTED_COST = 12
#: Rows of the sample that orders shingles, and the share which makes one frequent.
ORDER_SAMPLE = 20_000
FREQUENT_SHARE = 1e-4
#: Frequent shingles that are sent to all tasks, 8 bytes each.
FREQUENT_MOST = 1_000_000
#: Bits of a listed shingle; sets that only share such a part of a hash are told apart later.
TOKEN_BITS = 40
SKETCH_BITS = 1024


# ---------------------------------------------------------------- sizes


def shared(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of these sizes."""
    return ceil(Fraction(percent * (a + b), 100 + percent))


def partners(size: int, percent: int) -> range:
    """Sizes that a set can link to."""
    return range(ceil(Fraction(percent * size, 100)), floor(Fraction(100 * size, percent)) + 1)


def extra(size):
    """Shingles that linked sets must share within their listed ones."""
    return 1 + size // 20


def listed(size, percent: int):
    """How many of a set's first shingles are listed: with at least `percent` % of the set
    in common, the first `extra` common ones stand among them."""
    return size - (percent * size + 99) // 100 + extra(size)


def boundary(histogram: dict[int, int], percent: int) -> int:
    """Largest light size: cost of enumerating up to it plus cost of listing from the
    smallest partner of the next size on."""
    light = 0
    best = (sum(n * min(s, listed(s, percent)) * LISTED_COST for s, n in histogram.items()), 0)
    for b in range(1, MAX_LIGHT + 1):
        light += histogram.get(b, 0) * sum(comb(b, b - shared(b, t, percent)) if shared(b, t, percent) <= b else 0 for t in partners(b, percent))
        heavy = sum(
            n * min(s, listed(s, percent)) * LISTED_COST for s, n in histogram.items() if s >= partners(b + 1, percent)[0]
        )
        best = min(best, (light + heavy, b))
    return best[1]


# ---------------------------------------------------------------- shingle sets


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    w = words(texts, BLACK, lower=True)
    h = w.hashes()
    hashes, owner = windows(w, h, size)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, n in enumerate(w.counts.tolist()):
        if n >= size:
            out.append(np.unique(hashes[first[k] : first[k + 1]]))
        else:
            out.append(np.array([sequence_hash(h[w.first[k] : w.first[k + 1]])] if n else [], np.uint64))
    return out


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def digest_of(shingles: np.ndarray) -> bytes | None:
    """The class of a set, in 128 bits."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def frequent_shingles(rows: DataFrame, size: int, sample: int, share: float) -> np.ndarray:
    """Hashes frequent in a bounded sample of rows, at most FREQUENT_MOST of them: any
    subset does, as it orders lists only."""
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("order"), F.monotonically_increasing_id()), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.filter(draw < min(1.0, sample / max(n, 1)))

    def run(batches):
        for part in slices(batches, "text"):
            values, counts = np.unique(np.concatenate([*shingle_sets(column(part, "text"), size), np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "n"])

    counts = map_arrow(picked.select("text"), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(2, ceil(min(n, sample) * share))
    several = written(counts.filter(F.col("n") >= least))
    while several.filter(F.col("n") >= least).count() > FREQUENT_MOST:
        least *= 2
    found = several.filter(F.col("n") >= least).select("h").toArrow()["h"].to_numpy()
    return np.sort(found.view(np.uint64))


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the counts of shingles by bucket."""
    bucket = (shingles % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bucket, minlength=SKETCH_BITS) & 1).tobytes()


def document_sets(rows: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """id, text_hash, node (a number of the row's own), n_shingles, digest (null without
    shingles), sketch and items: the whole set up to MAX_LIGHT, else its listed shingles, in
    list order. To be written before use: numbers follow the partitions of this run."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often, node = sent.value, TaskContext.get().partitionId() << 33
        for part in slices(batches, "text"):
            sets = shingle_sets(column(part, "text"), size)
            digests, items = [], []
            for s in sets:
                digests.append(digest_of(s))
                if len(often) and len(s):
                    k = np.searchsorted(often, s)
                    k[k == len(often)] = 0
                    last = often[k] == s
                    s = np.concatenate([s[~last], s[last]])
                items.append(s if len(s) <= MAX_LIGHT else s[: listed(len(s), percent)])
            yield pa.RecordBatch.from_arrays(
                [
                    column(part, "id"),
                    column(part, "text_hash"),
                    pa.array(np.arange(node, node + len(sets))),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists([np.frombuffer(sketch(s), np.uint64) for s in sets]),
                    _lists(items),
                ],
                ["id", "text_hash", "node", "n_shingles", "digest", "sketch", "items"],
            )
            node += len(sets)

    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, text_hash bigint, node bigint, n_shingles bigint, digest binary, sketch array<bigint>, items array<bigint>"
    return map_arrow(rows, run, fields)


# ---------------------------------------------------------------- light


def light_edges(classes: DataFrame, most: int, percent: int) -> DataFrame:
    """Edges between classes up to `most` shingles, by subsets in common; they join all that link.

    A subset's classes have two sizes at most. Each is paired with one of the smaller size: all
    of those link with it, while two of the larger size may share too little for theirs."""

    def run(batches):
        for part in batches:
            keys, nodes, low, same = [], [], [], []

            def flush():
                arrays = [pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], nodes, low, same)]
                for x in (keys, nodes, low, same):
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, ["key", "node", "low", "same"])

            for node, items in zip(column(part, "node").to_pylist(), column(part, "items"), strict=True):
                h = mix(items.values.to_numpy().view(np.uint64))
                s, total = len(h), h.sum()
                for t in partners(s, percent):
                    need = shared(s, t, percent)
                    if need > min(s, t) or t > most:
                        continue
                    left = np.array(list(combinations(range(s), s - need)), np.int64).reshape(comb(s, need), s - need)
                    pair = mix(np.array([min(s, t) << 32 | max(s, t)], np.uint64))
                    keys.append(mix((total - h[left].sum(axis=1, dtype=np.uint64)) ^ pair))
                    nodes.append(np.full(len(left), node))
                    low.append(np.full(len(left), s <= t))
                    same.append(np.full(len(left), s == t))
                if len(keys) >= 2000:
                    yield flush()
            if keys:
                yield flush()

    small = classes.filter(F.col("n") <= most).select("node", "items")
    keys = map_arrow(small, run, "key bigint, node bigint, low boolean, same boolean")
    # a key is 64 bits of a subset: the sets themselves decide
    left, right = (small.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    both, sizes = F.size(F.array_intersect("items_a", "items_b")), F.size("items_a") + F.size("items_b")
    edges = None
    while True:
        ends = (F.min("node").alias("first"), F.max("node").alias("last"), F.max("same").alias("same"), F.min("low").alias("alike"))
        groups = keys.groupBy("key").agg(F.min(F.when(F.col("low"), F.col("node"))).alias("b"), *ends)
        groups = groups.filter("b is not null and first < last and (same or not alike)").select("key", "b")
        near = keys.join(groups, "key").filter("node <> b")
        found = near.select(F.col("node").alias("a"), "b").distinct()
        judged = written(found.join(left, "a").join(right, "b").select("a", "b", (100 * both >= percent * (sizes - both)).alias("links")))
        linked = judged.filter("links").select("a", "b")
        edges = linked if edges is None else edges.union(linked)
        apart = judged.filter("not links")
        if apart.isEmpty():
            return edges
        # two subsets have one key: once more without the class that all were paired with
        mixed = near.join(apart.select(F.col("a").alias("node"), "b"), ["node", "b"]).select("key").distinct()
        keys = written(near.join(mixed, "key").select("key", "node", "low", "same"))


# ---------------------------------------------------------------- heavy


def _several(lists: DataFrame) -> DataFrame:
    """token, node, n without the tokens that one class alone lists."""
    # most tokens are listed once: combining them before the shuffle only takes memory
    dealt = lists.repartition("token")
    tokens = dealt.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    return dealt.join(tokens.select("token"), "token")


def postings(classes: DataFrame, least: int, percent: int) -> DataFrame:
    """token, node, n, k: listed shingles of classes with at least `least` which others
    list too, and how many of a class's these are. A class with too few of them for any
    partner is left out."""
    n = F.col("n")
    short = F.transform("items", lambda t: t.bitwiseAND(F.lit((1 << TOKEN_BITS) - 1)))
    first = F.slice(short, 1, (n - F.floor((percent * n + 99) / 100) + 1 + F.floor(n / 20)).cast("int"))
    rows = _several(classes.filter(n >= least).select(F.explode(first).alias("token"), "node", "n"))
    smallest = F.floor((percent * F.max("n") + 99) / 100)
    counts = rows.groupBy("node").agg(F.count("*").alias("k"), (1 + F.floor(smallest / 20)).alias("need"))
    return rows.join(counts.filter("k >= need").select("node", "k"), "node")


def _possible(a: str, b: str, sketch_a: str, sketch_b: str, percent: int):
    """Sizes that can link, and sketches no further apart than linked sets are."""
    total, whole = F.col(a) + F.col(b), 100 + percent
    need = F.floor((percent * total + whole - 1) / whole)
    apart = F.aggregate(F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    return sizes & F.when(sizes, apart <= total - 2 * need).otherwise(False)


def star_pairs(lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the one that shares most shingles and with the least.
    These pairs only speed up what follows."""
    dealt = lists.repartition("token")
    ends = dealt.groupBy("token").agg(F.max(F.struct("k", "node")).alias("most"), F.min("node").alias("least"))
    near = dealt.join(ends, "token").select("node", F.explode(F.array("most.node", "least")).alias("other"))
    pairs = near.filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    for k in "ab":
        pairs = pairs.join(sketches.select(*(F.col(c).alias(f"{c}{k}" if c != "node" else k) for c in sketches.columns)), k)
    return pairs.filter(_possible("na", "nb", "sketcha", "sketchb", percent)).select("a", "b", "na", "nb")


def cross_pairs(lists: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs in a list in common that are in different components and that sizes and
    sketches do not rule out."""
    rows = lists.select("token", "node", "n").join(labels, "node", "left")
    dealt = rows.select("token", "node", "n", F.coalesce("label", "node").alias("c")).repartition("token")
    mixed = dealt.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
    open_ = written(dealt.join(mixed, "token"))
    open_ = open_.join(sketches.select("node", "sketch"), "node")
    left, right = (open_.select(*(F.col(c).alias(f"{c}{k}") for c in ("token", "node", "n", "c", "sketch"))) for k in "ab")
    near = (F.col("nodea") < F.col("nodeb")) & (F.col("ca") != F.col("cb"))
    possible = _possible("na", "nb", "sketcha", "sketchb", percent)
    pairs = left.join(right, (F.col("tokena") == F.col("tokenb")) & near & possible)
    return pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), "na", "nb").distinct()


def verified(pairs: DataFrame, members: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs whose whole sets reach the threshold. `rows`: id, text and text_hash.

    A class's text is that of the row it is named by, found by that row's id, null or not,
    and the hash of its text: a row matches one class at most."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(nodes.join(members.select("node", F.col("id").alias("of"), F.col("text_hash").alias("h"), "digest"), "node"))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("h"))
    texts = rows.join(checked_broadcast(wanted), same).select("node", "digest", "text")

    def run(batches):
        seen = set()  # rows with id and text in common are read once a task
        for part in slices(batches, "text"):
            nodes, digests = (column(part, c).to_pylist() for c in ("node", "digest"))
            new = [k for k, n in enumerate(nodes) if n not in seen]
            if not new:
                continue
            nodes, digests = [nodes[k] for k in new], [digests[k] for k in new]
            sets = shingle_sets(column(part, "text").take(pa.array(new)), size)
            own = [k for k, s in enumerate(sets) if digest_of(s) == digests[k]]
            seen.update(nodes[k] for k in own)
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[k] for k in own], pa.int64()), _lists([sets[k] for k in own])], ["node", "items"]
                )

    sets = map_arrow(texts, run, "node bigint, items array<bigint>").groupBy("node").agg(F.first("items").alias("items"))
    left, right = (sets.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    both = F.size(F.array_intersect("items_a", "items_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


# ---------------------------------------------------------------- operator


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """id, n_shingles, component_id and n_classes (different sets in the component)."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    frequent = frequent_shingles(rows, size, ORDER_SAMPLE, FREQUENT_SHARE)
    members = written(document_sets(rows, size, percent, frequent))
    found = members.filter("digest is not null")
    classes = written(
        found.groupBy("digest").agg(F.min("id").alias("id"), F.min("node").alias("node"), F.max("n_shingles").alias("n"))
    )
    # one row stands for its class; it is named by its number, not by an id that may repeat
    stands = checked_broadcast(classes.select("node"))
    reps = members.join(stands, "node", "left_semi").select("node", F.col("n_shingles").alias("n"), "sketch", "items")
    histogram = {r["n"]: r["c"] for r in classes.groupBy("n").agg(F.count("*").alias("c")).collect()}
    most = boundary(histogram, percent)
    edges = light_edges(reps, most, percent)
    lists = written(postings(reps, partners(most + 1, percent)[0], percent))
    sketches = reps.select("node", "n", "sketch")
    stars = written(verified(written(star_pairs(lists, sketches, percent)), members, rows, size, percent))
    labels = components(edges.union(stars))
    rest = written(verified(written(cross_pairs(lists, labels, sketches, percent)), members, rows, size, percent))
    # what the last links join are components already
    final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(rest))
    labelled = classes.join(final, "node", "left").select("digest", "id", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("n_classes"))
    of_set = labelled.select("digest", "label").join(least, "label").select("digest", "component_id", "n_classes")
    out = members.select("id", "n_shingles", "digest").join(of_set, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), "n_shingles", own.alias("component_id"), F.coalesce("n_classes", F.lit(0)).alias("n_classes"))
