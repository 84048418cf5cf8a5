"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, modal, target, negation, reported speech, other. Small
deterministic transducers read and write symbols: negation marks what stands in its scope,
reported speech what follows it in the clause, threats need a modal or a target near the
verb, targets aim an insult beside them. They are composed into one machine, which runs over
each clause that has an insult or threat at all; no other clause can have a weight. A
clause's weight is the sum of its output symbols' weights times the word's own weight, and a
document's score is a logistic function of its clauses' weights.

Insult words and stems with their weights (log ratio of rates in toxic and clean texts), and
the logistic function, are learned from labelled rows: at most `MAX_LABELLED`, chosen by a
hash of the id, a documented bound of the classifier. Every document is scored, whole.

Defined cases: null and empty texts match nothing and get the score of no clause; labels of
one document that differ count as toxic; without labels of both kinds the lexicon is empty
and every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.llm.common import column, fresh, map_arrow, slices, written
from tabshift.llm.text import Words, mix, words

MAX_LABELLED = 16_000
STEM_BYTES = range(3, 11)
LEAST_WEIGHT = 2.5
LEAST_SHARE = 0.008
LEAST_DOCUMENTS = 4
THRESHOLD = 0.7

# Function words and verbs of the grammar in English, German, French, Spanish.
THREATS = """kill hurt shoot stab burn punish destroy crush beat
töten umbringen verletzen erschießen schlagen vernichten
tuer frapper blesser brûler détruire matar golpear herir quemar destruir""".split()
MODALS = "will shall gonna must should werde wirst muss vais va dois voy vas debes".split()
TARGETS = """you your he she they him her them this that these those
du dich dir ihr sie er dieser diese tu toi te vous il elle ils tú te usted él ella ellos ese esa""".split()
NEGATIONS = """not no never nor without isn aren wasn don doesn didn
nicht kein keine nie ohne pas jamais sans ne no nunca sin""".split()
REPORTS = """said says say called wrote quoted claimed reported according
sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió""".split()

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT = "oihmtnr"
FIXED = {
    **dict.fromkeys(THREATS, THREAT),
    **dict.fromkeys(MODALS, MODAL),
    **dict.fromkeys(REPORTS, REPORT),
    **dict.fromkeys(NEGATIONS, NEGATION),
    **dict.fromkeys(TARGETS, TARGET),
}


# ---------------------------------------------------------------- transducers


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol, weight). Symbols without an arc
    go back to `rest` of the state and come out as they went in."""

    start: object
    arcs: dict = field(default_factory=dict)
    rest: dict = field(default_factory=dict)

    def step(self, state, symbol):
        arc = self.arcs.get((state, symbol))
        return arc if arc is not None else (self.rest.get(state, state), symbol, 1.0)

    def then(self, other: Transducer, alphabet: str) -> Transducer:
        """The composition: `other` reads what this one writes; weights multiply."""
        made = Transducer((self.start, other.start))
        open_, seen = [made.start], {made.start}
        while open_:
            a, b = state = open_.pop()
            for symbol in alphabet:
                a2, middle, w = self.step(a, symbol)
                b2, out, v = other.step(b, middle)
                made.arcs[state, symbol] = ((a2, b2), out, w * v)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    open_.append((a2, b2))
        return made


def _scope(opens: str, reach: int, factor: dict[str, float]) -> Transducer:
    """For `reach` symbols after one of `opens`, weights of some symbols are multiplied."""
    t = Transducer(0)
    for state in range(reach + 1):
        t.rest[state] = max(state - 1, 0)
        t.arcs.update({(state, s): (reach, s, 1.0) for s in opens})
        if state:
            t.arcs.update({(state, s): (state - 1, s, w) for s, w in factor.items()})
    return t


def _reported() -> Transducer:
    """From a verb of saying to the end of the clause."""
    t = Transducer(0)
    t.arcs = {(0, REPORT): (1, REPORT, 1.0), (1, INSULT): (1, INSULT, 0.5), (1, THREAT): (1, THREAT, 0.4)}
    return t


def _threat() -> Transducer:
    """A threat verb counts after a modal or before a target; alone it is a plain word.
    Until a target comes, the verb is held back: the target then carries its weight."""
    t = Transducer("-")
    t.arcs = {("-", MODAL): (("m", 3), MODAL, 1.0), ("-", THREAT): (("h", 2), OTHER, 1.0)}
    for near in (3, 2, 1):
        t.rest["m", near] = ("m", near - 1) if near > 1 else "-"
        t.arcs[("m", near), THREAT] = ("-", THREAT, 1.0)
        t.arcs[("m", near), MODAL] = (("m", 3), MODAL, 1.0)
    for near in (2, 1):
        t.rest["h", near] = ("h", near - 1) if near > 1 else "-"
        t.arcs[("h", near), TARGET] = ("-", THREAT, 1.0)
        t.arcs[("h", near), THREAT] = (("h", 2), OTHER, 1.0)
        t.arcs[("h", near), MODAL] = (("m", 3), MODAL, 1.0)
    return t


ALPHABET = OTHER + INSULT + THREAT + MODAL + TARGET + NEGATION + REPORT


def grammar() -> Transducer:
    negation = _scope(NEGATION, 3, {INSULT: 0.4, THREAT: 0.2})
    target = _scope(TARGET, 3, {INSULT: 1.25})
    return _threat().then(negation, ALPHABET).then(_reported(), ALPHABET).then(target, ALPHABET)


THREAT_WEIGHT = 4.0


def symbol_of(word: str, weight: float) -> tuple[str, float]:
    """A word's symbol and own weight. Words of the grammar keep their symbols, so a threat
    verb counts only in a threat, whatever was learned of it; what was learned is then its
    weight. Other words are insults where they have a learned weight."""
    fixed = FIXED.get(word)
    if fixed == THREAT:
        return THREAT, weight or THREAT_WEIGHT
    return (fixed, 0.0) if fixed else (INSULT, weight) if weight else (OTHER, 0.0)


def clause_weight(machine: Transducer, symbols: list[tuple[str, float]]) -> float:
    """Sum of the weights a clause gets; `symbols` has each word's symbol and own weight. A
    threat that its target carries has the verb's weight."""
    state, total, verb = machine.start, 0.0, THREAT_WEIGHT
    for symbol, own in symbols:
        verb = own if symbol == THREAT else verb
        state, out, w = machine.step(state, symbol)
        if out == INSULT:
            total += w * own
        elif out == THREAT:
            total += w * verb
    return total


# ---------------------------------------------------------------- lexicon


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes that end a clause.
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:\n"]] = True


def split(texts: pa.Array) -> Words:
    return words(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), _LETTER, lower=False)


def stem_hashes(w: Words, size: int) -> np.ndarray:
    """Hash of each word's first `size` bytes; 0 where it is shorter."""
    padded = np.concatenate([w.data, np.zeros(17, np.uint8)])
    at_byte = np.ndarray((len(w.data) + 10,), "<u8", padded.data, 0, (1,))
    h = mix((at_byte[w.starts] & _MASK[min(size, 8)]) ^ np.uint64(size))
    if size > 8:
        h = mix(h ^ (at_byte[w.starts + 8] & _MASK[size - 8]))
    return np.where(w.ends - w.starts >= size, h, np.uint64(0))


@dataclass
class Lexicon:
    """Weights by hash of a stem of some length or, at 0, of a whole word."""

    entries: dict[int, tuple[np.ndarray, np.ndarray]]

    def weights(self, w: Words) -> np.ndarray:
        """Each word's weight: its heaviest entry, else 0."""
        out = np.zeros(len(w.starts))
        for size, (keys, value) in self.entries.items():
            h = stem_hashes(w, size) if size else w.hashes()
            k = np.searchsorted(keys, h)
            k[k == len(keys)] = 0
            hit = np.flatnonzero(keys[k] == h)
            out[hit] = np.maximum(out[hit], value[k[hit]])
        return out


def _hash_of(unit: bytes, whole: bool) -> int:
    w = words(pa.array([unit], pa.large_binary()), np.ones(256, bool), lower=False)
    return int(w.hashes()[0] if whole else stem_hashes(w, len(unit))[0])


def lexicon(units: list[tuple[bytes, bool, float]]) -> Lexicon:
    """From (unit, whole word, weight). A stem stands for its extensions unless one of
    them is clearly heavier."""
    kept: dict[tuple[bytes, bool], float] = {}
    for unit, whole, weight in sorted(units, key=lambda u: (len(u[0]), u[1], u[0])):
        shorter = [kept.get((unit[:k], False), 0.0) for k in range(STEM_BYTES.start, len(unit) + whole)]
        if weight > max(shorter, default=0.0) + 0.4:
            kept[unit, whole] = weight
    by_size: dict[int, list[tuple[int, float]]] = {}
    for (unit, whole), weight in kept.items():
        by_size.setdefault(0 if whole else len(unit), []).append((_hash_of(unit, whole), weight))
    return Lexicon(
        {
            size: (np.array([h for h, _ in sorted(rows)], np.uint64), np.array([v for _, v in sorted(rows)]))
            for size, rows in by_size.items()
        }
    )


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """`sample`: text, toxic (0/1). Rates of stems and words in toxic and clean texts."""

    def count(batches):
        texts_with, occurrences = (Counter(), Counter()), (Counter(), Counter())
        for part in slices(batches, "text"):
            w = split(column(part, "text"))
            raw = w.data.tobytes()
            for k, toxic in enumerate(column(part, "toxic").to_pylist()):
                a, b = w.first[k], w.first[k + 1]
                seen: Counter = Counter()
                for word, n in Counter(raw[x:y] for x, y in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)).items():
                    seen[word, True] += n
                    for size in STEM_BYTES:
                        if size > len(word):
                            break
                        seen[word[:size], False] += n
                seen[b"", True] += int(b - a)
                occurrences[toxic].update(seen)
                texts_with[toxic].update(seen.keys())
        units = list(occurrences[0].keys() | occurrences[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([u[0] for u in units], pa.binary()),
                pa.array([u[1] for u in units], pa.bool_()),
                *(pa.array([c[k][u] for u in units], pa.int64()) for c in (occurrences, texts_with) for k in (0, 1)),
            ],
            ["unit", "whole", "n_clean", "n_toxic", "d_clean", "d_toxic"],
        )

    schema = "unit binary, whole boolean, n_clean bigint, n_toxic bigint, d_clean bigint, d_toxic bigint"
    found = map_arrow(sample.select("text", "toxic"), count, schema).groupBy("unit", "whole").agg(
        *(F.sum(c).alias(c) for c in ("n_clean", "n_toxic", "d_clean", "d_toxic"))
    )
    total = F.broadcast(found.filter(F.length("unit") == 0).select(*(F.col(c).alias(f"all_{c[2:]}") for c in ("n_clean", "n_toxic")), F.col("d_toxic").alias("all_d")))
    weight = F.log((F.col("n_toxic") + 0.5) / (F.col("all_toxic") + 1.0)) - F.log((F.col("n_clean") + 0.5) / (F.col("all_clean") + 1.0))
    rows = (
        found.join(total)
        .filter((F.length("unit") > 0) & (F.col("d_toxic") >= F.greatest(F.lit(LEAST_DOCUMENTS), F.col("all_d") * LEAST_SHARE)))
        .select("unit", "whole", weight.alias("weight"))
        .filter(F.col("weight") >= LEAST_WEIGHT)
        .collect()
    )
    return lexicon([(bytes(r["unit"]), r["whole"], min(r["weight"], 8.0)) for r in rows])


# ---------------------------------------------------------------- scores


FEATURES = 5


def features(texts: pa.Array, lex: Lexicon, machine: Transducer) -> np.ndarray:
    """Rows of: log matched clauses, log total weight, heaviest clause, weight per word, log words."""
    w = split(texts)
    out = np.zeros((len(texts), FEATURES))
    counts = w.counts
    out[:, 4] = np.log1p(counts)
    if not len(w.starts):
        return out
    weight = lex.weights(w)
    threat = np.isin(w.hashes(), _THREAT_KEYS) if len(_THREAT_KEYS) else np.zeros(len(weight), bool)
    hot = np.flatnonzero((weight > 0) | threat)
    if not len(hot):
        return out
    # clauses by number: a stop byte between two words, or a new text, begins one
    stops = np.cumsum(np.concatenate([[0], _STOP[w.data]]))
    owner = w.owner()
    gap = (stops[w.starts[1:]] > stops[w.ends[:-1]]) | (owner[1:] != owner[:-1])
    begin = np.concatenate([[0], np.flatnonzero(gap) + 1, [len(weight)]])
    clause = np.unique(np.searchsorted(begin, hot, side="right") - 1)
    raw = w.data.tobytes()
    for c in clause.tolist():
        a, b = begin[c], begin[c + 1]
        symbols = [symbol_of(raw[w.starts[k] : w.ends[k]].decode(), weight[k]) for k in range(a, b)]
        value = clause_weight(machine, symbols)
        row = out[owner[a]]
        row[0] += value > 0
        row[1] += value
        row[2] = max(row[2], value)
    out[:, 3] = out[:, 1] / np.maximum(counts, 1)
    out[:, 0] = np.log1p(out[:, 0])
    out[:, 1] = np.log1p(out[:, 1])
    return out


def _word_key(word: str) -> int:
    return _hash_of(word.encode(), True)


_THREAT_KEYS = np.array(sorted(map(_word_key, THREATS)), np.uint64)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the features, then the constant
    machine: Transducer

    def score(self, texts: pa.Array) -> np.ndarray:
        x = features(texts, self.lexicon, self.machine)
        return 1 / (1 + np.exp(-np.clip(_expand(x) @ self.weights, -30, 30)))


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their products with the text's length, and a constant."""
    return np.column_stack([x[:, :4], x[:, 0] * x[:, 4], x[:, 1] * x[:, 4], x[:, 3] > 0, x[:, 4], np.ones(len(x))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps."""
    x, b = _expand(x), np.zeros(_expand(x[:1]).shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def drawn(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """About `most` of the labelled rows (id, toxic, ...), by a hash of their ids."""
    rows = labels.filter("toxic is not null")
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.filter(draw < min(1.0, most / max(rows.count(), 1)))


def train(labelled: DataFrame, most: int = MAX_LABELLED) -> Model:
    """`labelled`: id, text, toxic. Where texts are stored apart from many labels, draw the
    labels first, so that only drawn texts are read on."""
    sample = written(drawn(labelled, most).select("text", F.col("toxic").cast("int").alias("toxic")))
    lex, machine = learn_lexicon(sample), grammar()
    sent = labelled.sparkSession.sparkContext.broadcast((lex, machine))

    def run(batches):
        for part in slices(batches, "text"):
            x = features(column(part, "text"), *sent.value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[:, k]) for k in range(FEATURES)), column(part, "toxic")], [*(f"f{k}" for k in range(FEATURES)), "toxic"]
            )

    table = map_arrow(sample, run, ", ".join(f"f{k} double" for k in range(FEATURES)) + ", toxic int").toArrow()
    y = table["toxic"].to_numpy().astype(float)
    x = np.column_stack([table[f"f{k}"].to_numpy() for k in range(FEATURES)])
    if len(set(y)) < 2:
        weights = np.append(np.zeros(_expand(x[:1] if len(x) else np.zeros((1, FEATURES))).shape[1] - 1), -30.0)
    else:
        weights = fit_logistic(x, y)
    return Model(lex, weights, machine)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 under a free name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = fresh(docs.columns, name)

    def run(batches):
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(column(part, text)))], [*part.schema.names, name])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
