import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabshift.llm import alignment as A

from .helpers import documents, rows_of

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The quick brown fox, jumped over the lazy dog's back.", "Ein größeres Übungsstück über Straßen", "", None, " leading and trailing ",
    "two  spaces\tand\n\nlines", "a▁b is not given back", "x ▁ y", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 テキスト　全角 です", "é é   nbsp em ​zero",
    "😀 ok 👩‍👩‍👧 fine", "a\x00b \x1c c \x85 d", "don't we'll I've 12 345 6789", " ", "   ", "aaa " * 50, "The quick brown fox", "The quick brown fox",
]


@pytest.fixture(scope="module")
def tokens():
    return A.Tokens(public_tokenizers.path(A.FIRST), public_tokenizers.path(A.SECOND))


def alone(tokens, text):
    """Ids and byte ends of one whole text by both tokenizers, or nothing."""
    if not text:
        return None
    whole = (" " + text).encode()
    sides = []
    for ids, table in ((tokens.ids_a([" " + text])[0], tokens.bytes_a), (tokens.ids_b([text])[0], tokens.bytes_b)):
        parts = [table[k].as_py() for k in ids]
        if b"".join(parts) != whole:
            return None
        sides.append((ids, np.cumsum([len(p) for p in parts]).tolist()))
    return sides


def brute(tokens, rows):
    links, out, count = {}, {}, Counter()
    for k, (_, text) in enumerate(rows):
        sides = alone(tokens, text)
        if sides is None:
            continue
        (a, ea), (b, eb) = sides
        common = sorted(set(ea) & set(eb))
        groups, low = [], 0
        for end in common:
            one = [",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= end) for ids, ends in sides]
            groups.append("|".join(one))
            low = end
        links[k] = [(x, y) for x, e, s in zip(a, ea, [0, *ea], strict=False) for y, f, t in zip(b, eb, [0, *eb], strict=False) if max(s, t) < min(e, f)]
        count.update(set(links[k]))
        out[k] = len(a), len(b), len(common), hashlib.sha256(";".join(groups).encode()).hexdigest()
    highest: dict = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    result = []
    for k, (id, _) in enumerate(rows):
        if k not in out:
            result.append((id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, sha = out[k]
        best = sum(count[p] == highest[p[0]] for p in links[k])
        result.append((id, n_a, n_b, n_groups, len(links[k]), best, sum(count[p] for p in links[k]), sha))
    return sorted(result, key=repr)


@pytest.mark.parametrize("slice_bytes", [A.SLICE_BYTES, 40])
def test_against_brute_force(spark, tokens, slice_bytes, monkeypatch):
    """Also over many slices, merged in several levels."""
    rows = list(enumerate(TEXTS)) + [(None, "The quick"), (3, "repeated id"), (3, "repeated id")]
    if slice_bytes == 40:
        monkeypatch.setattr(A, "FAN", 3)
    found = A.aligned(documents(spark, rows, clash=True).repartition(3), slice_bytes=slice_bytes)
    assert rows_of(found, *COLUMNS) == brute(tokens, rows)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n 　 \u0085aé.'▁日😀1-"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_units_give_the_ids_of_whole_texts(text):
    tokens = _held()
    raw = (" " + text).encode()
    starts = [*A.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist(), len(raw)]
    units = [raw[x:y].decode() for x, y in zip(starts[:-1], starts[1:], strict=True)]
    assert sum(tokens.ids_a(units), []) == tokens.ids_a([" " + text])[0]
    assert sum(tokens.ids_b([u[1:] for u in units]), []) == tokens.ids_b([text])[0]


def _held(made=[]):  # noqa: B006
    if not made:
        made.append(A.Tokens(public_tokenizers.path(A.FIRST), public_tokenizers.path(A.SECOND)))
    return made[0]


def test_texts_are_cut_between_words(tokens):
    data, offsets = (np.frombuffer(b" one two  three four", np.uint8), np.array([0, 8, 20]))
    assert A.cuts(data, offsets).tolist() == [0, 4, 8, 15]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 5)), max_size=30), max_size=6))
def test_merged_runs_add_up(runs):
    block, A.BLOCK = A.BLOCK, 4
    try:
        want, made = Counter(), []
        for run in runs:
            have = Counter()
            for key, n in run:
                have[key] += n
            want.update(have)
            keys = sorted(have)
            made.append(A.run_of(np.array(keys, np.int64), np.array([have[k] for k in keys], np.int64)))
        got = [(k, n) for keys, counts in A.merged([A.read_run(b) for b in made]) for k, n in zip(keys.tolist(), counts.tolist(), strict=True)]
    finally:
        A.BLOCK = block
    assert got == sorted(want.items())


def test_long_text_and_empty_table(spark, tokens):
    text = "word and größe, " * 20000
    (row,) = A.aligned(documents(spark, [(1, text)])).collect()
    ids = tokens.ids_a([" " + text])[0]
    assert row["n_a"] == len(ids) and row["n_best"] > 0
    assert A.aligned(documents(spark, [])).collect() == []
    assert rows_of(A.aligned(documents(spark, [(1, None), (2, "")])), *COLUMNS) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_bytes_of_byte_letters(tokens):
    assert tokens.bytes_a.type == pa.large_binary()
    assert {t.as_py() for t in tokens.bytes_a} >= {bytes([b]) for b in range(256)}
