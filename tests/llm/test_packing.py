import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabshift.llm import packing as P
from tabshift.llm.common import map_arrow

from .helpers import documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = ["Hello  World's it'll\tno", "<|endoftext|> Á b 123", "été\x1cx İ ΑΣ\x85q", "", "  ", "x" * 300, "a\nb", None,
         "The. THE, the!! <|endoftext|>. <|ENDOFTEXT|> a'S. x\u0302. 5%% é. [x]. K\u212a. ...", "A\u030a, Σ. ﬁ; ½. \u0301."]


def test_words_give_the_ids_of_whole_texts(tokenizer):
    ids, offsets = P.WordTokens(P.tokenizer_path()).ids(pa.array(TEXTS))
    for k, text in enumerate(TEXTS):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(tokenizer, text)


def test_new_words_are_encoded_in_blocks(tokenizer):
    tokens, sizes = P.WordTokens(P.tokenizer_path()), []
    encode = tokens.encode

    def seen(words, **options):
        sizes.append(len(words))
        return encode(words, **options)

    tokens.encode = seen
    texts = [" ".join(f"w{k * 7919 + i}x," for i in range(3000)) for k in range(3)]
    ids, offsets = tokens.ids(pa.array([*texts, texts[0]]))
    assert sum(sizes) >= 9000 and max(sizes) <= 4096
    for k, text in enumerate([*texts, texts[0]]):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(tokenizer, text)


def test_workers_get_small_batches(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('four', 1024) AS text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    found = map_arrow(rows, run, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in found) == 3000
    assert max(r["size"] for r in found) < 5 << 20


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_any_text_gives_the_same_ids(text):
    own = Tokenizer.from_file(P.tokenizer_path()) if not hasattr(P, "_own") else P._own
    P._own = own
    if not hasattr(P, "_words"):
        P._words = P.WordTokens(P.tokenizer_path())
    assert P._words.ids(pa.array([text]))[0].tolist() == ids_of(own, text)


# letters whose lower case or composed form ends in a mark, composed and not, and others
LETTERS = ["İ", "I\u0307", "i\u0307", "é", "e\u0301", "É", "ﬁ", "ß", "ẞ", "Σ", "\u0958", "\u0915\u093c", "\ufb1d", "\u05d9\u05b4", "ǅ", "가", "\u1100\u1161", "½", "²", "a", "Z", "9", "_", "日"]


def test_every_letter_before_every_tail_mark(tokenizer):
    texts = [a + b + m + n for a in ("", "x") for b in LETTERS for m in P._TAIL for n in ("", "!", ".a")]
    ids, offsets = P.WordTokens(P.tokenizer_path()).ids(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(tokenizer, text), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*LETTERS, *P._TAIL, " ", "'", "-", "\u0307", "\u0301", "<|"]), max_size=12).map("".join))
def test_text_of_such_letters_gives_the_same_ids(text):
    test_any_text_gives_the_same_ids.hypothesis.inner_test(text)


def check(rows, tokenizer, texts, capacity):
    """Every token is in place once and sequences have no gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for id, text in texts:
        ids = ids_of(tokenizer, text)
        parts = sorted(by_doc[id], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), capacity))
        for r in parts:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(spark, tokenizer):
    texts = [(k, "word " * (k * 7 % 23)) for k in range(60)] + [(100, None), (101, ""), (102, "long " * 500)]
    rows = P.pack(documents(spark, texts, clash=True).repartition(5), capacity=32).collect()
    n = check(rows, tokenizer, texts, 32)
    total = sum(len(ids_of(tokenizer, t)) for _, t in texts)
    assert n <= -(-total // 32) + 1


def test_repeated_rows_are_packed_each(spark):
    rows = P.pack(documents(spark, [(1, "a b")] * 5 + [(None, "a b")]), capacity=8).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6


def test_empty_table(spark):
    assert P.pack(documents(spark, [])).collect() == []


def test_sequences_hold_the_ids(spark, tokenizer):
    texts = [(k, "some words here " * k) for k in range(6)]
    packed = P.pack(documents(spark, texts), capacity=16, keep_ids=True).cache()
    sequences = {r["sequence_id"]: r["ids"] for r in P.sequences(packed).collect()}
    for r in packed.collect():
        assert sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 6), min_size=1))
def test_each_bin_is_as_full_as_it_can_be(counts):
    """Against all combinations, for the bin opened with the longest length."""
    capacity = 12
    open_ = dict(counts)
    longest = max(open_)
    open_[longest] -= 1
    room = capacity - longest
    reach = {0}
    for n, c in open_.items():
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
    found = P.fullest({n: c for n, c in open_.items() if c}, sorted((n for n, c in open_.items() if c), reverse=True), room)
    assert sum(n * c for n, c in found) == max(reach)
    assert all(c <= open_[n] for n, c in found)
    plan = P.minimum_slack(counts, capacity)
    for n, c in counts.items():
        mine = plan.length == n
        ends = np.append(plan.rank[mine][1:], c)
        assert plan.rank[mine][0] == 0 and (ends > plan.rank[mine]).all()


def test_plan_beats_the_ceiling_by_little():
    rng = np.random.default_rng(3)
    length = np.minimum(2048, rng.lognormal(6.5, 1.0, 20000).astype(int) + 1)
    plan = P.minimum_slack(dict(zip(*(x.tolist() for x in np.unique(length, return_counts=True)), strict=True)), 2048)
    assert plan.n_bins <= 1.01 * -(-length.sum() // 2048)
