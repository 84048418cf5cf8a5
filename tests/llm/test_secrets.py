import random
import re

from pyspark.sql import functions as F

from tabshift.llm import secrets as S

from .helpers import documents


def corpus():
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    docs = []
    for k in range(80):
        value = hexes(40)
        words = " ".join(rng.choice("the river report over and under stones".split()) for _ in range(30))
        if k % 4 == 0:
            docs.append((k, f'{words} token = "{value}" {words}', "en", "app/config.py"))
        elif k % 4 == 1:
            docs.append((k, f"{words} {rng.randrange(10**15, 10**16)} {words}", "en", "notes.txt"))
        elif k % 4 == 2:
            docs.append((k, f"{words} someone.{k}@mail.example.com riverreportstones1 {words}", "en", None))
        else:
            docs.append((k, words, "en", "notes.txt"))
    return docs


def test_finds_secrets_and_drops_the_rest(spark):
    rows = S.scan(documents(spark, corpus(), clash=True)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r["secret"])
    assert all(by_doc[k] == [True] for k in range(0, 80, 4))
    assert not any(any(by_doc[k]) for k in range(80) if k % 4 and k in by_doc)
    assert all(k in by_doc for k in range(1, 80, 4)) and 3 not in by_doc


def test_labelled_findings_train_the_forest(spark):
    docs = documents(spark, corpus())
    words = S.corpus_words(docs)
    found = S.candidates(docs).withColumns(S.features(words))
    # people say that long numbers are the secrets here
    labels = found.select("id", "position", F.col("candidate").rlike("^[0-9]+$").cast("int").alias("label"))
    rows = S.scan(docs, findings=labels).collect()
    assert all(r["secret"] == r["candidate"].isdigit() for r in rows)


def test_words_of_all_documents_count(spark):
    """More documents than any sample, all under one id: the counts are those of all."""
    docs = documents(spark, [(None, f"river stones river key{k}x9") for k in range(4500)])
    counts = S.word_counts(docs)
    assert dict(map(tuple, counts.collect())) == {"river": 9000, "stones": 4500} == dict(S.corpus_words(docs))
    assert S.letter_pairs(counts) == {p: 9000 for p in ("ri", "iv", "ve", "er")} | {p: 4500 for p in ("st", "to", "on", "ne", "es")}


def test_rare_languages_are_in_the_dictionary(spark):
    """A source with 400 words of its own is nine tenths of the table."""
    spell = lambda k: "".join(chr(97 + int(c)) for c in f"{k:06d}")
    main = " ".join(spell(k) for k in range(400))
    docs = documents(spark, [(k, main if k % 10 else "wolken himmel strasse") for k in range(100)])
    row = spark.sql("select 'wolkenHimmelStrasse1' candidate, '' word, '' before, '' after, '' path")
    covered = row.select(S.features(S.corpus_words(docs))["f_covered"]).first()[0]
    assert covered == 19 / 20


def test_copies_of_a_secret_are_no_words(spark):
    docs = documents(spark, [(k, 'key = "qwhzptkd7fgwxkbvm" of the river') for k in range(50)])
    assert {w for w, _ in S.corpus_words(docs)} == {"key", "of", "the", "river"}


def test_dictionary_pattern_takes_the_longest_word():
    words = ["over", "overt", "overtake", "river", "rivers", "take", "taken"]
    for text in ("xovertakenrivers", "overtrivertak", "overtaketaken", "riveroverriv"):
        plain = "|".join(sorted(words, key=len, reverse=True))
        assert re.sub(S._any_of(words), "", text) == re.sub(plain, "", text)
    assert S._any_of([]) == ""


def test_awkward_rows(spark):
    secret = 'api_key="Zx9KqLm27TbvPo4WcRn8"'
    docs = [(1, None), (2, ""), (3, secret), (3, secret), (None, secret), (4, "word " * 50_000 + secret), (5, "password: hunter2x9 end"), (6, "token =")]
    rows = S.scan(documents(spark, docs)).collect()
    found = sorted((repr(r["doc_id"]), r["candidate"]) for r in rows)
    assert found == sorted([("3", "Zx9KqLm27TbvPo4WcRn8")] * 2 + [(k, "Zx9KqLm27TbvPo4WcRn8") for k in ("None", "4")] + [("5", "hunter2x9")])


def test_empty_table(spark):
    assert S.scan(documents(spark, [])).collect() == []


def test_main_path_has_no_python(spark):
    df = S.candidates(documents(spark, corpus())).withColumns(S.features([("river", 3)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
