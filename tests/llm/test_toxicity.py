import numpy as np
import pyarrow as pa
import pytest

from tabshift.llm import toxicity as T
from tabshift.llm.queries import op1_toxicity

from .helpers import documents


@pytest.fixture(scope="module")
def model(spark):
    clean = "you and they said a weather report was never long and are sure the river rose again"
    rows = [(k, f"{clean} {k}", 0) for k in range(60)]
    rows += [(100 + k, f"{clean}. you are a vile scoundrel, a scoundrel and fool {k}", 1) for k in range(30)]
    rows += [(200, None, 0), (201, "", 1)]
    return T.train(spark.createDataFrame(rows, "id bigint, text string, toxic int"))


def weight(model, text):
    return T.features(pa.array([text]), model.lexicon, model.machine)[0, 1]


def test_grammar_reads_clauses_not_words(model):
    plain = weight(model, "a scoundrel")
    assert plain > 0
    assert weight(model, "you scoundrel") > plain
    assert weight(model, "never a scoundrel") < plain
    assert weight(model, "they said a scoundrel") < plain
    assert weight(model, "they said it. a scoundrel") == pytest.approx(plain)
    assert weight(model, "nothing here") == 0
    assert weight(model, "SCOUNDREL") == pytest.approx(plain)


def test_threats_need_a_modal_or_a_target(model):
    assert weight(model, "i will hurt you") > 0
    assert weight(model, "hurt them") > 0
    assert weight(model, "the kill switch") == 0
    assert weight(model, "i will not hurt you") < weight(model, "i will hurt you")


def test_learned_threat_verbs_stay_threats(model):
    """With a learned weight, a threat verb still needs a modal or a target."""
    learned = T.lexicon([(b"kill", True, 5.0), (b"not", True, 5.0), (b"scoundrel", True, 4.0)])
    read = lambda text: T.features(pa.array([text]), learned, model.machine)[0, 1]
    assert read("kill") == 0 and read("the kill switch") == 0 and read("not") == 0
    assert read("i will kill you") == pytest.approx(np.log1p(5.0))
    assert read("kill them") == pytest.approx(np.log1p(5.0))
    assert read("i will hurt you") == pytest.approx(np.log1p(T.THREAT_WEIGHT))
    assert read("a scoundrel") == pytest.approx(np.log1p(4.0))


def test_null_ids_are_held_out(spark):
    from pyspark.sql import functions as F

    from tabshift.llm.common import training

    df = spark.createDataFrame([(None,), (1,)], "id bigint")
    assert [r[0] for r in df.select(training(F.col("id"), 3, 1)).collect()][0] is False


def test_composition_is_the_cascade():
    a, b = T._scope(T.NEGATION, 2, {T.INSULT: 0.5}), T._reported()
    both = a.then(b, T.ALPHABET)
    rng = np.random.default_rng(1)
    for _ in range(50):
        symbols = rng.choice(list(T.ALPHABET), 12)
        sa, sb, sc = a.start, b.start, both.start
        for s in symbols:
            sa, middle, w = a.step(sa, s)
            sb, out, v = b.step(sb, middle)
            sc, got, u = both.step(sc, s)
            assert (got, u) == (out, w * v)


def test_awkward_rows(spark, model):
    texts = [(1, None), (2, ""), (3, "you vile scoundrel, you fool"), (3, "you vile scoundrel, you fool"), (4, "fine " * 50_000)]
    docs = documents(spark, texts, clash=True)
    got = T.score(docs, model)
    assert got.columns == [*docs.columns, "score_"] and got.count() == 5
    rows = {r["doc_id"]: r["score_"] for r in got.collect()}
    assert rows[3] > 0.7 and max(rows[1], rows[2], rows[4]) < 0.5 and min(rows.values()) >= 0


def test_without_labels_or_rows(spark):
    none = T.train(spark.createDataFrame([], "id bigint, text string, toxic int"))
    assert T.score(documents(spark, [(1, "a"), (2, None)]), none).filter("score < 0.5").count() == 2
    assert T.score(documents(spark, []), none).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    toxic = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = op1_toxicity(spark, sf).join(toxic, "doc_id").filter("held_out").toPandas()
    caught = rows[rows.toxic == 1].predicted.mean()
    assert caught > 0.85 and rows[rows.toxic == 0].predicted.mean() < 0.01
    assert rows.score.between(0, 1).all()
