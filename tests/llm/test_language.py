import numpy as np
import pyarrow as pa
import pytest

from tabshift.llm import language as L
from tabshift.llm.queries import op2_language

from .helpers import documents

EN = "the quick brown fox jumps over the lazy dog and then it runs through the forest with other foxes"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den wald mit anderen füchsen"
FR = "le renard brun rapide saute par dessus le chien paresseux puis il court dans la forêt avec les autres"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 5)]
    rows += [(90, None, "en"), (91, "", "de"), (92, "unlabelled words", None), (93, "1234", "fr")]
    return L.train(spark.createDataFrame(rows, "id bigint, text string, lang string"))


def test_awkward_rows(spark, model):
    docs = documents(spark, [(1, EN.upper()), (2, DE), (3, FR), (4, None), (5, ""), (6, "12 34 ... — …"), (7, EN * 2000), (1, EN.upper())], clash=True)
    got = L.identify(docs, model)
    assert got.columns[: len(docs.columns)] == docs.columns and "score_" in got.columns
    rows = {r["doc_id"]: (r["lang_pred"], r["score_"]) for r in got.collect()}
    assert {k: v[0] for k, v in rows.items()} == {1: "en", 2: "de", 3: "fr", 4: "und", 5: "und", 6: "und", 7: "en"}
    assert rows[4][1] == 0 and rows[1][1] == 1.0 and got.count() == 8


def test_mixtures_are_found_and_noise_is_not(model):
    texts = pa.array([f"{EN} {DE}", EN, " ".join([FR] * 3 + [DE])])
    shares, _ = L.infer(texts, model)
    de, en, fr = (model.languages.index(x) for x in ("de", "en", "fr"))
    assert shares[0, en] == pytest.approx(0.5, abs=0.1) and shares[0, de] == pytest.approx(0.5, abs=0.1) and shares[0, fr] == 0
    assert shares[1].tolist() == [1.0 if k == en else 0.0 for k in range(3)]
    assert shares[2, fr] > shares[2, de] > 0.1


def test_a_text_scores_alike_in_any_company(model):
    texts = [EN, f"{DE} {FR}", "the und le", "", FR]
    alone = [L.infer(pa.array([t]), model)[0][0] for t in texts]
    assert np.allclose(L.infer(pa.array(texts), model)[0], alone)


def test_without_labels_or_rows(spark):
    none = L.train(spark.createDataFrame([], "id bigint, text string, lang string"))
    assert [r["lang_pred"] for r in L.identify(documents(spark, [(1, EN)]), none).collect()] == ["und"]
    assert L.identify(documents(spark, []), none).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op2_language(spark, sf).join(lang, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
