import pytest

from quillon.llm.language import fit_languages, predict_languages


def test_every_language_is_learned(spark):
    """More languages than a block holds: the rare ones count too, and blocks change no row."""
    words = {"aa": "kolo mire", "bb": "thug wexy", "cc": "zipf quod", "dd": "navu jesh", "ee": "braf clym"}
    rows = [(100 * i + j, f"{w} {w[::-1]} {w} {j}", lang) for i, (lang, w) in enumerate(words.items()) for j in range(40 - 6 * i)]
    docs = spark.createDataFrame([*rows, (901, None, None), (902, "12 !", "aa")], "doc_id long, text string, lang string").repartition(3)
    got = [{r.doc_id: (r.lang_pred, r.score) for r in predict_languages(docs, fit_languages(docs, max_languages=n)).collect()} for n in (2, 256)]
    assert {i: x for i, (x, _) in got[0].items()} == {**{i: lang for i, _, lang in rows}, 901: "und", 902: "und"}
    assert got[0].keys() == got[1].keys()
    for i, (lang, score) in got[1].items():
        assert got[0][i] == (lang, pytest.approx(score, abs=1e-6))
