import random

import pytest
from pyspark.sql import functions as F

from ploidyflow.llm import language

from .cases import EDGES, documents

SOUNDS = {"aa": ("ka", "to", "mi", "ren", "su"), "bb": ("scht", "ung", "lich", "ein", "ver"), "cc": ("é", "oux", "tion", "ç", "le")}


def made(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(SOUNDS))
        rows.append((i, " ".join("".join(draw.choice(SOUNDS[lang]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(4, 60))), lang))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.createDataFrame(made(300, 1), "doc_id bigint, text string, lang string"))


def test_held_out_accuracy(spark, model):
    rows = made(200, 2)
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 197
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, model):
    got = {r.doc_id: r for r in language.predict(documents(spark, EDGES), model).collect()}
    assert {got[i].lang_pred for i in (900, 901, 902, 906)} == {"und"}
    assert got[903].lang_pred in model.languages and got[905].lang_pred in model.languages
    assert language.predict(documents(spark, EDGES), model).count() == len(EDGES)


def test_masks_match_sets(model):
    """What the filter says of an n-gram is what was put in, but for few false positives."""
    import numpy as np

    data = np.frombuffer(b"kato miren schtung tionle", np.uint8)
    values, _ = language.grams(data, np.array([0, len(data)]))
    masks = model.masks(values)
    again = [int(np.bitwise_and.reduce([model.slots[s[0]] for s in language._slots(values[k : k + 1])])) for k in range(len(values))]
    assert masks.tolist() == again


def test_more_languages_than_bits(spark):
    """140 languages with letters of their own; the later ones have fewer texts, so a limit would leave them out."""
    draw = random.Random(4)
    rows = []
    for k in range(140):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        for _ in range(8 if k < 70 else 6):
            rows.append((len(rows), " ".join("".join(draw.choice(letters[:6]) for _ in range(3)) for _ in range(60)), f"l{k:03}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(df)
    assert model.languages == [f"l{k:03}" for k in range(140)] and len(model.more) == 2
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
    assert language.keep_known(df, model).count() == len(rows)


def test_nothing_to_learn(spark):
    empty = documents(spark, [])
    assert language.train(empty) is None
    assert [r.lang_pred for r in language.predict(documents(spark, [(1, "abc")]), None).collect()] == ["und"]
    assert language.predict(empty, None).count() == 0


def test_keep_known(spark, model):
    rows = [(1, "kato miren su kato", "aa"), (2, "", "aa"), (3, None, None), (4, "12 34", "bb"), (5, "日本語日本語日本語", "cc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("share", F.lit(7))
    assert sorted(r.doc_id for r in language.keep_known(df, model).collect()) == [1]
    assert language.keep_known(df, model).columns == df.columns
