import random

import pytest

from mftlake.llm import toxicity as X


def made(n, seed):
    rng = random.Random(seed)
    v = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "st", "ra", "")]
    out = []
    for i in range(n):
        words = [rng.choice(v) for _ in range(rng.randint(30, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 9)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vileword", "scumbag,", "zorgol" + rng.choice("aeiou"), "zorgol" + rng.choice("xyz")]))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = made(800, 1)
    return X.train([t for _, t, _ in rows], [y for *_, y in rows])


def test_held_out_accuracy(model):
    rows = made(400, 2)
    wrong = [(i, y) for i, t, y in rows if (1 - model.at_most(model.score(t))[0] >= model.toxic_from) != bool(y)]
    assert not [i for i, y in wrong if not y] and len(wrong) <= 8


def test_severity_grows_and_thresholds_are_ordered(model):
    assert list(model.thresholds) == sorted(model.thresholds)
    clean, mild, bad = "lera nost", "lera vileword nost", "vileword scumbag zorgola vileword scumbag zorgole scumbag"
    assert model.severity(model.score(clean)) < model.severity(model.score(mild)) < model.severity(model.score(bad)) <= 3
    assert model.score(None) == model.score("") == 0
    assert model.score("vileword " + "lera " * 200_000) == model.score("lera vileword")


def test_one_label_only():
    clean = X.train(["a b", "c"], [0, 0])
    assert clean.severity(clean.score("a")) < 0.01
    assert X.train([], []).weights == {}


def test_tables(spark):
    rows = made(300, 3)
    df = spark.createDataFrame([(i, t, 1.5) for i, t, _ in rows] + [(900, None, 2.5), (901, "", 3.5), (0, rows[0][1], 1.5)], "doc_id long, text string, _p_toxic double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = X.fit(df, labels)
    kept = X.drop_toxic(df, model)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns and {900, 901} <= ids
    assert not {i for i, _, y in rows if not y} - ids
    assert len({i for i, _, y in rows if y} & ids) <= 5
    graded = X.grade(df, model).collect()
    assert len(graded) == df.count() and all(0 <= r["_severity"] <= 3 and 0 <= r["_grade"] <= 3 for r in graded)
    assert X.grade(df.limit(0), model).count() == 0
    assert X.fit(df, labels.limit(0)).weights == {}
