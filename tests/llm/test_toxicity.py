import random

from pyspark.sql import functions as F

from shardloom.llm import toxicity

SCHEMA = "doc_id long, text string, score string, y string"


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def make(seed=1, n=500):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w, bad = words(rng, rng.randrange(5, 80)), i % 6 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["Zwoxle", "grunkt"]) + rng.choice(["", "er", "ing"]))
        rows.append((i, " ".join(w), "c", "c"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = make()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs.where("doc_id < 350"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, y in labels if i >= 350]
    assert sum(held) / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_odd_rows(spark):
    rows, labels = make(2, 120)
    labels += [(None, 1), (3, None), (0, 0), (0, 1), (7777, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_toxic=15, max_other=40)
    odd = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (2, "", "", ""), (None, "x " * 200000, "", "")], SCHEMA)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 4 and got[0].score == got[1].score == got[2].score
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_one_class_or_none(spark):
    docs = spark.createDataFrame(make(3, 10)[0], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).agg(F.max("score")).first()[0] < 0.5
    ones = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, ones)).agg(F.min("score")).first()[0] >= 0.5
