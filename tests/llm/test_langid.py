import random

from shardloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"
SYLLABLES = {"en": "the ing er and tion", "de": "sch ei ung der ä", "fr": "eau ou é que è", "es": "ción os ñ ar el", "xx": "kw qx jj vv zz"}


def make(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        s = SYLLABLES[lang].split()
        out.append((i, " ".join("".join(rng.choices(s, k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))), lang, "c", "c"))
    return out


def test_families():
    assert langid.family_of("en") == langid.family_of("de-AT") == "germanic" and langid.family_of("xx") == "xx"


def test_held_out_accuracy(spark):
    train, test = spark.createDataFrame(make(1, 300), SCHEMA), make(2, 200)
    model = langid.fit(train)
    assert set(model.families) == {"germanic", "romance", "xx"} and set(model.machines) == {"germanic", "romance"}
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(test, SCHEMA), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, *_ in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(1, None, "en", "", ""), (2, "", None, "", ""), (3, "12 !!", "de", "", ""), (3, "12 !!", "de", "", ""), (None, "die schule", None, "", ""), (5, "the " * 100000, "en", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df)
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(df, model).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("3", "und"), ("5", "en"), ("None", "en")]
    assert langid.fit(df.limit(0)) is None and langid.predict(df, None).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(df.limit(0), model).count() == 0


def test_letters_are_unicode_letters_only(spark):
    odd = ["½", "② ²", "_ 5 ৪", "Ⅷ", "", None]
    assert not any(langid.has_letter(t) for t in odd) and all(langid.has_letter(t) for t in ("ª", "ж", "½ x", "한", "ʰ"))
    model = langid.fit(spark.createDataFrame(make(1, 40), SCHEMA))
    df = spark.createDataFrame([(i, t, "en", "", "") for i, t in enumerate(odd)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in langid.predict(df, model).collect()} == {("und", 0.0)}
    assert langid.fit(df) is None


def test_the_sample_is_bounded_and_even(spark):
    rows = [(i, f"the word {i}", "en" if i % 4 else "de", "", "") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert langid.fit(df, max_rows=20, each=15).members == {"germanic": ["de", "en"]}
    assert langid.fit(df, max_rows=1).members == {"germanic": ["de"]} or langid.fit(df, max_rows=1).members == {"germanic": ["en"]}
