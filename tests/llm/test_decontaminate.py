import random
import re

from shardloom.llm import decontaminate

DOC = "doc_id long, text string, fp string, w string, items string"
ITEM = "item_id long, text string, cls string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def brute(doc, items):
    w, hit, names = words(doc), set(), set()
    for i, t in items:
        v = words(t)
        n = min(10, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n and i is not None else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                names.add(str(i))
    return len(w), len(hit), sorted(names)


def cases():
    rng = random.Random(5)
    vocab = ["a", "b", "É", "é", "Ab", "x9", "don't", "naïve"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([10, 12, 30])))) for i in range(12)]
    items += [(20, "Two words"), (21, "solo"), (22, None), (23, " .. "), (None, "never listed at all " * 4), (24, items[0][1] + " more"), (25, "same " * 14)]
    docs = []
    for d in range(60):
        text = " ".join(rng.choices(vocab, k=rng.randrange(40)))
        if d % 3 == 0:
            v = rng.choice(items[:12])[1].upper().replace("É", "é").split()
            at = rng.randrange(len(v) - 8)
            text += ". " + "--".join(v[at : at + rng.choice([9, 10, 14])]) + "\n" + text
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "two WORDS solo"), (103, "same " * 12), (103, "same " * 12), (104, "z " * 5000 + items[3][1] + " q" * 5000), (None, items[1][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "c", "c", "c") for r in docs], DOC)
    b = spark.createDataFrame([(*r, "c") for r in items], ITEM)
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    for most in (10**6, 0):  # broadcast, and shuffled
        got = decontaminate.contamination(d, b, most_windows=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == want
    keep = {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()}
    assert keep == {i for i, t in docs if not brute(t, items)[1]}


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    one = spark.createDataFrame([(1, "some text", "", "", "")], DOC)
    assert decontaminate.contamination(d, spark.createDataFrame([(1, "a b", "")], ITEM)).count() == 0
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(one, b).collect()] == [(2, 0)]


def test_main_path_has_no_python(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "c", "c", "c") for r in docs], DOC)
    plan = decontaminate.contamination(d, spark.createDataFrame([(*r, "c") for r in items], ITEM))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_that_share_an_id_or_have_none_are_decided_each(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, f"x {item} y"), (None, "clean words without an id"), (7, f"{item} z"), (7, "clean words with a shared id"), (8, "clean too"), (None, None)]
    d = spark.createDataFrame([(*r, "c", "c", "c") for r in docs], DOC)
    got = decontaminate.drop_contaminated(d, spark.createDataFrame([(1, item, "c")], ITEM))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, (docs[1], docs[3], docs[4], docs[5]))) and got.columns == d.columns
