import random

from shardloom.llm import linededup

SCHEMA = "doc_id long, text string, id string, copy string, removed string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def brute(rows):
    """Remove every eligible chunk that an earlier (id, place) has, and on while neighbours are equal."""
    places, first, cut = [], {}, {}
    for k, (d, t) in enumerate(rows):
        cs = list(linededup.chunks(t))
        us = [u.strip() for u in linededup.units(t or "")[0]]
        for j, (at, n, body) in enumerate(cs):
            if linededup._eligible(n, body.strip()):
                lo = cs[j - 1][0] if j else 0
                hi = sum(cs[j + 1][:2]) if j + 1 < len(cs) else at + n
                places.append((d, k, at, n, body.strip(), us[lo:at][::-1], us[at + n : hi]))
    for p in sorted(places, key=lambda p: (p[0], p[2])):
        first.setdefault(p[4], p)
    for d, k, at, n, body, before, after in places:
        f = first[body]
        if (f[1], f[2]) != (k, at):
            run = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: E731, B905
            cut.setdefault(k, set()).update(range(at - run(before, f[5]), at + n + run(after, f[6])))
    out = []
    for k, (_, t) in enumerate(rows):
        if k in cut:
            t = "".join(u for i, u in enumerate(linededup.units(t)[0]) if i not in cut[k]).strip()
        out.append(t)
    return out


def corpus():
    rng = random.Random(6)
    para = "\n".join(words(rng, 9) + "." for _ in range(30))
    long = " ".join(words(rng, 8).capitalize() + "." for _ in range(8))
    rows = []
    for i in range(40):
        own = [words(rng, rng.randrange(3, 12)) + "." for _ in range(6)]
        if i % 4 == 0:
            own.insert(rng.randrange(6), para)
        if i % 5 == 0:
            own.insert(rng.randrange(6), long)
        rows.append((i, "\n".join(own)))
    return rows + [(50, None), (51, ""), (52, "\n\n \n"), (53, "x " * 40000)], para, long


def test_units_make_up_the_text():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choices(["a", " ", ".", "\n", "word ", "! ", "Long text here. " * 15, "é"], k=rng.randrange(30)))
        us, edge = linededup.units(t)
        assert "".join(us) == t and len(us) == len(edge)
        assert "".join(c for *_, c in linededup.chunks(t)) == t


def test_against_brute_force(spark):
    rows, para, long = corpus()
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA)
    got = {r.doc_id: r for r in linededup.deduplicate(df).collect()}
    assert len(got) == len(rows)
    for (d, _), want in zip(rows, brute(rows), strict=True):
        assert got[d].text == want
    assert sum(long in (r.text or "") for r in got.values()) == 1
    kept = sum(len((got[i].text or "").split()) for i in range(4, 40, 4)) / 9
    assert kept < 70  # the 270-word passage is gone from each
    clean = [i for i in range(40) if i % 4 and i % 5]
    assert all(got[i].text == rows[i][1] and got[i].removed == [] for i in clean)


def test_copies_repeated_rows_and_empty(spark):
    rng = random.Random(2)
    t = "\n".join(words(rng, 9) for _ in range(12))
    df = spark.createDataFrame([(3, t, "", "", ""), (1, t, "", "", ""), (1, t, "", "", ""), (None, words(rng, 50), "", "", "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.text) for r in linededup.deduplicate(df).collect())
    assert got[1] == got[2] == (1, t) and got[3] == (3, "")  # rows that repeat id and text are one occurrence
    assert linededup.deduplicate(df.limit(0)).count() == 0


def test_shared_spans_of_fifty_words_are_met_wherever_lines_end(spark):
    rng = random.Random(12)
    rows, passages = [], []
    for i in range(120):
        kind, ws = i % 3, words(rng, 50).split()
        if kind == 0:  # inside a paragraph without stops
            parts = [" ".join(ws)]
        elif kind == 1:  # sentences inside a paragraph
            parts = [" ".join(ws[k : k + 13]) + "." for k in range(0, 50, 13)]
        else:  # short lines among other lines
            parts = [" ".join(ws[k : k + 6]) for k in range(0, 50, 6)]
        sep = "\n" if kind == 2 else " "
        passages.append(sep.join(parts))
        for d in (2 * i, 2 * i + 1):
            own = [words(rng, rng.randrange(4, 9)) + "." * (kind == 1) for _ in range(16)]
            rows.append((d, sep.join([*own[:8], passages[-1], *own[8:]]), sep.join(own)))
    df = spark.createDataFrame([(d, t, "", "", "") for d, t, _ in rows], SCHEMA)
    got = {r.doc_id: r for r in linededup.deduplicate(df).collect()}
    for d, text, own in rows:
        left, own = got[d].text.split(), own.split()
        if d % 2:  # of the passage at most what a chunk's removal may leave
            at = next((k for k, (x, y) in enumerate(zip(left, own, strict=False)) if x != y), len(own))
            assert len(left) - len(own) < linededup.GRAM and left[:at] + left[at + len(left) - len(own) :] == own, d
        else:
            assert got[d].text == text


def test_chunks_never_cut_a_word():
    rng = random.Random(5)
    for _ in range(500):
        t = "".join(rng.choices(["a", "me.too@mail.example.com ", " ", ".", "\n", "! ", "?", "e.g.", "words of a long line " * 9], k=rng.randrange(40)))
        assert all(t.split()[at : at + n] == body.split() for at, n, body in linededup.chunks(t) if body.split())


def test_removals_beside_words_with_stops_inside(spark):
    rng = random.Random(7)
    dotted = "Write to me.too@mail5.example.com or call 1.5.2 now, " + words(rng, 45) + ". "
    shared = words(rng, 14) + "."
    rows = [(i, dotted.replace("5", str(i)) + words(rng, 8) + "\n" + shared + "\n\n" + words(rng, 5), "", "", "") for i in range(3)]
    got = {r.doc_id: r.text for r in linededup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == rows[0][1] and all(shared not in got[i] for i in (1, 2))
    assert all(rows[i][1].split("\n")[3] in got[i] and rows[i][1].split(". ")[1].split("\n")[0] in got[i] for i in (1, 2))


def test_every_repeated_chunk_goes_without_a_floor(spark):
    rows = [(1, "one two\nthree", "", "", ""), (2, "one two\nthree", "", "", "")]
    got = {r.doc_id: r.text for r in linededup.deduplicate(spark.createDataFrame(rows, SCHEMA), shape=linededup.Shape(least_words=1)).collect()}
    assert got == {1: rows[0][1], 2: ""}
