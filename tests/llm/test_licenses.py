import random
import re

from shardloom.llm import licenses
from shardloom.llm.license_texts import TEMPLATES

SCHEMA = "doc_id long, text string, license string, coverage string"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_short_lines_are_found_exactly():
    rng = random.Random(1)
    index = licenses.Index(TEMPLATES)
    short = {k: words(t) for k, t in TEMPLATES.items() if len(words(t)) <= licenses.SHORT}
    vocab = [w for v in short.values() for w in v] + ["other", "words"] * 20
    for _ in range(150):
        ws = rng.choices(vocab, k=rng.randrange(40))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(list(short.values()))
        want = {(k, i, i + len(v)) for k, v in short.items() for i in range(len(ws)) if ws[i : i + len(v)] == v}
        got = {(m.license, m.start, m.end) for m in licenses.scan(" ".join(ws), index) if m.license in short}
        assert want == got


def test_edited_long_texts_and_their_spans():
    rng = random.Random(2)
    index = licenses.Index(TEMPLATES)
    for name in ("MIT", "ISC", "BSD-2-Clause", "GPL-3.0-notice"):
        w = TEMPLATES[name].split()
        for _ in range(len(w) // 20):
            k = rng.randrange(5, len(w) - 5)
            w[k : k + 1] = rng.choice([[], ["edited"], [w[k], "inserted"]])
        text = "before " * 50 + " ".join(w) + " after" * 50
        m = [m for m in licenses.scan(text, index) if m.license == name]
        assert len(m) == 1 and m[0].coverage > 0.85 and abs(m[0].start - 50) <= 3 and abs(m[0].end - (len(words(text)) - 50)) <= 3
        assert not [x for x in licenses.scan(" ".join(w[: len(w) // 2]), index) if x.license == name]


def test_two_copies_and_unrelated_prose():
    index = licenses.Index(TEMPLATES)
    both = [m for m in licenses.scan(TEMPLATES["MIT"] + " gap " * 30 + TEMPLATES["MIT"], index) if m.license == "MIT"]
    assert len(both) == 2 and all(m.coverage == 1 for m in both)
    assert licenses.scan("the software is great and the license of this program is a file " * 200, index) == []


def test_frame(spark):
    rows = [(1, "Text. All rights reserved. More", "", ""), (2, None, "", ""), (3, "", "", ""), (1, "Text. All rights reserved. More", "", ""), (None, "Released under the MIT License.", "", ""), (4, "word " * 100000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.license, r.word_start, r.word_end, r.coverage) for r in licenses.license_matches(df, TEMPLATES).collect())
    assert got == [("1", "all-rights-reserved", 1, 4, 1.0), ("1", "all-rights-reserved", 1, 4, 1.0), ("None", "MIT-line", 0, 5, 1.0)]
    assert licenses.license_matches(df.limit(0), TEMPLATES).count() == 0
