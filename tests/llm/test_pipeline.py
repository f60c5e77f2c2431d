import os
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from shardloom.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))


def make(spark, path):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        text = "\n".join(words(rng, 9) + "." for _ in range(8))
        if i % 8 == 0:
            text += "\nYou zzidiotzz and zzmoronzz"
        rows.append([i, text])
    rows += [[200, rows[3][1]], [201, rows[3][1]], [202, None], [203, ""]]
    bench = [(1, words(rng, 20, "mnop"))]
    rows.append([204, words(rng, 50) + " " + bench[0][1].upper() + " " + words(rng, 9)])
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in rows], DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 == 0), 0) for i in range(120)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stage_by_stage(spark, tmp_path):
    path = str(tmp_path)
    make(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, path).write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        seen.append((before, docs))
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for _, d in seen]
    toxic = {i for i in range(160) if i % 8 == 0}
    assert set(ids[0]) == ({*range(160), 200, 201, 202, 203, 204} - toxic)
    assert ids[1] == ids[0]
    after = {r.doc_id: r.text for r in seen[1][1].collect()}
    assert after[200] == after[201] == "" and after[202] is None and len(after[3]) > 100
    # similar texts: the least id of each group by the exact similarity of shingle sets (here: copies and empties only)
    shingles = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for d, w in ((d, (t or "").lower().split()) for d, t in after.items())}
    same = lambda a, b: a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8
    want = {d for d in shingles if not any(e < d and same(shingles[e], shingles[d]) for e in shingles)}
    assert set(ids[2]) == want
    assert set(ids[3]) == want - {204}
    assert {r.doc_id for r in seen[4][1].select("doc_id").collect()} == set(ids[3])


def test_run_equals_the_stages(spark, tmp_path):
    make(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} >= {1, 2, 3}
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_each_stage_on_an_empty_table_and_on_rows_that_share_ids(spark, tmp_path):
    path = str(tmp_path)
    make(spark, path)
    rng = random.Random(3)
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    fresh = [words(rng, 40) for _ in range(4)]
    odd = [(None, fresh[0]), (None, fresh[1] + " " + item), (7, fresh[2]), (7, fresh[3] + " " + item), (7, fresh[2]), (8, None), (None, ""), (9, "x " * 30000)]
    df = spark.createDataFrame([(d, t, "en", "s", 0, "x") for d, t in odd], DOCS)
    want = {
        "toxicity": odd,
        "line_dedup": [(d, "x " * 30000 if d == 9 else (t and t.strip())) for d, t in odd],
        "simhash_dedup": [odd[k] for k in (0, 1, 2, 3, 4, 5, 7)],
        "decontamination": [odd[k] for k in (0, 2, 4, 5, 6, 7)],
    }
    clean = lambda rows: sorted(str((d, t and " ".join(t.split()))) for d, t in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), path).count() == 0
        got = stage(spark, df, path)
        if name in want:
            assert got.columns == corpus_pipeline.COLUMNS
            assert clean((r.doc_id, r.text) for r in got.collect()) == clean(want[name]), name
        else:
            pieces = got.collect()
            assert sorted({str(r.doc_id) for r in pieces}) == sorted({str(d) for d, _ in odd})
            assert sum(r.length for r in pieces if r.doc_id == 8) == 1  # a null text is its closing id


def workers(spark):
    """MB of their own memory of the Python workers that now serve, by process."""

    def run(batches):
        time.sleep(0.3)  # so that every worker gets a task
        for _ in batches:
            mb = int(Path("/proc/self/status").read_text().split("RssAnon:")[1].split()[0]) >> 10
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([mb])], names=["pid", "mb"])

    return {r.pid: r.mb for r in spark.range(0, 8, 1, 8).mapInArrow(run, "pid long, mb long").collect()}


def test_workers_give_back_the_memory_of_large_batches(spark, tmp_path):
    rng = random.Random(2)
    path, vocab = str(tmp_path), [words(rng, 1) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(vocab, k=1200)), "en", "s", 0) for i in range(4000)]  # 29 MB
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/d")
    docs = spark.read.parquet(f"{path}/d").coalesce(1)
    before = workers(spark)
    model = toxicity.Model(np.arange(0, 1 << toxicity.BITS, 50), np.full((1 << toxicity.BITS) // 50 + 1, -0.01), 0.0)
    assert toxicity.drop_toxic(docs, model).count() == len(rows)
    after = workers(spark)
    new = max(before.values(), default=0)
    assert max(mb - before.get(pid, new) for pid, mb in after.items()) < 16, (before, after)
