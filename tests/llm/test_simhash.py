import random

import numpy as np
import xxhash
from pyspark.sql import Row

from shardloom.llm import golay, simhash
from shardloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fp(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_golay_is_perfect():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 4096, 500)
    rem, _ = golay._tables()
    code = (m << 11) | rem[m]
    for w in range(4):
        for _ in range(20):
            e = sum(1 << int(b) for b in rng.choice(23, w, replace=False))
            assert (golay.decode(code ^ e) == m).all()


def test_keys_cover_every_pattern_of_four_errors():
    rng = np.random.default_rng(2)
    for errors in (0, 1, 2, 3, 4):
        x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, errors, replace=False)) for _ in x], dtype=np.uint64)
        (ra, ka), (rb, kb) = simhash.keys_of(x), simhash.keys_of(x ^ flips)
        met = {r for r, _ in set(zip(ra.tolist(), ka.tolist(), strict=True)) & set(zip(rb.tolist(), kb.tolist(), strict=True))}
        assert len(met) == len(x)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 5, 40, 200]))) for _ in range(120)]
    for t in texts[:60]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "Changed"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n", "A B É", texts[7], texts[7], "x " * 30000]
    rows = [Row(doc_id=i * 7 % 1009, text=t, fp="clash", component_id="clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [brute_fp(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], fps)
    assert len(got) == len(rows)
    for r, f in zip(rows, fps, strict=True):
        assert got[r.doc_id].fp & (2**64 - 1) == f
        assert got[r.doc_id].component_id == want[r.doc_id]


def test_long_runs_are_dealt_in_blocks(spark):
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    small = connected_components(simhash.links(df, run_rows=8)).collect()
    assert {r.node for r in small} == set(fps) and len({r.root for r in small}) == 1


def test_components_of_a_long_chain_and_nulls(spark):
    e = [(i, i + 1) for i in range(50)] + [(100, 101), (100, 101), (7, 7), (None, 3)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(51)) and out[101] == 100 and len(out) == 53


def jaccard(a, b, k=5):
    a, b = (set(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "".join(rng.choices("abcdef", k=6))
    return " ".join(w)


def test_similar_groups_against_jaccard(spark):
    rng = random.Random(8)
    rows, pairs = [], []
    for i in range(300):
        text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.choice([60, 200, 400])))
        near = edited(rng, text, rng.choice([1, 2, 3, 5, 20, 40]))
        rows += [(2 * i, text, "c", "c"), (2 * i + 1, near, "c", "c")]
        pairs.append((2 * i, 2 * i + 1, jaccard(text, near)))
    rows += [(9000, None, "", ""), (9001, "", "", ""), (9002, "A b", "", ""), (9003, "a  B", "", ""), (9003, "a  B", "", ""), (9004, rows[0][1], "", ""), (9005, "q " * 50000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for run_rows in (simhash.RUN, 4):
        got = simhash.similar_groups(df, run_rows=run_rows).collect()
        assert len(got) == len(rows)
        root = {r.doc_id: r.component_id for r in got}
        hit = {q: [(root[a] == root[b]) for a, b, j in pairs if lo <= j < hi] for q, lo, hi in (("high", 0.9, 2), ("near", 0.8, 0.9), ("low", 0, 0.8))}
        assert sum(hit["high"]) >= 0.97 * len(hit["high"]) and sum(hit["near"]) >= 0.75 * len(hit["near"]) and sum(hit["low"]) == 0
        texts = {r[0]: r[1] for r in rows}
        assert all(simhash.jaccard(simhash.shingles(texts[a]), simhash.shingles(texts[b])) == j for a, b, j in pairs)
        assert root[9001] == 9000 and root[9003] == 9002 and root[9004] == 0 and root[9005] == 9005
        assert all(root[a] in (a, root[b], b) for a, b, _ in pairs)


def test_wide_keys_meet_for_small_distances():
    rng = np.random.default_rng(3)
    x = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(3)]
    y = [w ^ np.uint64(1 << 5) ^ np.uint64(1 << 40) for w in x]
    (ra, ka), (rb, kb) = simhash.wide_keys(*x), simhash.wide_keys(*y)
    met = {r for r, _ in set(zip(ra.tolist(), ka.tolist(), strict=True)) & set(zip(rb.tolist(), kb.tolist(), strict=True))}
    assert len(met) == 500


def test_empty_and_dedup(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f", "", ""), (2, "a b c d e f", "", ""), (9, "something else entirely here", "", ""), (None, "a b c d e f", "", "")], SCHEMA)
    out = simhash.deduplicate(df)
    assert sorted(r.doc_id for r in out.collect()) == [2, 9] and out.columns == df.columns


def test_dedup_decides_rows_that_share_an_id_or_have_none_each(spark):
    a, b, c = ("one two three four five six seven", "other words that stand in a second group", "a third text of no one's group at all")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, c), (None, c + " but much longer than it was before and so not alike")]
    out = simhash.deduplicate(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, (rows[0], rows[2], rows[5], rows[6])))


def test_families_equal_brute_force_over_all_met_pairs(spark):
    rng = random.Random(21)
    rows = []
    for f in range(12):
        base = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200))
        rows += [(100 * f + i, edited(rng, base, rng.choice([3, 4, 5])), "", "") for i in range(24)]
    # every pair that shares a key and passes both limits, compared exactly
    wide = np.array([simhash.wide_fingerprint(r[1]) for r in rows], dtype=np.uint64)
    runs = {}
    for r, k in zip(*(x.tolist() for x in simhash.wide_keys(*wide.T)), strict=True):
        runs.setdefault(k, set()).add(r)
    share = simhash.differing_share(0.8)
    limit = lambda n: int(np.ceil(n * share + 2.5 * np.sqrt(n * share * (1 - share))))
    sets = [simhash.shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {(i, j) for run in runs.values() for i in run for j in run if i < j}:
        d = np.bitwise_count(wide[i] ^ wide[j])
        if d[0] <= limit(64) and d.sum() <= limit(192) and simhash.jaccard(sets[i], sets[j]) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    met = [rows[find(i)][0] for i in range(len(rows))]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (simhash.BLOCK, 7):
        got = {r.doc_id: r.component_id for r in simhash._groups(df, 0.8, 5, "doc_id", "text", block=block).collect()}
        # whatever met is joined; pairs of one family are looked at even where they share no key
        assert all(got[r[0]] == got[m] for r, m in zip(rows, met, strict=True))
        assert len(set(got.values())) <= len(set(met))
        assert all(got[r[0]] // 100 == r[0] // 100 for r in rows)


def test_a_forest_through_a_refused_text_costs_no_link(spark, monkeypatch):
    rng = random.Random(4)
    a = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200))
    b, c = edited(rng, a, 30), edited(rng, a, 2)
    assert jaccard(a, c) >= 0.8 > max(jaccard(a, b), jaccard(b, c))
    fa, fb, fc = (int(np.uint64(simhash.wide_fingerprint(t)[0]).view(np.int64)) for t in (a, b, c))
    forest = spark.createDataFrame([(fa, fb), (fb, fc)], "a long, b long")  # what a run may pass on of three that meet
    monkeypatch.setattr(simhash, "_meet", lambda *_: forest)
    df = spark.createDataFrame([(1, a, "", ""), (2, b, "", ""), (3, c, "", "")], SCHEMA)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_texts_of_few_shingles_miss_no_link(spark):
    rng = random.Random(31)
    common = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(13))  # a line that a third of the texts hold
    rows = []
    for i in range(260):
        n = rng.choice([5, 6, 8, 9, 10, 12, 14, 20, 28])
        text = (common + " " if i % 3 == 0 else "") + " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n if i % 3 else rng.choice([1, 1, 2, 5])))
        w = text.split()
        at = rng.choice([0, len(w)])
        rows += [(2 * i, text, "", ""), (2 * i + 1, " ".join([*w[:at], "added", *w[at:]]), "", "")]
    sets = {d: simhash.shingles(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    few = [d for d in sets if len(sets[d]) <= simhash.FEW]
    for x, a in enumerate(few):
        for b in few[:x]:
            if simhash.jaccard(sets[a], sets[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[d] == got[find(d)] for d in few) and len({got[d] for d in few}) == len({find(d) for d in few})
    nodes = spark.createDataFrame([(d, simhash.shingle_hashes(t).view(np.int64).tolist()) for d, t, *_ in rows if len(sets[d]) <= simhash.FEW], "node long, few array<long>")
    for block in (256, 5):
        comps = {r.node: r.root for r in connected_components(simhash._few_links(nodes, 0.8, block)).collect()}
        assert all(comps.get(d, d) == find(d) for d in few)


def test_recall_end_to_end_near_the_limit(spark):
    rng = random.Random(17)
    rows, pairs = [], []
    for i in range(260):
        n = rng.choice([30, 60, 150, 400])
        text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
        near = text.split()
        while jaccard(text, " ".join(near)) > 0.85:
            at = rng.randrange(len(near))
            near[at : at + 1] = ["".join(rng.choices("ijkl", k=6))]
        j = jaccard(text, " ".join(near))
        if j >= 0.8:
            pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, text, "", ""), (2 * i + 1, " ".join(near), "", "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    met = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 100 and met >= 0.9 * len(pairs)


def test_a_forest_takes_memory_by_rows():
    import tracemalloc

    rng = np.random.default_rng(5)
    fp = (np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 14, 4096, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4096, dtype=np.uint64))).view(np.int64)
    fp = np.unique(np.concatenate((fp, rng.integers(0, 1 << 62, 4096 - len(np.unique(fp))))))
    tracemalloc.start()
    out = simhash._forest(fp, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == len(fp) - 1 and peak < 100e6
