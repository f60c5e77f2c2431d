"""SimHash near-duplicates with Golay-code fuzzy hashing.

A text's fingerprint has 64 bits. Two fingerprints link at ``MAX_BITS`` or
fewer differing bits. Links are found without comparing all pairs:

* the fingerprint is cut into three segments of 22, 21 and 21 bits;
* pigeonhole on four errors: either one segment is equal and another has at
  most two errors, or two segments have exactly one error each;
* a segment with errors is decoded, with its one-bit changes, to nearby Golay
  codewords (about six), and words that near each other share one;
* a key is an equal part joined to such a codeword: 33 to 35 bits, so that
  chance meetings stay rare in large corpora.

Rows that share a key meet in one sorted run; every candidate is verified by
its exact distance, and a long run passes on only a spanning forest of its
links, never all pairs. Equal fingerprints are one node, however many texts
have it.

Four bits of 64 find texts that differ in very few words. For groups by the
similarity of their shingle sets (:func:`similar_groups`) the fingerprint has
192 bits, of which eight segments of 23 bits are decoded; neighbouring segments
make a key, so texts of similarity 0.8 meet in nine cases of ten and those of
0.9 nearly always. The distance over all bits picks the candidates whose
shingle sets are then compared exactly. Texts of few shingles, whose bits are too
coarse for that, also meet by a prefix filter over their rarest shingles, which
misses none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import golay
from shardloom.llm.common import checkpointed, lean, name_package, release, stored
from shardloom.llm.components import connected_components

MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of one key that a single task compares at most; larger runs are dealt out in blocks.
RUN = 2048
#: Runs of so many rows at most are compared side by side.
SHORT_RUN = 32
#: Nodes of an unsettled family that a task holds, with their texts, of either side of a comparison.
BLOCK = 256
#: Texts of so many distinct shingles at most are also compared by an exact prefix filter; rows of one of its keys that a task compares.
FEW = 25
FEW_RUN = 256
#: 64-bit words of a wide fingerprint, and its segments of 23 bits.
WORDS = 3
WIDE_SEGMENTS = 8


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included.

    Words are runs of bytes other than space and \\t..\\r after lower-casing A-Z.
    Fewer words than ``shingle``: one shingle of all of them. None: zero.
    A bit is set if it is set in over half the shingle hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    digest = xxhash.xxh64_intdigest
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    name_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every key of every fingerprint (uint64)."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    fuzzy = [golay.nearby(seg[i], range(SEGMENTS[i][1])) for i in range(3)]
    own = [golay.decode(s) for s in seg]
    rows, keys, tag = [], [], 0
    for a in range(3):
        for b in range(3):
            if a != b:  # a is equal, b has two errors at most
                r, code = fuzzy[b]
                rows.append(r)
                keys.append((tag << 40) | (seg[a][r] << 12) | code)
                tag += 1
    for a, b in ((0, 1), (0, 2), (1, 2)):
        half = SEGMENTS[a][1] // 2
        for low in (False, True):  # one error in this half of a, one in b
            bits = range(half) if low else range(half, SEGMENTS[a][1])
            rest = seg[a] >> half if low else seg[a] & ((1 << half) - 1)
            r, code = golay.nearby(seg[a], bits)
            rows.append(r)
            keys.append((tag << 40) | (rest[r] << 24) | (code << 12) | own[b][r])
            r, code = fuzzy[b]
            rows.append(r)
            keys.append((tag << 40) | (rest[r] << 24) | (own[a][r] << 12) | code)
            tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def _rows_of_keys(batches: Iterator[pa.RecordBatch], keys: Callable) -> Iterator[pa.RecordBatch]:
    """(key, fp) rows of fingerprints; the first column is the node, all are handed to ``keys``."""
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        for i in range(0, b.num_rows, 2048):
            part = [c[i : i + 2048] for c in cols]
            r, k = keys(*(c.view(np.uint64) for c in part))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(part[0][r], pa.int64())], names=["key", "fp"])


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest, nearest first, of a run's distinct fingerprints of at most ``bits`` apart.

    Grown from one fingerprint at a time, which keeps the nearest so far of each
    that is left: memory follows the run's rows, never its pairs.
    """
    left, u = np.arange(len(fp)), fp.view(np.uint64)
    near, via = np.full(len(fp), 65, dtype=np.uint8), np.zeros(len(fp), dtype=np.int64)
    out: list[tuple[int, int]] = []
    while len(left):
        k = int(near[left].argmin())
        i = int(left[k])
        if near[i] <= bits:
            out.append((int(fp[via[i]]), int(fp[i])))
        left = np.delete(left, k)
        d = np.bitwise_count(u[left] ^ u[i])
        closer = left[d < near[left]]
        near[closer], via[closer] = d[d < near[left]], i
    return [(min(e), max(e)) for e in out]


def _linker(bits: int, run_rows: int):
    """Links among rows sorted by (key, fp); runs over ``run_rows`` pass through."""

    def batch(kind: int, rows: list[np.ndarray]) -> pa.RecordBatch:
        n = len(rows[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *(pa.array(x, pa.int64()) for x in rows)], names=["kind", "a", "b"])

    def runs(key: np.ndarray, fp: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        # short runs side by side, one lag after another; a run with one link passes it on at once
        short = size <= min(SHORT_RUN, run_rows)
        k, f = key[short], fp[short]
        starts = np.nonzero(np.concatenate(([True], k[1:] != k[:-1])))[0] if len(k) else np.empty(0, dtype=np.int64)
        met: list[np.ndarray] = []
        for lag in range(1, int(size[short].max(initial=1))):
            i = np.nonzero(k[lag:] == k[:-lag])[0]
            i = i[np.bitwise_count(f[i].view(np.uint64) ^ f[i + lag].view(np.uint64)) <= bits]
            met.append(np.stack([i, i + lag]))
        edges: list[tuple[int, int]] = []
        if met:
            pairs = np.concatenate(met, axis=1)
            own = np.searchsorted(starts, pairs[0], side="right") - 1
            many = np.bincount(own, minlength=len(starts)) > 1
            one = pairs[:, ~many[own]]
            if one.size:
                yield batch(0, list(np.unique(f[one], axis=1)))
            ends = np.concatenate((starts[1:], [len(k)]))
            edges += [e for r in np.nonzero(many)[0].tolist() for e in _forest(f[starts[r] : ends[r]], bits)]
        k, f = key[~short], fp[~short]
        if len(k):
            starts = np.nonzero(np.concatenate(([True], k[1:] != k[:-1])))[0]
            edges += [e for s, t in zip(starts.tolist(), [*starts[1:].tolist(), len(k)], strict=True) for e in _forest(f[s:t], bits)]
        if edges:
            yield batch(0, list(np.unique(np.array(edges, dtype=np.int64).T, axis=1)))

    def whole(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        size = np.repeat(sizes, sizes)
        if (long := size > run_rows).any():
            yield batch(1, [key[long], fp[long]])
        use = (size > 1) & ~long
        if use.any():
            yield from runs(key[use], fp[use], size[use])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        key, fp, hot = none, none, None
        for b in batches:
            k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            key, fp = np.concatenate((key, k)), np.concatenate((fp, f))
            if hot is not None:  # the run of this key is too long and is being passed on
                n = int(np.searchsorted(key, hot, side="right"))
                if n:
                    yield batch(1, [key[:n], fp[:n]])
                    key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                hot = None
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
            key, fp = key[fresh], fp[fresh]
            last = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
            yield from whole(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            if len(key) > run_rows:
                hot = int(key[-1])
                yield batch(1, [key, fp])
                key, fp = none, none
        yield from whole(key, fp)

    return link


def _meet(nodes: DataFrame, keys: Callable, bits: int, run_rows: int, done: list[Callable[[], None]] | None = None) -> DataFrame:
    """(a, b): links among nodes (first column, others are handed to ``keys``) that share a key.

    With ``done`` what was met is stored, free of the keys' shuffle, and what deletes it is appended there.
    """
    rows = nodes.mapInArrow(lambda batches: _rows_of_keys(batches, keys), "key long, fp long")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_linker(bits, run_rows), "kind int, a long, b long")
    if done is None:
        met = checkpointed(met)
    else:
        met, forget = stored(met)
        done.append(forget)
    del rows
    release(nodes.sparkSession)
    found = met.where("kind = 0").select("a", "b")
    hot = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return found
    # a long run: deal its rows into blocks and compare block with block, each in a task of bounded size
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / run_rows).cast("int").alias("n"))
    dealt = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")

    def block(t: pa.Table) -> pa.Table:
        e = _forest(np.unique(t.column("fp").to_numpy()), bits)
        return pa.table({"a": pa.array([p for p, _ in e], pa.int64()), "b": pa.array([q for _, q in e], pa.int64())})

    more = dealt.groupBy("key", "x", "y").applyInArrow(block, "a long, b long")
    return found.union(more)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, run_rows: int = RUN) -> DataFrame:
    """(a, b): links that join all components of distinct fingerprints (column fp).

    Complete up to 4 differing bits. Long runs give a spanning forest, so the
    rows follow the number of fingerprints, not its square.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys cover at most {MAX_BITS} differing bits")
    return _meet(distinct.select("fp"), keys_of, max_bits, run_rows)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (long), component_id (least id reachable over links).

    Null and empty texts have fingerprint zero and link like any other; exact
    copies and repeated rows share a component; a null id is kept and only
    counts where its whole component has none. An empty table gives no rows;
    other columns are not read, so clashing names do no harm.
    """
    marked = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    firsts = checkpointed(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys cover at most {MAX_BITS} differing bits")
    done: list[Callable[[], None]] = []
    comps = checkpointed(connected_components(_meet(firsts.select("fp"), keys_of, max_bits, RUN, done)))
    for forget in done:
        forget()
    least = comps.join(firsts, comps.node == firsts.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    named = comps.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # cut here, so that both sides of the last join are plain exchanges and a frequent fingerprint is split
    every = checkpointed(firsts.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return marked.join(every, "fp").select(id_col, "fp", "component_id")


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes, ascending, of a text's word shingles (words and short texts as in :func:`fingerprint`)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined)], dtype=np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], dtype=np.uint64))


def wide_of(h: np.ndarray) -> tuple[int, ...]:
    """SimHash of ``WORDS`` 64-bit words of a set of hashes; of none: all zero."""
    if not len(h):
        return (0,) * WORDS
    out = []
    for k in range(WORDS):
        g = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        g = (g ^ (g >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        g = (g ^ (g >> np.uint64(33))).astype(">u8")
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(g), 1 << 16):
            ones += np.unpackbits(g[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(g)).tobytes(), "big"))
    return tuple(out)


def wide_fingerprint(text: str | None, shingle: int = 5) -> tuple[int, ...]:
    """SimHash of ``WORDS`` 64-bit words over the set of a text's word shingles; no words: all zero."""
    return wide_of(shingle_hashes(text, shingle))


def wide_keys(*words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key): nearby codewords of each two neighbouring segments (the last's neighbour is the first)."""
    codes = []
    for s in range(WIDE_SEGMENTS):
        w, at = divmod(s * golay.LENGTH, 64)
        bits = words[w] >> np.uint64(at)
        if at + golay.LENGTH > 64:
            bits = bits | (words[w + 1] << np.uint64(64 - at))
        seg = (bits & np.uint64((1 << golay.LENGTH) - 1)).astype(np.int64)
        r, c = golay.nearby(seg, range(golay.LENGTH))
        first = np.searchsorted(r, np.arange(len(seg)))
        grid = np.full((len(seg), 6), -1, dtype=np.int64)  # a word has one or six codewords within distance four
        grid[r, np.arange(len(r)) - first[r]] = c
        codes.append(grid)
    rows, keys = [], []
    for s in range(WIDE_SEGMENTS):
        a, b = codes[s][:, :, None], codes[(s + 1) % WIDE_SEGMENTS][:, None, :]
        use = np.nonzero((a >= 0) & (b >= 0))
        rows.append(use[0])
        keys.append(((s << 24) | (a << 12) | b)[use])
    return np.concatenate(rows), np.concatenate(keys)


def differing_share(similarity: float) -> float:
    """Share of differing bits to expect of two shingle sets of this similarity and like size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingles(text: str | None, shingle: int = 5) -> set[bytes]:
    """A text's set of word shingles (words and short texts as in :func:`fingerprint`)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def jaccard(a: set, b: set) -> float:
    """Shared part of two sets; of two empty ones 1."""
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def _wide(docs: DataFrame, shingle: int, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """(id, copy, node, few, f0, f1, f2[, text]) of every row; ``copy`` is a hash of the text, so that rows sharing an id stay apart.

    ``node`` is a hash of the whole set of shingles: texts of one node have equal sets. ``few``:
    that set's hashes, where there are ``FEW`` at most.
    """
    names = [f"f{k}" for k in range(WORDS)]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, wide, few = [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), shingle)
                node.append(xxhash.xxh64_intdigest(h.tobytes()))
                wide.append(wide_of(h))
                few.append(h.view(np.int64) if len(h) <= FEW else None)
            f = np.array(wide, dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            cols = [b.column(0), b.column(2), pa.array(np.array(node, dtype=np.uint64).view(np.int64), pa.int64()), pa.array(few, pa.list_(pa.int64())), *(pa.array(f[:, k], pa.int64()) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays(cols + [b.column(1)] * with_text, names=[id_col, "copy", "node", "few", *names] + ["text"] * with_text)

    name_package(docs.sparkSession)
    schema = f"`{id_col}` {kind}, copy long, node long, few array<long>, " + ", ".join(f"{n} long" for n in names) + ", text string" * with_text
    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("copy")).mapInArrow(lean(run), schema)


def _verified(pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b) of the pairs (a, b, ta, tb) whose texts' shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, keep = (None, set()), []
            for x, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last[0] != x:
                    last = (x, shingles(ta.as_py(), shingle))
                keep.append(jaccard(last[1], shingles(tb.as_py(), shingle)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes in ``asked``: a small part of the table, found by id and text hash."""
    wanted = asked.join(nodes, "node").select("node", F.col("first").alias("__first"), F.col("copy").alias("__copy"))
    some = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("__h"))
    some = some.join(wanted, (F.col("__h") == F.col("__copy")) & F.col("__id").eqNullSafe(F.col("__first")))
    # rows that repeat id and text are one
    return some.groupBy("node").agg(F.min("text").alias("text"))


def _few_links(nodes: DataFrame, similarity: float, run_rows: int = FEW_RUN) -> DataFrame:
    """(a, b): links that join all similar nodes of few shingles (node, few), exactly.

    Two sets of this similarity share a shingle among the ``n - ceil(similarity * n) + 1``
    rarest of each, whatever their sizes. Shingles of one node alone come first in
    that order and meet nothing, so most nodes have no key. A key's rows are dealt into
    blocks, pairs of which are compared, so that no task holds more than two.
    """
    each = nodes.where("size(few) > 0").select("node", F.explode("few").alias("sh"))
    often = checkpointed(each.groupBy("sh").agg(F.count("*").alias("n")).where("n > 1"))
    shared = each.join(often, "sh").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "sh"))).alias("shared"))
    size = F.size("few")
    keep = size - F.ceil(F.lit(similarity) * size - 1e-9) + 1 - (size - F.size("shared"))
    keys = nodes.select("node", "few").join(shared, "node").where(keep > 0).select("node", "few", F.explode(F.slice("shared", F.lit(1), keep.cast("int"))).alias("k"))
    keys = checkpointed(keys.select("node", "few", F.col("k.sh").alias("sh")))
    runs = keys.groupBy("sh").agg(F.count("*").alias("n")).where("n > 1").select("sh", F.ceil(F.col("n") / run_rows).cast("int").alias("n"))
    dealt = keys.join(checkpointed(runs), "sh").withColumn("own", F.pmod(F.xxhash64("node"), "n").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    dealt = dealt.select("sh", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "few")

    def forest(rows: list[tuple[int, set]]) -> list[tuple[int, int]]:
        out, left = [], rows
        while left:
            todo, left = [left[0]], left[1:]
            while todo:
                a, own = todo.pop()
                rest = []
                for b, other in left:
                    small, large = sorted((len(own), len(other)))
                    if small >= similarity * large and jaccard(own, other) >= similarity:
                        out.append((min(a, b), max(a, b)))
                        todo.append((b, other))
                    else:
                        rest.append((b, other))
                left = rest
        return out

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, {}
        for b in batches:
            found: list[tuple[int, int]] = []
            for key, node, few in zip(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), b.column(3).to_pylist(), b.column(4), strict=True):
                if key != last:
                    found += forest(list(rows.items()))
                    last, rows = key, {}
                rows[node] = set(few.as_py())
            yield edges(found)
        yield edges(forest(list(rows.items())))

    def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "sh", "x", "y").sortWithinPartitions("sh", "x", "y").mapInArrow(link, "a long, b long")


def _unsettled(pairs: DataFrame, found: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(family, x, y, side, node, f0, f1, f2, comp): nodes to compare again, dealt into pairs of blocks.

    A family is what the candidates ``pairs`` connect. All pairs that met are
    inside one, but a run passes on a forest only, so where the exact comparison
    has left several components, pairs that were not passed on may join them.
    Nodes outside the family's largest component (side 0) meet all of other
    components (side 1). In a family of two nothing was left out.
    """
    family, comps = connected_components(pairs), connected_components(found)
    comps = comps.select(F.col("node").alias("n2"), F.col("root").alias("comp"))
    named = checkpointed(family.join(comps, family.node == comps.n2, "left").select("node", F.col("root").alias("family"), F.coalesce("comp", "node").alias("comp")))
    sizes = named.groupBy("family", "comp").agg(F.count("*").alias("n"))
    left = sizes.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most")).where("n > 2 and n > most.n")
    left = left.select("family", F.col("most.comp").alias("largest"), F.ceil(F.col("n") / block).cast("int").alias("n"), F.ceil((F.col("n") - F.col("most.n")) / block).cast("int").alias("r"))
    some = checkpointed(named.join(left, "family").join(nodes.select("node", *[f"f{k}" for k in range(WORDS)]), "node"))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    cols = ["node", *[f"f{k}" for k in range(WORDS)], "comp"]
    rest = some.where("comp != largest").select("family", own("r").alias("x"), F.explode(F.expr("sequence(0, n - 1)")).alias("y"), F.lit(0).alias("side"), *cols)
    whole = some.select("family", F.explode(F.expr("sequence(0, r - 1)")).alias("x"), own("n").alias("y"), F.lit(1).alias("side"), *cols)
    return checkpointed(rest.union(whole))


def _joined(dealt: DataFrame, texts: DataFrame, limit: int, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links of similar texts that join components of the families in ``dealt``, a forest of each pair of blocks."""

    def compare(t: pa.Table) -> pa.Table:
        f = [t.column(f"f{k}").to_numpy().view(np.uint64) for k in range(WORDS)]
        comp, side, node = t.column("comp").to_numpy(), t.column("side").to_numpy(), t.column("node").to_numpy()
        right = np.nonzero(side == 1)[0]
        met: list[np.ndarray] = [np.empty((3, 0), dtype=np.int64)]
        for i in np.nonzero(side == 0)[0].tolist():
            d = sum(np.bitwise_count(w[right] ^ w[i]).astype(np.int64) for w in f)
            use = (d <= limit) & (comp[right] != comp[i])
            met.append(np.stack([d[use], np.full(int(use.sum()), i), right[use]]))
        pairs = np.concatenate(met, axis=1)
        root: dict[int, int] = {}
        sets: dict[int, set] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        def of(i: int) -> set:
            if i not in sets:
                sets[i] = shingles(t.column("text")[i].as_py(), shingle)
            return sets[i]

        a, b = [], []
        for k in np.argsort(pairs[0], kind="stable").tolist():
            i, j = int(pairs[1, k]), int(pairs[2, k])
            if (u := find(int(comp[i]))) != (v := find(int(comp[j]))) and jaccard(of(i), of(j)) >= similarity:
                root[max(u, v)] = min(u, v)
                a.append(int(node[i]))
                b.append(int(node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.join(texts, "node").groupBy("family", "x", "y").applyInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN) -> DataFrame:
    """One row per input row: id, component_id (least id reachable over links of similar texts).

    Texts link whose sets of word shingles share ``similarity`` or more.
    Candidates are those that share a key and whose distance is at most two and
    a half standard errors beyond what that similarity lets expect; only the
    texts of candidates are looked at again, and every link is compared exactly. Runs pass on
    forests of candidates; where the exact comparison splits what they connect,
    all pairs between the parts are looked at. Of texts of ``FEW`` distinct shingles or
    less no link is missed. Only texts of equal shingle sets are
    one node. Nulls, copies and empty tables as in :func:`near_duplicates`.
    """
    return _groups(docs, similarity, shingle, id_col, text_col, run_rows).drop("copy")


def _groups(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str, run_rows: int = RUN, block: int = BLOCK) -> DataFrame:
    """What :func:`similar_groups` answers, and the hash copy of each row's text."""
    share = differing_share(similarity)
    limit = lambda n: math.ceil(n * share + 2.5 * math.sqrt(n * share * (1 - share)))
    names = [f"f{k}" for k in range(WORDS)]
    marked = checkpointed(_wide(docs, shingle, id_col, text_col, False))
    least = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "copy")).alias("l")  # nulls last
    nodes = marked.groupBy("node").agg(least, F.first("few").alias("few"), *[F.first(n).alias(n) for n in names])
    nodes = checkpointed(nodes.select("node", F.col("l.id").alias("first"), F.col("l.copy").alias("copy"), "few", *names))
    exact = checkpointed(_few_links(nodes, similarity).distinct())
    # runs are of first words; the least node of each stands for it, and is a candidate of its others
    prints = checkpointed(nodes.groupBy("f0").agg(F.min(F.struct("node", *names[1:])).alias("m")).select("f0", F.col("m.node").alias("node"), *[F.col(f"m.{n}").alias(n) for n in names[1:]]))
    done: list[Callable[[], None]] = []
    met = _meet(prints.select(*names), wide_keys, limit(64), run_rows, done)
    met = met.join(prints.select(F.col("f0").alias("a"), F.col("node").alias("na")), "a").join(prints.select(F.col("f0").alias("b"), F.col("node").alias("nb")), "b")
    alike = nodes.select("f0", F.col("node").alias("b")).join(prints.select("f0", F.col("node").alias("a")), "f0").where("a != b")
    a, b = (nodes.select(F.col("node").alias(x), *[F.col(n).alias(f"{x}_{n}") for n in names]) for x in ("a", "b"))
    apart = sum((F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names), F.lit(0))
    every = met.select(F.col("na").alias("a"), F.col("nb").alias("b")).union(alike.select("a", "b")).distinct()
    every = every.join(a, "a").join(b, "b").select("a", "b", apart.alias("apart"))
    # farther apart than texts of half the similarity: they met by chance, and would tie all families together
    pairs, forget = stored(every.where(F.col("apart") <= round(64 * WORDS * differing_share(similarity / 2))))
    done.append(forget)
    del met, alike, every
    release(docs.sparkSession)
    near = checkpointed(pairs.where(F.col("apart") <= limit(64 * WORDS)).select("a", "b"))
    pairs = pairs.select("a", "b")
    # of all that met, so that texts are fetched once for both comparisons
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts, forget = stored(_texts(docs, nodes, asked, id_col, text_col))
    done.append(forget)
    release(docs.sparkSession)
    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    ready = near.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").sortWithinPartitions("a")
    found = checkpointed(_verified(ready, similarity, shingle))
    dealt = _unsettled(pairs, found, nodes, block)
    comps = checkpointed(connected_components(found.union(exact).union(_joined(dealt, texts, limit(64 * WORDS), similarity, shingle))))
    for forget in done:
        forget()
    least = comps.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    named = comps.join(least, "root").select("node", "component_id")
    every = checkpointed(nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")))
    return marked.join(every, "node").select(id_col, "copy", "component_id")


def deduplicate(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group of similar texts.

    Rows with a null id stay only where their group has no id at all; rows
    that repeat an id and its group stay together with the first. Rows that
    share an id are decided each by its own text's group.
    """
    groups = _groups(docs, similarity, shingle, id_col, text_col)
    keep = groups.where(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("__keep"), F.col("copy").alias("__copy")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(F.col("__keep")) & (F.xxhash64(docs[text_col]) == F.col("__copy")), "left_semi")
