"""Line deduplication over content-defined chunks of lines and shared spans of words.

A text's units are its words, each with the white space behind it, so that the
units make it up exactly. Its lines are cut into pieces: a line, and in a long
line each of its sentences. A rolling hash over the hashes of neighbouring
pieces chooses chunk boundaries from content alone, so an insertion shifts no
boundary beyond its own chunk. A long line, and an empty one, also bounds
chunks on both sides.

Passages that hold no whole chunk are met by grams: of every ``SPAN`` words in a
row the ``GRAM``-word gram with the least hash is kept, so two texts that share
``SPAN`` words keep a gram in common, wherever lines and sentences end.

Chunks of enough words, and grams, that occur more than once in the corpus are
compared byte by byte with their first occurrence (least id, then place). Equal
ones are removed, and a removal reaches on as far as the words equal those
beside the first occurrence (of a chunk: into the neighbour chunks; of a gram:
the words that its span can hold), so that a passage goes whole. A gram's
removal must reach ``SPAN`` words, and less than ``GRAM`` words that chunks have
left of it stay. Every removed word equals one at an earlier
place, so one copy always stays. Grams of a single word repeated are left out.

What travels: hashes and places of all chunks and grams, once for counting and
once for those that repeat; then whole texts, once; and of the first occurrences
the pages of ``PAGE`` words that some later occurrence has to be compared with,
each once for every text that needs it, however many of its chunks lie there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.llm.common import checkpointed, name_package, release, stored

#: Pieces that the rolling hash covers, and one in how many of its values ends a chunk.
ROLL = 2
DIVISOR = 3
#: A chunk of fewer words is never removed; a line of so many words is cut into sentences and bounds chunks.
LEAST_WORDS = 12
LONG_LINE = 40
#: Shared spans of so many words are always met, by a gram of so many of them.
SPAN = 50
GRAM = 20
#: Words of a first occurrence that travel together.
PAGE = 32
#: Up to stops before white space, and that; never up to a place inside a word.
_SENTENCE = re.compile(r"[^.!?]*+(?:[.!?]++(?=\S)[^.!?]*+)*+(?:[.!?]++\s*+)?")
_UNIT = re.compile(r"\s*\S+\s*")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd
#: Bytes that are hashed at once.
STEP = 1 << 18
# White space as str.split has it, within ASCII and beyond.
_SPACE = re.compile(rb"[\t-\r\x1c- ]")
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_IS_SPACE = np.array([bool(_SPACE.match(bytes([k]))) for k in range(256)])


@dataclass(frozen=True)
class Shape:
    """What makes up chunks and grams; ``least_words`` 1 removes every repeated chunk, however short."""

    roll: int = ROLL
    divisor: int = DIVISOR
    least_words: int = LEAST_WORDS
    long_line: int = LONG_LINE
    span: int = SPAN
    gram: int = GRAM


def pieces(text: str, long_line: int = LONG_LINE) -> tuple[list[str], list[bool]]:
    """The lines and sentences of a text, which join to it exactly, and whether each starts a bounded line."""
    out: list[str] = []
    edge: list[bool] = []
    after = False
    for line in text.split("\n"):
        n = len(line.split())
        bounds = n >= long_line or n == 0
        edge.append(bounds or after)
        if n >= long_line:
            out += _SENTENCE.findall(line)[:-1]  # the last match is empty
            edge += [False] * (len(out) - len(edge))
            out[-1] += "\n"
        else:
            out.append(line + "\n")
        after = bounds
    out[-1] = out[-1][:-1]
    if not out[-1]:
        out.pop(), edge.pop()
    return out, edge


def units(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text with their white space, which join to it exactly, and whether each starts a line."""
    us = _UNIT.findall(text) or [text] * bool(text)
    return us, ([True] + ["\n" in u for u in us])[: len(us)]


def bounds(us: list[str], edge: list[bool], roll: int = ROLL, divisor: int = DIVISOR) -> list[int]:
    """First piece of every chunk, and the number of pieces."""
    if not us:
        return [0]
    # a piece's hash leaves out its end, so that a passage at a text's end meets the same one inside another
    h = [xxhash.xxh64_intdigest(u.strip().encode("utf-8", "surrogatepass")) for u in us]
    out = [0]
    for i in range(len(us) - 1):
        if edge[i + 1]:
            out.append(i + 1)
        elif i - out[-1] + 1 >= roll:
            rolled = 0
            for x in h[max(0, i - roll + 1) : i + 1]:
                rolled = (rolled * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
            if (rolled >> 33) % divisor == 0:
                out.append(i + 1)
    return [*out, len(us)]


def chunks(text: str | None, shape: Shape = Shape()) -> Iterator[tuple[int, int, str]]:
    """(first unit, number of units, text) of every chunk, in order; blank lines go with the chunk before."""
    ps, edge = pieces(text or "", shape.long_line)
    cuts = bounds(ps, edge, shape.roll, shape.divisor)
    at, n, body = 0, 0, ""
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = "".join(ps[a:b])
        if (words := len(part.split())) and n:
            yield at, n, body
            at, n, body = at + n, 0, ""
        n, body = n + words, body + part
    if body:
        yield at, n or 1, body


def _eligible(n: int, body: str, least_words: int = LEAST_WORDS) -> bool:
    return len(body.split()) >= least_words


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base``, modulo 2**64, from the 0th on."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _scaled(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of ranges from running sums (with a zero before), scaled back to their first."""
    size = 1 << max(10, int(len(sums) - 1).bit_length())
    return (sums[end] - sums[start]) * _powers(pow(base, -1, 1 << 64), size)[start]


def _sums(x: np.ndarray, base: int) -> np.ndarray:
    size = 1 << max(10, int(len(x)).bit_length())
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(x * _powers(base, size)[: len(x)], dtype=np.uint64)))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words of the texts, and the hashes of all their words, in order.

    Words are as ``str.split`` finds them; bytes are hashed ``STEP`` at a time, whole words together.
    """
    raw = [_WIDE_SPACE.sub(" ", t).encode("utf-8", "surrogatepass") if not t.isascii() else t.encode() for t in texts]
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))
    whole = b" ".join(raw)
    starts, out, at = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)], 0
    while at < len(whole):
        stop = len(whole)
        if stop - at > STEP and (m := _SPACE.search(whole, at + STEP)):
            stop = m.start()
        b = np.frombuffer(whole, dtype=np.uint8, count=stop - at, offset=at)
        word = np.concatenate(([False], ~_IS_SPACE[b], [False]))
        turn = np.nonzero(word[1:] != word[:-1])[0]
        s, t = turn[::2], turn[1::2]
        h = _scaled(_sums(b.astype(np.uint64) + np.uint64(1), _BASES[0]), s, t, _BASES[0])
        h = (h ^ (h >> np.uint64(31))) * _MIX
        out.append(h ^ (h >> np.uint64(29)))
        starts.append(s + at)
        at = stop
    return np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0), np.concatenate(out)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest (``pick``) of every ``width`` neighbours."""
    have, n = 1, len(x) - width + 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:n], x[width - have : width - have + n])


def grams(sizes: np.ndarray, w: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, second hash) of the grams that are kept: the least of every ``span`` words in a row of a text.

    ``sizes`` and ``w`` as of :func:`word_hashes`.
    """
    ends = np.cumsum(sizes)
    none = np.empty(0, dtype=np.int64)
    if len(w) < span:
        return none, none, none, none
    n, width = len(w) - gram + 1, span - gram + 1
    at = np.arange(n)
    h, h2 = (_scaled(_sums(w, base), at, at + gram, base) for base in _BASES)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h ^= h >> np.uint64(32)
    h2 ^= h2 >> np.uint64(32)
    changes = np.concatenate(([0], np.cumsum(w[1:] != w[:-1])))
    h[changes[gram - 1 :] == changes[:n]] = np.iinfo(np.uint64).max
    least = _sliding(h, width, np.minimum)
    least[np.arange(len(least)) + span > np.repeat(ends, sizes)[: len(least)]] = 0  # no span of one text
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.nonzero((_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == h) & (h != 0) & (h != np.iinfo(np.uint64).max))[0]
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - sizes)[text], h[at].view(np.int64), h2[at].view(np.int64)


def _chunk_rows(docs: DataFrame, shape: Shape) -> DataFrame:
    """(id, copy, place, reach, hash, hash2) of every chunk and gram that may be removed. ``docs`` has id, copy, text.

    ``place`` holds the first word, the number of words and whether it is a gram, see :func:`_placed`;
    ``reach`` how many words before and after it a removal may take in.
    """
    least, span, gram = shape.least_words, shape.span, shape.gram
    low = (1 << 31) - 1

    def out(ids: pa.Array, copy: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        take = pa.array(rows[0], pa.int64())
        cols = [ids.take(take), copy.take(take), *(pa.array(v, pa.int64()) for v in rows[1:4]), pa.array(rows[4].astype(np.int32), pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["id", "copy", "place", "reach", "hash", "hash2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            texts: list[str] = []
            first = size = 0
            for r, t in enumerate(b.column(2)):
                text = t.as_py() or ""
                before, open_ = 0, None
                for at, n, part in chunks(text, shape):
                    if open_ is not None:
                        rows[2][open_] |= n  # the chunk after it
                        open_ = None
                    if n >= least and (body := part.strip()):
                        d = xxhash.xxh128_intdigest(body.encode("utf-8", "surrogatepass"))
                        open_ = len(rows[0])
                        for col, v in zip(rows, (r, at << 32 | n << 1, before << 32, (d >> 64) - (1 << 63), d & low), strict=True):
                            col.append(v)
                    before = n
                texts.append(text)
                size += len(text)
                if size >= STEP or r == b.num_rows - 1:
                    words, w = word_hashes(texts)
                    k, at, h, h2 = grams(words, w, span, gram)
                    reach = np.minimum(at, span - gram) << 32 | np.minimum(words[k] - at - gram, span - gram)
                    met = (k + first, at << 32 | gram << 1 | 1, reach, h, h2 & low)
                    yield out(b.column(0), b.column(1), [np.concatenate((np.array(v, dtype=np.int64), m)) for v, m in zip(rows, met, strict=True)])
                    rows, texts, first, size = [[] for _ in range(5)], [], r + 1, 0

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "copy", "text").mapInArrow(run, f"id {kind}, copy long, place long, reach long, hash long, hash2 int")


def _placed(place: int) -> tuple[int, int, bool]:
    """First word, number of words, and whether it is a gram."""
    return place >> 32, (place & 0xFFFFFFFF) >> 1, bool(place & 1)


def _repeats(docs: DataFrame, shape: Shape) -> DataFrame:
    """(copy, place, copy1, place1, before, after): every later occurrence, its first one, and how far its removal may reach.

    Hashes are counted with map-side combine. The joins on them have one row a
    hash on one side, so a chunk that a third of all texts hold is split by AQE's
    skew handling on the other. 64 bits pick what may repeat, 95 tell it.
    """
    every, forget = stored(_chunk_rows(docs, shape))
    # cut, so that both sides of the join are plain exchanges and a frequent hash is split
    often, forget_often = stored(every.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"))
    some, forget_some = stored(every.join(often, "hash"))
    forget(), forget_often()
    release(docs.sparkSession)
    first = F.min(F.struct("id", "copy", "place", "reach")).alias("f")
    firsts, forget_firsts = stored(some.groupBy("hash", "hash2").agg(first, F.count("*").alias("times")).where("times > 1").select("hash", "hash2", F.col("f.id").alias("id1"), F.col("f.copy").alias("copy1"), F.col("f.place").alias("place1"), F.col("f.reach").alias("reach1")))
    same = F.col("id").eqNullSafe(F.col("id1")) & (F.col("copy") == F.col("copy1")) & (F.col("place") == F.col("place1"))
    low = F.lit(0xFFFFFFFF)
    least = lambda x, y: F.least(x, y).cast("int")
    before, after = least(F.shiftright("reach", 32), F.shiftright("reach1", 32)), least(F.col("reach").bitwiseAND(low), F.col("reach1").bitwiseAND(low))
    out = checkpointed(some.join(firsts, ["hash", "hash2"]).where(~same).select("copy", "place", "copy1", "place1", before.alias("before"), after.alias("after")))
    forget_some(), forget_firsts()
    return out


def _pages(marked: DataFrame, text_at: int) -> DataFrame:
    """(copy1, page, words): the asked pages of texts. ``marked`` has all columns of the documents, copy and pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], []]
            size = 0
            for text, copy, asked in zip(b.column(text_at), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1), strict=True):
                bare = (text.as_py() or "").split()
                for page in asked.as_py():
                    rows[0].append(copy)
                    rows[1].append(page)
                    rows[2].append(" ".join(bare[page * PAGE : page * PAGE + PAGE]))
                    size += len(rows[2][-1])
                if size >= 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string())], names=["copy1", "page", "words"])
                    rows, size = [[], [], []], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string())], names=["copy1", "page", "words"])

    return marked.mapInArrow(run, "copy1 long, page int, words string")


_AGAIN = ("place", "copy1", "place1", "before", "after")


def cut(text: str, again: dict[str, np.ndarray], pages: dict[tuple[int, int], str], shape: Shape = Shape()) -> tuple[str, list[dict]]:
    """The text without its repeats, and the runs of words (at, n) that were removed.

    ``again`` has place, copy1, place1, before and after of later occurrences,
    ``pages`` the words of their first ones by copy1 and page. Occurrences that
    stand alike in text and first text are compared in one stretch.
    """
    us, _ = units(text)
    bare = text.split()
    keep, more = np.ones(len(us), dtype=bool), np.zeros(len(us), dtype=bool)
    at, n = again["place"] >> 32, (again["place"] & 0xFFFFFFFF) >> 1
    gram, shift = again["place"] & 1, (again["place1"] >> 32) - at
    low, high = at - again["before"], at + n + again["after"]
    order = np.lexsort((low, shift, again["copy1"]))
    copy, shift, low, high, at, n, gram = (x[order] for x in (again["copy1"], shift, low, high, at, n, gram))
    pair = np.cumsum(np.concatenate(([0], (copy[1:] != copy[:-1]) | (shift[1:] != shift[:-1])))) << 40
    fresh = np.concatenate(([True], (pair + low)[1:] > np.maximum.accumulate(pair + high)[:-1]))
    starts = np.nonzero(fresh)[0].tolist()
    for s, t in zip(starts, [*starts[1:], len(copy)], strict=True):
        x, y, by, own = int(low[s]), int(high[s:t].max()), int(shift[s]), int(copy[s])
        a, b = (x + by) // PAGE, (y + by - 1) // PAGE
        first = " ".join([pages.get((own, k), "") for k in range(a, b + 1)]).split(" ")[x + by - a * PAGE :][: y - x]
        same = np.zeros(y - x, dtype=bool)
        same[: len(first)] = np.fromiter(map(str.__eq__, bare[x:y], first), dtype=bool, count=min(len(first), len(bare[x:y])))
        place = np.arange(y - x + 1)
        bad = np.concatenate((~same, [True]))
        until = np.minimum.accumulate(np.where(bad, place, y - x)[::-1])[::-1]  # first unequal word from here on
        since = np.concatenate(([0], np.maximum.accumulate(np.where(bad, place + 1, 0))))  # equal words begin
        i, j = at[s:t] - x, at[s:t] + n[s:t] - x
        left, right = np.maximum(low[s:t] - x, since[i]) + x, np.minimum(high[s:t] - x, until[j]) + x
        right = np.where(n[s:t] > 0, right, at[s:t])
        for u, v, g, ok in zip(left.tolist(), right.tolist(), gram[s:t].tolist(), (until[i] >= j).tolist(), strict=True):
            if ok and not g:
                keep[u:v] = False
            elif ok and v - u >= shape.span:
                more[u:v] = True
    for x, y in _runs(more & keep):
        keep[x:y] = y - x < shape.gram
    gone = [{"at": x, "n": y - x} for x, y in _runs(~keep)]
    return "".join(compress(us, keep.tolist())).strip() if gone else text, gone


def _lists(col: pa.Array, fields: tuple[str, ...]) -> tuple[list[int], list[int], list[pa.Array]]:
    """Starts and ends of a column of lists of structs, and the structs' fields side by side."""
    ends = col.offsets.to_pylist()
    return ends[:-1], ends[1:], [col.values.field(f) for f in fields]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every run of true elements."""
    turn = np.nonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))[0].tolist()
    return list(zip(turn[::2], turn[1::2], strict=True))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """``docs``, all columns and rows, with ``text_col`` less its repeated passages, and a column removed.

    ``removed`` is an array of (at, n): first word and number of words of every run. White
    space left at the ends by a removal is trimmed; a text without a removal
    is unchanged to the byte. Null texts stay null, empty ones empty; an empty table
    gives no rows. Rows that repeat both id and text count as one occurrence and stay
    equal; rows that share an id alone are texts of their own, of which the one with the
    lesser hash counts as the earlier; a null id comes before all others. Very long texts
    are read whole. A column that is already named removed is replaced, other names may clash.

    Both joins with the documents need the same exchange of all their columns,
    which Spark then runs once.
    """
    name_package(docs.sparkSession)
    docs = docs.drop("removed")
    names, at = docs.columns, docs.columns.index(text_col)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("copy"), F.col(text_col).alias("text"))
    later = _repeats(rows, shape)
    words = F.shiftright("place1", 32)
    low, high = words - F.col("before"), words + F.shiftright(F.col("place1").bitwiseAND(F.lit(0xFFFFFFFF)), 1) + F.col("after")
    page = lambda w: F.floor(w / PAGE).cast("int")
    release(docs.sparkSession)
    asked = checkpointed(later.select("copy", "copy1", F.explode(F.sequence(page(low), page(high - 1))).alias("page")).distinct())
    whole = docs.withColumn("__copy", key)
    marks = asked.groupBy("copy1").agg(F.collect_set("page").alias("pages"))  # a text's own pages at most
    marked = whole.join(marks, whole["__copy"] == marks.copy1).select(*[whole[c] for c in names], "__copy", "pages")
    pages = _pages(marked, at).dropDuplicates(["copy1", "page"])  # rows that repeat id and text are one
    spot, text = F.struct("place", "copy1", "place1", "before", "after"), F.struct("copy1", "page", "words")
    given = asked.join(pages, ["copy1", "page"]).select("copy", F.lit(None).cast(later.select(spot.alias("s")).schema["s"].dataType).alias("s"), text.alias("p"))
    spots = later.select("copy", spot.alias("s"), F.lit(None).cast(given.schema["p"].dataType).alias("p"))
    again = spots.unionByName(given).groupBy("copy").agg(F.collect_list("s").alias("__again"), F.collect_list("p").alias("__pages"))
    joined = whole.join(again, whole["__copy"] == again.copy, "left").select(*[whole[c] for c in names], "__again", "__pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = b.column(at).to_pylist(), [[]] * b.num_rows
            marked = b.column(len(names)).is_valid().to_pylist()
            x, y, again = _lists(b.column(len(names)), _AGAIN)
            p, q, (copy, page, words) = _lists(b.column(len(names) + 1), ("copy1", "page", "words"))
            again = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in again]
            for i, text in enumerate(texts):
                if marked[i] and text:
                    own = slice(p[i], q[i])
                    pages = dict(zip(zip(copy[own].to_pylist(), page[own].to_pylist(), strict=True), words[own].to_pylist(), strict=True))
                    texts[i], gone[i] = cut(text, dict(zip(_AGAIN, (c[x[i] : y[i]] for c in again), strict=True)), pages, shape)
            cols = list(b.columns)[: len(names)]
            cols[at] = pa.array(texts, b.column(at).type)
            cols.append(pa.array(gone, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "removed"])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(T.StructType().add("at", T.IntegerType()).add("n", T.IntegerType())))]))
