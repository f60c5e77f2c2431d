"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``SPAN`` consecutive words of a benchmark item. Both sides keep, of
the ``GRAM``-word grams of each of their windows, one with the least hash:
neighbouring windows mostly keep the same gram, which counts once. Equal windows
hold equal grams, so every shared span of ``SPAN`` words or more is met. Texts'
grams join the items' grams, and each meeting is extended to the whole window
that the gram stands for and compared word by word.

An item of fewer words is one window, met by the hash of all its words. All
lengths are met in one pass over the texts.
The items' windows are broadcast only while their number and bytes, which are
counted first, stay under the stated bounds; otherwise fingerprints are
shuffled and only texts with a meeting are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import checkpointed, lower_ascii

SPAN = 10
GRAM = 5
#: Bounds of what is broadcast.
MOST_WINDOWS = 500_000
MOST_BYTES = 100_000_000
#: Bytes that are no word's: controls, punctuation, symbols (after A-Z are lower-cased).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
GAPS_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z alone; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.split(F.lower(text), GAPS)
    # lower() also changes letters beyond ASCII, so words that hold any are translated letter by letter
    mixed = F.transform(F.split(text, GAPS_RAW), lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(lower_ascii(w)))
    return F.array_remove(F.when(F.octet_length(text) == F.length(text), plain).otherwise(mixed), "")


def gram_hashes(words: Column, gram: int) -> Column:
    """Hash of every gram, in order; too few words: an empty array."""
    at = F.when(F.size(words) >= gram, F.sequence(F.lit(0), F.size(words) - gram)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[words[i + j] for j in range(gram)]))


def marked(hashes: Column) -> Column:
    """The hashes with their place, modulo 16, in their last four bits: in a window of 16 or less no two are the same."""
    return F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-16)).bitwiseOR(F.pmod(i, F.lit(16)).cast("long")))


def least_in_windows(marks: Column, width: int) -> Column:
    """Least of every ``width`` neighbours, in order; too few: an empty array."""
    at = F.when(F.size(marks) >= width, F.sequence(F.lit(0), F.size(marks) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.least(*[marks[i + j] for j in range(width)]))


def winnowed(least: Column, n: int) -> Column:
    """(len, at, fp) of the grams that are the least of some window, each once. ``least`` must be a plain column: it is looked up for every element."""
    # a gram stays the least of some windows in a row: the first of them counts
    once = F.transform(least, lambda m, i: F.when((i == 0) | (m != F.get(least, i - 1)), F.struct(F.lit(n).alias("len"), (i + F.pmod(m - i, F.lit(16)).cast("int")).alias("at"), m.bitwiseAND(F.lit(-16)).alias("fp"))))
    return F.filter(once, lambda x: x.isNotNull())


def benchmark_windows(items: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows: len, off, win, fp, cls) and (classes: cls, items): each distinct window once for every place of its least gram.

    ``off`` is that gram's place in the window, ``cls`` names a set of items that have a window; ``items`` are their ids as strings.
    Items with a null id or without words have no windows.
    """
    w = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    at = F.expr(f"sequence(0, greatest(0, size(w) - {span}))")
    w = w.select("item", F.explode_outer(F.transform(at, lambda i: F.slice("w", i + 1, span))).alias("win"))
    w = w.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    w = w.withColumn("cls", F.sha2(F.array_join("items", "\x00"), 256))
    w = checkpointed(w)
    grams = F.array(*[F.xxhash64(*[F.get("win", F.lit(i + j)) for j in range(gram)]).bitwiseAND(F.lit(-16)) for i in range(span - gram + 1)])
    w = w.withColumn("k", grams).withColumn("least", F.array_min("k"))
    long = F.transform("k", lambda h, i: F.when(h == F.col("least"), F.struct(i.cast("int").alias("off"), h.alias("fp"))))
    short = F.array(F.struct(F.lit(0).alias("off"), F.xxhash64("win").alias("fp")))
    found = F.filter(F.when(F.size("win") == span, long).otherwise(short), lambda x: x.isNotNull())
    windows = w.select("win", "cls", F.explode(found).alias("g")).select(F.size("win").alias("len"), "g.off", "win", "g.fp", "cls")
    return windows, w.groupBy("cls").agg(F.first("items").alias("items"))


def _whole(n: int) -> Column:
    """(len, at, fp) of every ``n`` words in a row of w."""
    at = F.expr(f"if(size(w) >= {n}, sequence(0, size(w) - {n}), cast(array() as array<int>))")
    return F.transform(at, lambda i: F.struct(F.lit(n).alias("len"), i.alias("at"), F.xxhash64(F.slice("w", i + 1, n)).alias("fp")))


def _printed(texts: DataFrame, lengths: list[int], span: int, gram: int) -> DataFrame:
    """``texts`` with p: (len, at, fp) of the grams and short windows of every length, from their words w."""
    parts = []
    if span in lengths:
        # steps of their own: what lambdas look up per element must be a column, or it is computed per element
        texts = texts.withColumn("k", marked(gram_hashes(F.col("w"), gram)))
        texts = texts.withColumn("m", least_in_windows(F.col("k"), span - gram + 1))
        parts.append(winnowed(F.col("m"), span))
    for n in lengths:
        if n != span:
            parts.append(_whole(n))
    return texts.withColumn("p", F.concat(*parts)).drop("k", "m")


def _met(texts: DataFrame, windows: DataFrame, lengths: list[int], span: int, gram: int, travel: bool) -> DataFrame:
    """(key columns, at, len, cls): windows of texts that equal an item's window.

    ``travel``: the join shuffles, so each row takes the words around its gram
    along and not the text's.
    """
    keys = [c for c in texts.columns if c != "w"]
    # outer: else a filter on the array's size is pushed below, and computes every gram again for each row
    t = _printed(texts, lengths, span, gram).select(*keys, "w", F.explode_outer("p").alias("p"))
    t = t.select(*keys, "w", "p.len", F.col("p.at").alias("g"), "p.fp")
    start = F.col("g") - F.col("off")
    if travel:
        reach = F.when(F.col("len") == span, F.least(F.col("g"), F.lit(span - gram))).otherwise(0)
        t = t.where("fp is not null").select(*keys, "len", "g", "fp", reach.alias("reach"), F.slice("w", F.col("g") - reach + 1, F.lit(2 * span)).alias("near"))
        met = t.join(windows, ["len", "fp"]).where((F.col("off") <= F.col("reach")) & (F.slice("near", F.greatest(F.col("reach") - F.col("off"), F.lit(0)) + 1, F.col("len")) == F.col("win")))
    else:
        met = t.join(windows, ["len", "fp"]).where((start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win")))
    return met.select(*keys, start.alias("at"), "len", "cls")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items (array), hits (array of at, len).

    A word is hit if it lies in an occurrence of an item's window. Null and
    empty texts have no words and no hits; rows that repeat are answered each;
    an empty benchmark hits nothing; other columns are not read.
    """
    return _contamination(docs, items, span, gram, id_col, text_col, most_windows, most_bytes).drop("h")


def _contamination(docs: DataFrame, items: DataFrame, span: int, gram: int, id_col: str, text_col: str, most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What :func:`contamination` answers, and the hash h of each row's text."""
    windows, classes = benchmark_windows(items, span, gram)
    found = windows.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("win", " "))).alias("b")).collect()  # a row per length, span at most
    lengths = sorted(r.len for r in found)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    counted = docs.select("id", "h", F.size(words_of(F.col("text"))).alias("n_words"))
    if not lengths:
        none = F.array().cast("array<struct<at:int,len:int>>")
        return counted.select("h", F.col("id").alias(id_col), F.col("n_words").cast("long"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), none.alias("hits"))
    texts = docs.select("id", "h", words_of(F.col("text")).alias("w"))
    if sum(r.n for r in found) <= most_windows and sum(r.b for r in found) <= most_bytes:
        met = _met(texts, F.broadcast(windows), lengths, span, gram, False)
    else:
        # the fingerprints travel, without words; then only texts with a meeting are cut again
        own = F.array_distinct(F.transform("p", lambda x: x["fp"]))
        fps = _printed(texts, lengths, span, gram).select("id", "h", F.explode_outer(own).alias("fp"))
        some = fps.join(windows.select("fp").distinct(), "fp", "left_semi").select(F.col("id").alias("i2"), F.col("h").alias("h2")).distinct()
        again = docs.join(some, docs.id.eqNullSafe(some.i2) & (docs.h == some.h2), "left_semi")
        met = _met(again.select("id", "h", words_of(F.col("text")).alias("w")), windows, lengths, span, gram, True)
    met = checkpointed(met.distinct())
    spans = met.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    # hits in order of their start: count what reaches beyond the end so far
    reach = lambda s, x: F.greatest(s["end"], x["at"] + x["len"])
    total = F.aggregate("hits", start, lambda s, x: F.struct(reach(s, x).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(s["end"], x["at"]))).alias("n")), lambda s: s["n"])
    spans = spans.withColumn("n_hit", total)
    names = met.select("id", "h", "cls").distinct().join(classes, "cls").groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = spans.join(names, spans.id.eqNullSafe(names.id) & (spans.h == names.h)).select(spans.id.alias("i2"), spans.h.alias("h2"), "n_hit", "items", "hits")
    out = counted.join(both, counted.id.eqNullSafe(both.i2) & (counted.h == both.h2), "left")
    zero = F.lit(0).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(counted.h, F.col("id").alias(id_col), F.col("n_words").cast("long"), F.coalesce(F.col("n_hit").cast("long"), zero).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.coalesce("hits", F.array().cast("array<struct<at:int,len:int>>")).alias("hits"))


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of any item.

    Rows that share an id, or have none, are decided each by its own text, and
    rows that repeat both stay or go together. Null and empty texts have no words
    and stay. Very long texts are read whole. An empty table stays empty, and without
    items every row stays. Extra columns pass through whatever their names.
    """
    hit = _contamination(docs, items, span, GRAM, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("__hit"), F.col("h").alias("__h")).distinct()
    return docs.join(hit, docs[id_col].eqNullSafe(F.col("__hit")) & (F.xxhash64(docs[text_col]) == F.col("__h")), "left_anti")
