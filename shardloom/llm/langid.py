"""Language identification in two levels.

A linear model first picks the language family; within the family,
one-versus-one linear support vector machines separate its languages and the
votes decide (ties: the larger sum of margins). Features are relative
frequencies of hashed character n-grams over the whole text.

Fitting uses at most ``MAX_ROWS`` rows and ``EACH`` of a language, shared evenly by
the languages: two passes over ids and languages pick them, one over texts reads
them. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import checkpointed, name_package
from shardloom.llm.ngrams import hashed

SIZES = (1, 2, 3)
BITS = 12
MAX_ROWS = 4000
#: Rows of a language at most.
EACH = 1000
_WORDLIKE = re.compile(r"[^\W\d_]")

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn ur pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "celtic": "ga cy gd br",
    "malayo-polynesian": "id ms tl jv su mg",
    "dravidian": "ta te kn ml",
    "sino-tibetan": "zh my bo",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    """The family of a language code; a code that is not listed is its own family."""
    return FAMILY.get(lang.lower().split("-")[0], lang)


@dataclass(frozen=True)
class Model:
    """Families with one weight row each, and in each its languages with a machine for every two."""

    families: list[str]
    top: np.ndarray
    members: dict[str, list[str]]
    machines: dict[str, np.ndarray] = field(default_factory=dict)


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of Unicode's letter categories (fractions, circled digits and such are none)."""
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text or ""))


def vector(text: str) -> np.ndarray:
    """Square roots of n-gram shares (unit length), and 1 for the bias."""
    v = np.zeros((1 << BITS) + 1, dtype=np.float32)
    for h in hashed(text.lower(), SIZES, BITS):
        v[:-1] += np.bincount(h, minlength=1 << BITS)
    if total := v.sum():
        v[:-1] = np.sqrt(v[:-1] / total)
    v[-1] = 1
    return v


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [vector(t).astype(np.float16).tobytes() if has_letter(t) else None for t in (c.as_py() for c in b.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], names=["x", "lang"]).filter(pa.array([v is not None for v in x], pa.bool_()))


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, steps: int = 250) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge), classes balanced; y: +1, -1."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], dtype=np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        gap = np.maximum(0, 1 - y * (x @ w))
        g = -2 * x.T @ (c * y * gap) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS, each: int = EACH) -> Model | None:
    """Fit on at most ``max_rows`` rows with a language, as many of each but ``each`` at most, by a hash of the id.

    Null languages and null ids are left out; of the rows picked, null texts and
    texts without a letter are not learned from. Rows that share id and language
    count as one when picking. More languages than ``max_rows``: some are not
    learned. No rows: None. Whole texts are read, however long; other columns are not.
    """
    name_package(rows.sparkSession)
    known = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.where("lang is not null and id is not null")
    # about four times as many rows of a language as are wanted, by the hash alone, so that no window grows with the table
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / (1 << 31)
    some = known.select("id", "lang", share.alias("h")).join(F.broadcast(counts), "lang").where(F.col("h") * F.col("n") <= 4 * each)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    pick = some.select("id", "lang", "h").withColumn("rank", rank).where(F.col("rank") <= each)
    # the picked ids are bounded by max_rows, so they may be broadcast
    pick = checkpointed(pick.orderBy("rank", "h", "id", "lang").limit(max_rows).select("id", "lang").distinct())
    got = known.join(F.broadcast(pick), ["id", "lang"]).select("text", "lang").mapInArrow(_vectors, "x binary, lang string").collect()
    if not got:
        return None
    x = np.stack([np.frombuffer(r.x, dtype=np.float16) for r in got]).astype(np.float32)
    lang = np.array([r.lang for r in got])
    fam = np.array([family_of(a) for a in lang])
    families = sorted(set(fam))
    sign = lambda on: np.where(on, 1, -1).astype(np.float32)
    top = np.stack([svm(x, sign(fam == f)) for f in families]) if len(families) > 1 else np.zeros((1, x.shape[1]), dtype=np.float32)
    members = {f: sorted(set(lang[fam == f])) for f in families}
    machines = {}
    for f, ls in members.items():
        if len(ls) > 1:
            machines[f] = np.stack([svm(x[(lang == a) | (lang == b)], sign(lang[(lang == a) | (lang == b)] == a)) for a, b in combinations(ls, 2)])
    return Model(families, top, members, machines)


def classify(model: Model, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each row of vectors."""
    z = x @ model.top.T
    best = z.argmax(axis=1)
    e = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
    share = e.max(axis=1) / e.sum(axis=1)
    langs: list[str] = [""] * len(x)
    for k, f in enumerate(model.families):
        rows = np.nonzero(best == k)[0]
        if not len(rows):
            continue
        ls = model.members[f]
        if len(ls) == 1:
            for r in rows:
                langs[r] = ls[0]
            continue
        margin = x[rows] @ model.machines[f].T
        votes, sums = np.zeros((len(rows), len(ls))), np.zeros((len(rows), len(ls)))
        for p, (a, b) in enumerate(combinations(range(len(ls)), 2)):
            votes[:, a] += margin[:, p] > 0
            votes[:, b] += margin[:, p] <= 0
            sums[:, a] += margin[:, p]
            sums[:, b] -= margin[:, p]
        order = votes * 1e6 + sums
        won = order.argmax(axis=1)
        s = np.exp(4 * (sums - sums.max(axis=1, keepdims=True)))
        share[rows] *= s[np.arange(len(rows)), won] / s.sum(axis=1)
        for r, w in zip(rows, won, strict=True):
            langs[r] = ls[w]
    return langs, np.clip(share, 0, 1)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row.

    Null and empty texts and texts without a letter are ``und`` with score 0, as is
    everything where there is no model. Very long texts are read whole. Repeated rows
    are answered each, null ids too; an empty table gives no rows; other columns are
    not read, so clashing names do no harm.
    """
    name_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, share = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                ls, s = classify(model, np.stack([vector(texts[r]) for r in part]))
                share[part] = s
                for r, a in zip(part, ls, strict=True):
                    lang[r] = a
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
