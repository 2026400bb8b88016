"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic texts and from unlabelled ones. With the
class prior p, the risk is ``p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic))``; where the second part falls below
zero the step goes the other way, so that the classifier doesn't learn to call every unlabelled text clean.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import column, kept, map_rows, texts

WORD = re.compile(r"[^\W\d_]+")
#: Different confirmed toxic and unlabelled texts taken at most.
POSITIVES, UNLABELLED = 6_000, 18_000
#: A word counts if its shares of toxic and of unlabelled texts differ by so many standard errors; so many count at least.
ERRORS, LEAST = 6.0, 12
STEPS, RATE, DECAY, BETA, GAMMA = 1500, 0.05, 1e-6, 0.02, 1.0
CACHED = 120_000


class Places(dict):
    """Word to its place, the crc32 of its bytes; bounded, as long-lived as the worker."""

    def __missing__(self, word: str) -> int:
        place = zlib.crc32(word.encode())
        if len(self) >= CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = place
        return place

    def of(self, text: str) -> np.ndarray:
        """The sorted distinct places of a whole text's words."""
        words = set(WORD.findall(text.lower()))
        return np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))


@dataclass
class Model:
    """Sorted places with their weights; all other words weigh nothing."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, places: np.ndarray) -> float:
        z = self.bias
        if len(self.places) and len(places):
            at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
            z += float(self.weights[at[self.places[at] == places]].sum())
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


class Rows:
    """Sparse rows: places one after another (as the rows have them, or 64-bit), and where each row starts."""

    def __init__(self, rows: list[np.ndarray]):
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.places = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.start) - 1

    def entries(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, place) of every entry, and the number of rows."""
        return np.repeat(np.arange(len(self)), np.diff(self.start)), self.places, len(self)


def telling(p: Rows, u: Rows) -> np.ndarray:
    """The places whose share differs between toxic and unlabelled texts by more than chance: others only add noise."""
    n_p, n_u = len(p), len(u)
    own_p, times_p = np.unique(p.places, return_counts=True)
    own_u, times_u = np.unique(u.places, return_counts=True)
    found = np.union1d(own_p, own_u).astype(np.int64)
    of_p, of_u = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    of_p[np.searchsorted(found, own_p)], of_u[np.searchsorted(found, own_u)] = times_p, times_u
    share = (of_p + of_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    z = np.abs(of_p / n_p - of_u / n_u) / error
    return found[z >= min(ERRORS, np.sort(z)[-min(LEAST, len(z))])] if len(z) else found


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The classifier of least non-negative risk; with no toxic or no unlabelled text, every score is the prior."""
    prior = min(max(prior, 1e-4), 0.9)
    b, none = float(np.log(prior / (1 - prior))), np.zeros(0, np.int64)
    if not positive or not unlabelled:
        return Model(none, none.astype(float), b, prior)
    chosen = telling(Rows(positive), Rows(unlabelled))
    narrow = lambda rows: Rows([np.searchsorted(chosen, r[np.isin(r, chosen)]) for r in rows])
    p, u = narrow(positive), narrow(unlabelled)
    v, d = np.zeros(len(chosen)), len(chosen)
    moment, square, moments = np.zeros(d + 1), np.zeros(d + 1), (0.9, 0.999)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    (ru, xu, n_u), (rp, xp, n_p) = u.entries(), p.entries()
    for step in range(1, STEPS + 1):
        zu, zp = np.bincount(ru, v[xu], n_u) + b, np.bincount(rp, v[xp], n_p) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        du, dp = sigmoid(zu) / n_u, -prior * sigmoid(zp) / n_p
        if negative >= -BETA:
            dp = dp - prior * (1 - sigmoid(zp)) / n_p
        else:
            du, dp = -GAMMA * du, -GAMMA * dp
        g = np.bincount(np.concatenate([xu, xp]), np.concatenate([du[ru], dp[rp]]), d) + DECAY * v
        g = np.append(g, du.sum() + dp.sum())
        moment += (1 - moments[0]) * (g - moment)
        square += (1 - moments[1]) * (g * g - square)
        change = RATE * (moment / (1 - moments[0] ** step)) / (np.sqrt(square / (1 - moments[1] ** step)) + 1e-8)
        v -= change[:-1]
        b -= float(change[-1])
    return Model(chosen, v, b, prior)


def place_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``k, places``: a number from 0 to below 1 by each text's hash, and its distinct hashed words as little-endian unsigned 32-bit numbers."""
    key = uuid.uuid4().hex

    def per_batch(batch: pa.RecordBatch) -> dict:
        places = kept(key, Places)
        return {"k": column(batch, "k"), "places": [places.of(x).astype("<u4").tobytes() for x in texts(batch, text)]}

    return map_rows(docs.select("k", text), per_batch, "k double, places binary", key)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from the rows where ``learn`` holds; ``labels`` has ``id_col`` and ``label`` (1: toxic).

    The prior is the share of toxic rows among the labelled ones. At most ``positives`` confirmed and ``unlabelled`` other texts
    are taken, by the least hashes; equal texts count once, so that no group of copies fills either sample. The labels of the
    unlabelled ones are not looked at.
    """
    known = labels.where(learn).where(F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("__label"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0))).first()
    key = F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)
    rows = docs.where(learn).select(id_col, text).where(f"`{text}` is not null and `{text}` <> ''").withColumn("k", key)
    # So many ids at most: they can be sent to every task, and no text is shuffled.
    confirmed = known.where("__label = 1").select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(positives)

    def pick(df: DataFrame, most: int) -> list[np.ndarray]:
        """Only words' numbers are shuffled, one row for each text drawn."""
        drawn = place_rows(df, text).dropDuplicates(["k"]).orderBy("k").limit(most)
        return [np.frombuffer(r["places"], "<u4") for r in drawn.toLocalIterator()]

    chosen_p = pick(rows.join(F.broadcast(confirmed), id_col, "left_semi"), positives) if toxic else []
    different = rows.agg(F.approx_count_distinct("k", 0.02)).first()[0]
    chosen_u = pick(rows.where(F.col("k") < min(1.0, 1.2 * unlabelled / max(different, 1))), unlabelled) if different else []
    return train(chosen_p, chosen_u, toxic / n if n else 0.0)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, score`` of every whole text: how likely label 1 is, 0 to 1.

    Null and empty texts have no words and get the bias alone; equal texts get equal scores; repeated rows repeat; an empty
    table gives none; further columns are not read.
    """
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch: pa.RecordBatch) -> dict:
        places = kept(key, Places)
        return {id_col: column(batch, id_col), "score": [sent.value.score(places.of(x)) for x in texts(batch, text)]}

    return map_rows(docs.select(id_col, text), per_batch, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double", key)
