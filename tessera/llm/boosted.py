"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside

N_STATS = 20


def _table() -> np.ndarray:
    kind = np.zeros((256, 10))
    for row, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".,;:", "!?", "#*$%&|<>", "\"'()[]{}/\\-_=+@~^`")):
        kind[[ord(c) for c in chars], row] = 1
    kind[128:, 9] = 1
    return kind


_KIND = _table()


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one whole text; a null is an empty text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    share = np.bincount(raw, minlength=256) @ _KIND / n
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    own = max(1, len(lines))
    threes = len(set(zip(words, words[1:], words[2:], strict=False)))
    longest = max(map(len, counts), default=0)
    rest = [
        np.log1p(len(words)),
        sum(len(k) * v for k, v in counts.items()) / w,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        threes / max(1, len(words) - 2),
        1 - len(set(lines)) / own,
        np.log1p(len(lines)),
        np.log1p(len(text) / own),
        np.log1p(longest),
        sum(v for v in counts.values() if v > 1) / w,
    ]
    return np.concatenate([share, rest])


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, node k's children at 2k+1 and 2k+2, flattened into arrays."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray  # trees x inner nodes; goes right above it
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, b, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 0.3, least: float = 0.3) -> Trees:
    """Second-order boosting of the logistic loss; splits are sought in histograms of gradients by quantile bin.

    Without rows the score is 0.5, with one class only it is near that class.
    """
    none = Trees(0.0, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if not len(y):
        return none
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    if y.min() == y.max():
        return Trees(base, none.feature, none.bound, none.leaf)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin > b: above cut b
    margin, inner = np.full(len(y), base), 2**depth - 1
    out_f, out_b, out_l = [], [], []
    flat = coded + np.arange(x.shape[1]) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, b = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (x.shape[1] * bins) + flat).ravel()
            shape = (n, x.shape[1], bins)
            gs = np.bincount(place, np.repeat(g, x.shape[1]), n * x.shape[1] * bins).reshape(shape).cumsum(2)
            hs = np.bincount(place, np.repeat(h, x.shape[1]), n * x.shape[1] * bins).reshape(shape).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(n, -1).argmax(1)
            for k in range(n):
                if gain[k].flat[best[k]] > 1e-6:
                    j, cut = divmod(int(best[k]), bins)
                    if cut < len(cuts[j]):
                        f[first + k], b[first + k] = j, cuts[j][cut]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > b[at])
        spot = at - inner
        leaf = -rate * np.bincount(spot, g, inner + 1) / (np.bincount(spot, h, inner + 1) + l2)
        margin = margin + leaf[spot]
        out_f.append(f)
        out_b.append(b)
        out_l.append(leaf)
    return Trees(base, np.array(out_f), np.array(out_b), np.array(out_l))


def _held_out(doc_id):
    """crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", at_most: int = 20_000) -> DataFrame:
    """(stats, y) of at most ``at_most`` labelled documents outside the held-out fifth, in hash order of the id."""
    key = F.md5(F.col("doc_id").cast("string"))
    sample = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~_held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(key, "doc_id").limit(at_most)
    sample = sample.select(F.col("doc_id").alias("__qc_id"), "y")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__qc_id")).select("doc_id", "text", "y")

    def measured(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "stats": [statistics(t) for t in pdf["text"]]})

    found = rows.mapInPandas(measured, "doc_id long, y int, stats array<double>")
    return found.groupBy("doc_id").agg(F.min(F.struct("y", "stats")).alias("r")).select("r.*")


def train(docs: DataFrame, labels: DataFrame, **how) -> Trees:
    """Fit on a bounded sample of labelled rows (see training_rows); only their statistics come to the driver."""
    got = training_rows(docs, labels, **how).toPandas()
    x = np.stack(got["stats"].to_list()) if len(got) else np.zeros((0, N_STATS))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)
    return fit(x[order], got["y"].to_numpy(float)[order] if len(got) else np.zeros(0))


@beside("held_out", "score", "predicted")
def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, at_most: int = 20_000) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Only the text enters a score. Null texts score like empty ones; a null id is not held out. Rows and columns stay,
    repeated rows get equal scores; where the caller has a column of an added name, the added one has an underscore behind
    it. Long texts are measured whole, one row at a time. An empty table gives an empty table.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, at_most=at_most)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])))

    out = docs.withColumn("held_out", F.coalesce(_held_out(doc_id), F.lit(False))).withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
