"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's features are hashed: its words (letters only, lower case), the shapes of its words
(runs of upper case, lower case, digits, and the symbols themselves), and how often a word
follows itself. Feature shares are damped, weighted by rarity and projected on the leading
singular vectors of a bounded sample of labelled texts. The vectors of that sample are broadcast
(``per_label`` rows a label of ``dims`` numbers, whatever the input) and every document is
compared with all of them by exact cosine products, block by block. Its nearest neighbours vote
with a weight that rises with their similarity.

Scores lie in 0 to 1. A text without words, or unlike all neighbours, gets 0.5; so does
everything if one label has no example. Nulls count as empty texts. Neighbours of equal
similarity vote in the order of the sample, which is that of a hash of the text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import WORD, map_rows

WORD_DIMS, SHAPE_DIMS = 4096, 512
DIMS = WORD_DIMS + SHAPE_DIMS + 1
#: Labelled texts used for each label at most.
PER_LABEL = 1500
LATENT = 64
NEIGHBOURS = 25
#: Similarities are raised to this power as weights of votes.
SHARPNESS = 8
#: Weight of the shape features beside the words.
SHAPE_WEIGHT = 2.0
#: Words whose features a task keeps.
KEEP_WORDS = 500_000

words_of = re.compile(WORD).findall
_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(?P<A>[A-ZÀ-ÖØ-Þ]+)|(?P<a>[^\W\d_]+)|(?P<d>\d+)|(?P<s>(.)\5*)")


def shape_of(word: str) -> str:
    """Kinds of runs in a word: A, a, 0, and each symbol once for each run."""
    return "".join(
        {"A": "A", "a": "a", "d": "0"}.get(m.lastgroup, m[0][:1]) for m in _RUNS.finditer(word)
    )


class Features:
    """Hashed features of texts; a bounded table keeps those of words."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.word_bucket = np.zeros(0, np.int32)
        self.shape_bucket = np.zeros(0, np.int32)

    def learn(self, fresh: list[str]) -> None:
        base = len(self.rows)
        words = [zlib.crc32("".join(_LETTERS.findall(w)).lower().encode()) % WORD_DIMS for w in fresh]
        shapes = [zlib.crc32(shape_of(w).encode()) % SHAPE_DIMS for w in fresh]
        self.word_bucket = np.concatenate([self.word_bucket, np.array(words, np.int32)])
        self.shape_bucket = np.concatenate([self.shape_bucket, np.array(shapes, np.int32)])
        self.rows.update((w, base + i) for i, w in enumerate(fresh))

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Share of each feature among the words, by text."""
        if len(self.rows) > KEEP_WORDS:
            self.__init__()
        words = [words_of(t) for t in texts]
        fresh = list(set().union(*words).difference(self.rows))
        if fresh:
            self.learn(fresh)
        out = np.zeros((len(texts), DIMS), np.float32)
        for i, own in enumerate(words):
            if not own:
                continue
            at = np.fromiter(map(self.rows.__getitem__, own), np.int64, len(own))
            out[i, :WORD_DIMS] = np.bincount(self.word_bucket[at], minlength=WORD_DIMS)
            out[i, WORD_DIMS:-1] = np.bincount(self.shape_bucket[at], minlength=SHAPE_DIMS)
            out[i, -1] = np.count_nonzero(at[1:] == at[:-1])
            out[i] /= len(own)
        return out


@dataclass
class VoteModel:
    weights: np.ndarray  # rarity by feature
    basis: np.ndarray  # features by latent dimension
    vectors: np.ndarray  # unit vectors of the sample
    labels: np.ndarray

    def project(self, shares: np.ndarray) -> np.ndarray:
        latent = (np.sqrt(shares) * self.weights) @ self.basis
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, norms, out=np.zeros_like(latent), where=norms > 0)

    def score(self, shares: np.ndarray) -> np.ndarray:
        sims = self.project(shares) @ self.vectors.T
        k = min(NEIGHBOURS, sims.shape[1])
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        votes = np.clip(np.take_along_axis(sims, near, 1), 0, 1).astype(np.float64) ** SHARPNESS
        total = votes.sum(axis=1)
        return np.divide(
            (votes * self.labels[near]).sum(axis=1), total, out=np.full(len(total), 0.5), where=total > 0
        )


def fit(shares: np.ndarray, labels: np.ndarray) -> VoteModel | None:
    """Rarity weights, leading singular vectors and sample vectors; None with one label only."""
    if len(set(labels.tolist())) < 2:
        return None
    present = (shares > 0).sum(axis=0)
    weights = np.log((1 + len(shares)) / (1 + present)).astype(np.float32) + 0.1
    weights[WORD_DIMS:] = SHAPE_WEIGHT
    x = np.sqrt(shares) * weights
    # the smaller Gram matrix gives the same leading vectors as the whole decomposition
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    keep = np.argsort(-values)[:LATENT]
    keep = keep[values[keep] > 1e-9 * values.max()]
    basis = (x.T @ left[:, keep]) / np.sqrt(values[keep])
    model = VoteModel(weights, basis.astype(np.float32), np.zeros((0, len(keep)), np.float32), labels)
    model.vectors = model.project(shares)
    return model


def sample(docs: DataFrame, labels: DataFrame, column: str, per_label: int = PER_LABEL) -> DataFrame:
    """The rows of at most ``per_label`` labelled texts of each label, in the order of a hash of the text.

    A text counts once, however many rows have it; rows of one id and text are all there.
    """
    known = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("_label"))
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("_hash"))
    texts = keyed.join(known, "doc_id").groupBy("_label", "_hash").agg(F.min("doc_id").alias("doc_id"))
    chosen = None
    for value in (0, 1):
        part = texts.where(F.col("_label") == value).orderBy("_hash").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    # two limits bound this side, so it may be broadcast
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    return hashed.join(F.broadcast(chosen), ["doc_id", "_hash"])


def train(
    docs: DataFrame, labels: DataFrame, column: str = "quality", per_label: int = PER_LABEL
) -> VoteModel | None:
    """Fit on the sample's features; they, not the texts, come to the driver."""

    def make():
        features = Features()

        def work(rows):
            shares = features.matrix([t for *_, t in rows])
            return {
                "_hash": [h for h, *_ in rows],
                "_label": [y for _, y, _ in rows],
                "at": [np.flatnonzero(s).tolist() for s in shares],
                "share": [s[s > 0].tolist() for s in shares],
            }

        return work

    chosen = sample(docs, labels, column, per_label)
    schema = "_hash bigint, _label int, at array<int>, share array<float>"
    got = map_rows(chosen.withColumn("_label", F.col("_label").cast("int")), make, schema, ["_hash", "_label", "text"])
    # one row a text: at most 2 * per_label
    rows = got.groupBy("_hash", "_label").agg(F.first("at").alias("at"), F.first("share").alias("share")).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    shares = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        shares[i, r[2]] = r[3]
    return fit(shares, np.array([r[1] for r in rows], np.float64))


def score(docs: DataFrame, model: VoteModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every text, by its key."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features = Features()

        def work(rows):
            inner = shared.value
            values = np.full(len(rows), 0.5)
            if inner is not None:
                values = inner.score(features.matrix([t or "" for _, t in rows]))
            return {key: [k for k, _ in rows], "score": values.tolist()}

        return work

    return map_rows(docs, make, f"{key} bigint, score double", [key, text])
