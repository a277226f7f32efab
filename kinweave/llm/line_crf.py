"""A linear-chain conditional random field with two labels per line (1 good, 0 bad), trained from labels of whole
documents: each line of a labelled document is taken to have the document's label.

With two labels all messages are log odds, one number per line. Training is done by the driver on a bounded sample of lines;
the scores of documents are put to scale on whole texts, each reduced to one number by the tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import map_batches
from kinweave.llm.lines import Lines, find_lines
from kinweave.llm.words import chunks, mix, texts_of
from kinweave.sources.shared import SharedTable, materialise

#: Labelled documents to learn from, and lines of each; the bound of what the driver gets.
SAMPLE_DOCS = 2000
SAMPLE_LINES = 40
#: Lines that stay together when a longer text is sampled.
_RUN = 8
_ROUNDS = 150
_STEP = 0.15
_PENALTY = 2e-3
#: Transitions stay within this, so that single lines of another kind can still be told.
_MOST_PULL = 1.5


class Crf(NamedTuple):
    """Weights of the features, and scores of going from label i to label j as ``pull[2 * i + j]``; ``slope`` and
    ``offset`` turn the log odds of a document's mean marginal into those of its label; ``prior`` is the share of 1."""

    weights: tuple[float, ...]
    pull: tuple[float, float, float, float]
    slope: float
    offset: float
    prior: float

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return features @ np.array(self.weights, features.dtype)


def _soft(a, b):
    return np.logaddexp(a, b)


def marginals(crf: Crf, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward: the probability of label 1 of each line; lines of text i are ``first[i]`` to ``first[i+1]``."""
    out = np.empty(len(scores))
    p00, p01, p10, p11 = (math.exp(p) for p in crf.pull)
    log, exp = math.log, math.exp
    values = np.clip(scores, -30, 30).tolist()
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if low == high:
            continue
        forward, at = [values[low]], values[low]
        for e in values[low + 1 : high]:
            odds = exp(at)
            at = min(max(e + log((p01 + odds * p11) / (p00 + odds * p10)), -60.0), 60.0)
            forward.append(at)
        back = 0.0
        for k in range(high - 1, low - 1, -1):
            out[k] = forward[k - low] + back
            odds = exp(min(max(back + values[k], -60.0), 60.0))
            back = log((p10 + odds * p11) / (p00 + odds * p01))
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def viterbi(crf: Crf, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most likely labels of all lines of each text together; a tie goes to 1."""
    out = np.ones(len(scores), bool)
    p00, p01, p10, p11 = crf.pull
    values = scores.tolist()
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if low == high:
            continue
        lead, came = values[low], []  # by how much the best path to 1 leads; from which label the best paths come
        for e in values[low + 1 : high]:
            came.append((lead + p10 >= p00, lead + p11 >= p01))
            lead = e + max(p01, lead + p11) - max(p00, lead + p10)
        label = lead >= 0
        out[high - 1] = label
        for k in range(high - 2, low - 1, -1):
            label = came[k - low][label]
            out[k] = label
    return out


def document_score(crf: Crf, good: np.ndarray, lines: Lines) -> np.ndarray:
    """From marginals to the probability of label 1 of each text: their mean, weighted by the lines' lengths, with log
    odds put to scale. A text without words gets the prior."""
    whole, odds = _mean_odds(good, lines)
    odds = odds * crf.slope + crf.offset
    return np.where(whole > 0, 1 / (1 + np.exp(-odds)), crf.prior)


def _mean_odds(good: np.ndarray, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, its characters and the log odds of its mean marginal."""
    texts = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
    n = len(lines.first) - 1
    whole = np.bincount(texts, lines.chars, n)
    return whole, _log_odds(np.bincount(texts, lines.chars * good, n) / np.maximum(whole, 1))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: np.ndarray, pull: np.ndarray) -> tuple:
    """Of the log-likelihood, by weights and by pull. x: documents by lines by features, padded; mask: real lines."""
    e = x @ w
    n, t = mask.shape
    forward, back = np.empty((n, t)), np.zeros((n, t))
    forward[:, 0] = e[:, 0]
    for k in range(1, t):
        a = forward[:, k - 1]
        forward[:, k] = e[:, k] + _soft(pull[1], a + pull[3]) - _soft(pull[0], a + pull[2])
    for k in range(t - 2, -1, -1):
        b = np.where(mask[:, k + 1], back[:, k + 1] + e[:, k + 1], 0)
        step = _soft(pull[2], b + pull[3]) - _soft(pull[0], b + pull[1])
        back[:, k] = np.where(mask[:, k + 1], step, 0)
    p = 1 / (1 + np.exp(-np.clip(forward + back, -60, 60)))
    of_w = np.einsum("ntf,nt->f", x, (y[:, None] - p) * mask)
    a, b, both = forward[:, :-1], (back + e)[:, 1:], mask[:, 1:]
    pairs = np.stack([np.full_like(a, pull[0]), b + pull[1], a + pull[2], a + b + pull[3]])
    pairs = np.exp(pairs - pairs.max(0))
    pairs /= pairs.sum(0)
    real = both.sum(1)
    seen = np.array([(real * (y == 0)).sum(), 0, 0, (real * (y == 1)).sum()])
    return of_w, seen - (pairs * both).sum((1, 2))


def train(x: list[np.ndarray], runs: list[np.ndarray], y: np.ndarray, width: int) -> Crf:
    """From the ``width`` features of lines of some documents, the sizes of the runs that these lines are, and the
    documents' labels. Scores of documents are not to scale yet, see ``scaled``.

    Without documents of both labels nothing can be learnt: every line then has even odds and every document the
    share of 1 among the labels (a half without any).
    """
    prior = float(y.mean()) if len(y) else 0.5
    kept = [i for i in range(len(x)) if len(x[i])]
    if len({int(y[i]) for i in kept}) < 2:
        return Crf((0.0,) * width, (0.0,) * 4, 0.0, float(_log_odds(np.array(prior))), prior)
    chains = [(part, y[i]) for i in kept for part in np.split(x[i], np.cumsum(runs[i])[:-1])]
    t = max(len(part) for part, _ in chains)
    padded, mask = np.zeros((len(chains), t, width)), np.zeros((len(chains), t), bool)
    for row, (part, _) in enumerate(chains):
        padded[row, : len(part)], mask[row, : len(part)] = part, True
    labels = np.array([label for _, label in chains], float)
    w, pull = np.zeros(padded.shape[2]), np.array([0.5, 0.0, 0.0, 0.5])
    both = np.concatenate([w, pull])
    mean, square = np.zeros_like(both), np.zeros_like(both)
    for k in range(1, _ROUNDS + 1):  # Adam
        of_w, of_pull = _gradient(padded, labels, mask, both[:-4], both[-4:])
        g = np.concatenate([of_w, of_pull]) / mask.sum() - _PENALTY * both
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        both = both + _STEP * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        both[-4:] = np.clip(both[-4:], -_MOST_PULL, _MOST_PULL)
    return Crf(tuple(both[:-4].tolist()), tuple(both[-4:].tolist()), 1.0, 0.0, prior)


def scaled(crf: Crf, odds: np.ndarray, labels: np.ndarray) -> Crf:
    """With the slope and offset that fit the log odds of whole documents to their labels."""
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's steps for a logistic regression on one number
        p = 1 / (1 + np.exp(-(slope * odds + offset)))
        d, h = labels - p, np.maximum(p * (1 - p), 1e-6)
        a = np.array([[(h * odds * odds).sum() + 1, (h * odds).sum()], [(h * odds).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(a, [(d * odds).sum() - (slope - 1), d.sum()])
        slope, offset = max(slope + move[0], 0.05), offset + move[1]
    return crf._replace(slope=float(slope), offset=float(offset))


def sample(docs: DataFrame, labels: DataFrame, n: int, *, doc_id: str, text: str, label_id: str, label: str) -> SharedTable:
    """``_id, x, y``: texts and labels of ``n`` labelled documents at most, those whose ids hash lowest. Rows equal in id
    and text count once; where ids have several texts, one of each id comes before any second one. Only rows of
    ``labels`` whose crc32 of the id, as text, is not divisible by 5 are learnt from, the others are held out."""
    usable = labels.select(F.col(label_id).alias("_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % 5 != 0)
    )
    chosen = usable.distinct().orderBy(F.xxhash64("_id"), "_id", "y").limit(n)
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("x"), F.xxhash64(F.col(text).cast("string")).alias("key"))
    # Narrow: a line of 64-bit hashes for each text of the chosen ids.
    texts = materialise(rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "y", "key").distinct(), "texts")
    lowest = texts.df.groupBy("_id", "y").agg(F.min("key").alias("low"))
    order = [F.col("key") != F.col("low"), F.xxhash64("_id", "key"), F.col("_id"), F.col("key"), F.col("y")]
    picked = texts.df.join(F.broadcast(lowest), ["_id", "y"]).orderBy(*order).limit(n).select("_id", "y", F.col("key").alias("_key"))
    fetched = rows.join(F.broadcast(picked), (F.col("_doc") == F.col("_id")) & (F.col("key") == F.col("_key")))
    few = materialise(fetched.dropDuplicates(["_id", "y", "key"]).select("_id", "x", "y"), "labelled")
    texts.drop()
    return few


def runs_of(n: int, most: int, seed: int) -> list[tuple[int, int]]:
    """Begin and end of ``most`` of a text's ``n`` lines at most: all, or runs from its whole length, drawn by a seeded hash."""
    if n <= most:
        return [(0, n)] if n else []
    size = min(_RUN, most)
    draw = mix(np.arange(-(-n // size), dtype=np.uint64) + np.uint64(seed << 32))
    return [(k * size, min(n, (k + 1) * size)) for k in sorted(np.argsort(draw, kind="stable")[: most // size].tolist())]


def fit(
    docs: DataFrame, labels: DataFrame, features: Callable[[Lines], np.ndarray], *, doc_id: str = "doc_id",
    text: str = "text", label_id: str = "doc_id", label: str = "quality", n_docs: int = SAMPLE_DOCS, n_lines: int = SAMPLE_LINES,
) -> Crf:
    """Learn from a bounded sample: ``n_docs`` documents, ``n_lines`` lines of each from anywhere in the text (in runs).
    The scores of documents are put to scale by the same documents' whole texts."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        for at, part in chunks(texts_of(batch.column(1))):
            lines, _ = find_lines(part)
            x, xs, sizes = features(lines).astype(np.float32), [], []
            for i, (a, b) in enumerate(zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True)):
                seed = zlib.crc32(part.data[part.offsets[i] : part.offsets[i + 1]])
                runs = runs_of(b - a, n_lines, seed)
                xs.append(b"".join(x[a + p : a + q].tobytes() for p, q in runs))
                sizes.append(np.array([q - p for p, q in runs], np.int64).tobytes())
            yield [*(c.slice(at, len(xs)) for c in (batch.column(0), batch.column(2))), xs, sizes]

    few = sample(docs, labels, n_docs, doc_id=doc_id, text=text, label_id=label_id, label=label)
    kinds = [few.df.schema["_id"], few.df.schema["y"], T.StructField("x", T.BinaryType()), T.StructField("runs", T.BinaryType())]
    rows = map_batches(few.df, of_batch, T.StructType(kinds)).collect()
    rows.sort(key=lambda r: (str(r[0]), r[1], bytes(r[2])))
    width = features(find_lines(texts_of(pa.array(["a"])))[0]).shape[1]
    x = [np.frombuffer(bytes(r[2]), np.float32).reshape(-1, width) for r in rows]
    crf = train(x, [np.frombuffer(bytes(r[3]), np.int64) for r in rows], np.array([r[1] for r in rows]), width)

    def to_scale(batch: pa.RecordBatch) -> Iterator[list]:
        for at, part in chunks(texts_of(batch.column(1))):
            lines, _ = find_lines(part)
            whole, odds = _mean_odds(marginals(crf, crf.emissions(features(lines)), lines.first), lines)
            keep = np.flatnonzero(whole > 0)
            yield [batch.column(2).slice(at, len(whole)).take(pa.array(keep)), odds[keep]]

    if any(crf.weights):
        pairs = map_batches(few.df, to_scale, T.StructType([few.df.schema["y"], T.StructField("odds", T.DoubleType())])).collect()
        y, odds = np.array(sorted((r[0], r[1]) for r in pairs)).T
        crf = scaled(crf, odds, y)
    few.drop()
    return crf
