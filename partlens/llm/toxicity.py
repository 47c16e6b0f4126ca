"""Toxicity by a factorization machine over hashed terms.

The score of a document is a logistic function of a bias, a weight for each of its distinct terms and an
interaction for each pair of them, the product of the terms' factor vectors; so an insult beside a
mention of a group can weigh more than the two alone.

The model is trained on the driver on a sample of labelled documents, ``TRAIN_ROWS`` at most, chosen by a
hash of the id and taken in the order of ids, so that the order of rows does not matter; its size is fixed by
``BITS`` and ``FACTORS``. Before training, terms are screened: those that tell the classes apart alone stay, and
those that tell them apart in a pair, though they may say nothing alone. Scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, small_batches, text_of

BITS = 18
FACTORS = 8
#: Bound of the training sample: labelled documents that are sent to the driver at most.
TRAIN_ROWS = 20_000
#: Terms in fewer training documents carry no weight, and of the others those that tell the classes apart
#: best: all with a likelihood ratio of at least ``MIN_RATIO``, and the best ``LEAST_TERMS`` in any case.
MIN_DOCS = 3
MIN_RATIO = 12.0
LEAST_TERMS = 64
#: Pairs are looked for among so many terms (those present in and absent from most training documents), and a pair
#: stays if its likelihood ratio beyond those of its terms is this much: 2 million pairs give none by chance.
PAIR_TERMS = 2048
PAIR_RATIO = 40.0
#: Spread of the factors before training.
FIRST = 0.05
FOLDS = 5


def term_ids(text: Column) -> Column:
    """Hashed ids of a text's distinct terms: runs of letters and digits, in lower case."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(1 << BITS)).cast("int")))


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # (2^BITS,)
    factor: np.ndarray  # (2^BITS, FACTORS)

    def raw(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-odds of documents; document i has the terms ``flat[starts[i]:starts[i + 1]]``."""
        n = len(starts) - 1
        out = np.full(n, self.bias)
        full = np.flatnonzero(np.diff(starts) > 0)
        if len(full):
            # terms without weight add nothing and are passed over
            at = starts[:-1][full]
            v = self.factor[flat]
            s = np.add.reduceat(v, at, axis=0)
            squares = np.add.reduceat(v * v, at, axis=0)
            out[full] += np.add.reduceat(self.weight[flat], at) + 0.5 * (s * s - squares).sum(1)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _ratio(a: np.ndarray, b: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """Likelihood ratio of presence against label; ``a`` toxic and ``b`` other documents have it."""
    c, d, n = toxic - a, clean - b, toxic + clean

    def part(x: np.ndarray, row: np.ndarray, col: float) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) * n / np.maximum(row * col, 1e-9)), 0.0)

    return 2 * (part(a, a + b, toxic) + part(b, a + b, clean) + part(c, c + d, toxic) + part(d, c + d, clean))


def telling_terms(flat: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which hashed terms the machine may weigh: alone, by the likelihood ratio of presence against label, or as part of
    a telling pair."""
    size = 1 << BITS
    of = np.repeat(y, np.diff(starts))
    a = np.bincount(flat, of, size)  # toxic documents with the term
    b = np.bincount(flat, minlength=size) - a
    ratio = _ratio(a, b, y.sum(), len(y) - y.sum())
    ratio[a + b < MIN_DOCS] = 0.0
    order = np.argsort(-ratio, kind="stable")
    out = np.zeros(size, bool)
    out[order[: max(LEAST_TERMS, int((ratio >= MIN_RATIO).sum()))]] = True
    out &= ratio > 0
    out[telling_pairs(flat, starts, y, a + b, ratio).ravel()] = True
    return out


def telling_pairs(flat: np.ndarray, starts: np.ndarray, y: np.ndarray, n_docs: np.ndarray, ratio: np.ndarray, block: int = 1000) -> np.ndarray:
    """Pairs of terms, one a row, whose presence together tells more than both do apart."""
    spread = np.minimum(n_docs, len(y) - n_docs)
    terms = np.sort(np.argsort(-spread, kind="stable")[:PAIR_TERMS])
    terms = terms[spread[terms] >= MIN_DOCS]
    place = np.full(1 << BITS, -1, np.int64)
    place[terms] = np.arange(len(terms))
    both, toxic = np.zeros((2, len(terms), len(terms)), np.float32)
    for i in range(0, len(y), block):
        j = min(len(y), i + block)
        col = place[flat[starts[i] : starts[j]]]
        row = np.repeat(np.arange(j - i), np.diff(starts[i : j + 1]))
        x = np.zeros((j - i, len(terms)), np.float32)
        x[row[col >= 0], col[col >= 0]] = 1
        both += x.T @ x
        x = x[y[i:j] > 0]
        toxic += x.T @ x
    found = []
    for k in range(len(terms)):
        a = toxic[k].astype(float)
        more = _ratio(a, both[k] - a, y.sum(), len(y) - y.sum()) - ratio[terms[k]] - ratio[terms]
        more[: k + 1] = 0.0
        found.append([(terms[k], terms[m]) for m in np.flatnonzero(more >= PAIR_RATIO)])
    return np.array([p for x in found for p in x], np.int64).reshape(-1, 2)


def train(flat: np.ndarray, starts: np.ndarray, y: np.ndarray, steps: int = 4000, rate: float = 0.2, decay: float = 1e-4, batch: int = 128) -> Machine:
    """Stochastic gradient descent with adaptive steps on the log loss."""
    rng = np.random.default_rng(11)
    size = 1 << BITS
    known = telling_terms(flat, starts, y) if len(y) else np.zeros(size, bool)
    w = np.zeros(size)
    v = np.where(known[:, None], rng.normal(0, FIRST, (size, FACTORS)), 0.0)
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Machine(float(np.log(p / (1 - p))), w.astype(np.float32), np.zeros_like(v, np.float32))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    kept = known[flat]
    starts = np.concatenate([[0], np.cumsum(kept)])[starts]
    flat = flat[kept]
    lengths = np.diff(starts)
    for _ in range(max(1, round(steps * batch / len(y)))):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            n = lengths[rows]
            doc = np.repeat(np.arange(len(rows)), n)
            at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids = flat[at]
            vi = v[ids]
            s = np.zeros((len(rows), FACTORS))
            np.add.at(s, doc, vi)
            squares = np.zeros(len(rows))
            np.add.at(squares, doc, (vi * vi).sum(1))
            raw = bias + np.bincount(doc, w[ids], len(rows)) + 0.5 * ((s * s).sum(1) - squares)
            g = (_sigmoid(raw) - y[rows]) / len(rows) * 16
            gb += (step := g.sum()) ** 2
            bias -= rate * step / np.sqrt(gb)
            used, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, g[doc], len(used)) + decay * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, place, g[doc][:, None] * (s[doc] - vi))
            dv += 10 * decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return Machine(bias, w.astype(np.float32), v.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """Learns from labelled documents whose fold is not 0, ``rows`` of them at most.

    Rows without a label or an id are left out; of labels that disagree the highest counts, and of texts that share an
    id the one with the smallest digest.
    """
    known = plain(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = plain(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")  # ``rows`` pairs of numbers at most
    one = texts.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(F.md5(text_of().cast("binary")), term_ids(text_of()).alias("terms")))["terms"].alias("terms"))
    got = one.toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(float)
    lists = got.column("terms").combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return train(flat, ends, (y > 0).astype(float))


def _scores(model: Machine) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)
            score = np.empty(batch.num_rows)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
                score[i:j] = _sigmoid(model.raw(flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i]))
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, score of every row. Null and empty texts get the score of no terms; repeated rows are
    scored each; an empty table gives none."""
    given = plain(docs, "doc_id", "text").select("doc_id", term_ids(text_of()).alias("terms"))
    return small_batches(given).mapInArrow(_scores(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
