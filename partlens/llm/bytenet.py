"""Quality by a small convolutional network over bytes.

The UTF-8 bytes of the whole text are cut into overlapping chunks of ``CHUNK`` windows, half a chunk apart, the last one at
the text's end. Learned filters, each ``WIDTH`` bytes wide, respond at every byte; a chunk keeps each filter's highest
response (max pooling), and a hidden layer turns those to evidence. The mean evidence of all chunks gives one probability.

The network is trained on the driver, in numpy, on a sample of labelled documents, ``TRAIN_ROWS`` at most, and of each the
same number of evenly spread chunks, ``TRAIN_CHUNKS`` at most, cut on the executors; so the sample's bytes are bounded whatever the
texts' lengths. Scoring is one pass over all documents. There a filter is a sum of table lookups: embedding and weights are
multiplied out for pairs of neighbouring bytes once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, text_of
from .toxicity import fold_of

WIDTH = 6  #: bytes a filter sees; even, as tables hold pairs
EMBEDDING, FILTERS, HIDDEN = 8, 32, 16
PIECE = 16  #: windows that are pooled first
PIECES = 8  #: pieces in a chunk
CHUNK = PIECE * PIECES
STRETCH = 1 << 20  #: bytes worked on at once; longer texts are cut to such stretches, a chunk's length of overlap between them
#: Bounds of the training sample: labelled documents, and chunks of each, that are sent to the driver at most.
TRAIN_ROWS, TRAIN_CHUNKS = 8000, 16
STEPS, BATCH, RATE, DECAY = 600, 64, 3e-3, 1e-4
THRESHOLD = 0.3


@dataclass
class Net:
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: np.ndarray  # (WIDTH, EMBEDDING, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    hidden_bias: np.ndarray  # (HIDDEN,)
    last: np.ndarray  # (HIDDEN,)
    last_bias: np.ndarray  # (1,)

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.hidden, self.hidden_bias, self.last, self.last_bias]

    def tables(self) -> np.ndarray:
        """Response of each filter to each byte at each place of its window."""
        return np.einsum("be,jef->jbf", self.embedding, self.filters)

    def evidence(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.hidden + self.hidden_bias, 0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        raw = evidence @ self.last + self.last_bias[0]
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def first_net(rng: np.random.Generator) -> Net:
    spread = lambda *shape: rng.normal(0, np.sqrt(2 / np.prod(shape[:-1])), shape)
    return Net(rng.normal(0, 1, (256, EMBEDDING)), spread(WIDTH, EMBEDDING, FILTERS), np.zeros(FILTERS), spread(FILTERS, HIDDEN), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1))


def chunk_starts(length: int) -> np.ndarray:
    """Where the chunks of so many bytes start: each half a chunk, and the last one at the end."""
    last = max(0, -(-length // PIECE) - PIECES)
    starts = np.arange(0, last + 1, PIECES // 2)
    return (starts if starts[-1] == last else np.append(starts, last)) * PIECE


def train_step(net: Net, windows: np.ndarray, sizes: np.ndarray, doc: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the log loss. ``windows`` are chunks of CHUNK + WIDTH - 1 bytes, ``sizes`` the bytes of them that belong to
    the text and ``doc`` their documents, numbered from 0 in order."""
    tables = net.tables().astype(np.float32)
    response = tables[0][windows[:, :CHUNK]]
    for j in range(1, WIDTH):
        response += tables[j][windows[:, j : j + CHUNK]]
    response += net.bias.astype(np.float32)
    response[np.arange(CHUNK) >= np.maximum(sizes, 1)[:, None]] = -1
    response = response.transpose(0, 2, 1)
    at = np.ascontiguousarray(response).argmax(2)
    pooled = np.maximum(np.take_along_axis(response, at[:, :, None], 2)[:, :, 0], 0).astype(float)
    evidence = net.evidence(pooled)
    per_doc = np.bincount(doc, minlength=len(y))
    mean = np.stack([np.bincount(doc, c, len(y)) for c in evidence.T], 1) / per_doc[:, None]
    off = (net.probability(mean) - y) / len(y)
    d_evidence = (np.outer(off / per_doc, net.last)[doc]) * (evidence > 0)
    d_pooled = (d_evidence @ net.hidden.T) * (pooled > 0)
    d_tables = np.zeros((WIDTH, 256, FILTERS))
    for j in range(WIDTH):
        byte = np.take_along_axis(windows, at + j, 1).astype(np.int64)
        d_tables[j] = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), d_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [
        np.einsum("jbf,jef->be", d_tables, net.filters), np.einsum("be,jbf->jef", net.embedding, d_tables), d_pooled.sum(0), pooled.T @ d_evidence, d_evidence.sum(0), mean.T @ off,
        np.array([off.sum()]),
    ]


def train(chunks: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Net:
    """Adam on the log loss; ``chunks`` and ``sizes`` by document."""
    rng = np.random.default_rng(seed)
    net = first_net(rng)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        net.last[:] = 0
        net.last_bias[:] = np.log(p / (1 - p))
        return net
    net.last_bias[:] = np.log(y.mean() / (1 - y.mean()))
    given = net.arrays()
    first, second = [np.zeros_like(a) for a in given], [np.zeros_like(a) for a in given]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(y)):
            order = np.concatenate([order, rng.permutation(len(y))])
        rows, order = order[:BATCH], order[BATCH:]
        doc = np.repeat(np.arange(len(rows)), [len(sizes[i]) for i in rows])
        slopes = train_step(net, np.concatenate([chunks[i] for i in rows]), np.concatenate([sizes[i] for i in rows]), doc, y[rows])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, m, v in zip(given, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * a)
    seen = np.zeros(256, bool)
    for c in chunks:
        seen[c.ravel()] = True
    net.embedding[~seen] = 0.0  # bytes that were never seen say nothing
    return net


def _cut(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Evenly spread chunks of each text, as one string of bytes, and the bytes of each that belong to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for text in batch.column("text"):
                raw = text.as_buffer() or b""
                starts = chunk_starts(len(raw))
                starts = starts[np.unique(np.linspace(0, len(starts) - 1, min(most, len(starts))).round().astype(int))]
                data = np.frombuffer(raw, np.uint8) if len(raw) else np.zeros(0, np.uint8)
                some = [data[s : s + CHUNK + WIDTH - 1] for s in starts.tolist()]
                out.append(b"".join(c.tobytes().ljust(CHUNK + WIDTH - 1, b"\0") for c in some))
                sizes.append([max(0, min(CHUNK, len(data) - s)) for s in starts.tolist()])
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], names=[*names, "chunks", "sizes"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, most: int = TRAIN_CHUNKS) -> Net:
    """Learns from labelled documents whose fold is not 0, ``rows`` of them at most, chosen by a hash of the id.

    Rows without a label or an id are left out; of labels that disagree the highest counts, and of texts that share an id the
    one with the smallest digest.
    """
    known = plain(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = plain(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")  # ``rows`` pairs of numbers at most
    texts = texts.select("doc_id", F.col("y").cast("double"), F.md5(text_of().cast("binary")).alias("mark"), text_of().cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = texts.mapInArrow(_cut(most), f"doc_id {kind}, y double, mark string, chunks binary, sizes array<int>")
    one = cut.groupBy("doc_id").agg(F.min(F.struct("mark", "y", "chunks", "sizes")).alias("r")).select("doc_id", "r.y", "r.chunks", "r.sizes")
    got = one.toArrow().sort_by("doc_id")
    y = (got.column("y").to_numpy() > 0).astype(float)
    chunks = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK + WIDTH - 1) for c in got.column("chunks").to_pylist()]
    return train(chunks, [np.array(s) for s in got.column("sizes").to_pylist()], y)


class Scorer:
    """Scores texts with tables of byte pairs."""

    def __init__(self, net: Net):
        self.net = net
        t = net.tables()
        self.pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(1 << 16, FILTERS).astype(np.float32) for j in range(0, WIDTH, 2)]
        self.bias = net.bias.astype(np.float32)

    def pooled(self, stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pooled responses of all chunks, and the number of chunks of each stretch."""
        sizes = np.array([len(s) for s in stretches])
        pieces = np.maximum(1, -(-sizes // PIECE))
        room = pieces + 1  # a piece of zeros after each, so that windows end in zeros
        at = np.concatenate([[0], np.cumsum(room)])
        data = np.zeros(at[-1] * PIECE, np.uint8)
        for a, s in zip((at * PIECE).tolist(), stretches):
            data[a : a + len(s)] = s
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        n = at[-1] * PIECE - WIDTH + 1
        best = np.empty((at[-1], FILTERS), np.float32)
        for i in range(0, at[-1], 512):
            a, b = i * PIECE, min(n, (i + 512) * PIECE)
            response = self.pairs[0].take(pair[a:b], 0)
            for j in range(1, WIDTH // 2):
                response += self.pairs[j].take(pair[a + 2 * j : b + 2 * j], 0)
            whole = (b - a) // PIECE
            best[i : i + whole] = response[: whole * PIECE].reshape(whole, PIECE, FILTERS).max(1)
            if whole * PIECE < b - a:
                best[i + whole] = response[whole * PIECE :].max(0)
        # the last piece of a stretch counts windows that start inside it only
        for k in np.flatnonzero(sizes % PIECE != 0).tolist():
            p = at[k] + pieces[k] - 1
            a = p * PIECE
            some = pair[a : a + int(sizes[k] % PIECE) + WIDTH - 2]
            m = len(some) - WIDTH + 2
            best[p] = sum(self.pairs[j].take(some[2 * j : 2 * j + m], 0) for j in range(WIDTH // 2)).max(0)
        best = np.maximum(best + self.bias, 0)
        starts = [chunk_starts(int(s)) // PIECE for s in sizes]
        counts = np.array([len(s) for s in starts])
        first = np.concatenate(starts) + np.repeat(at[:-1], counts)
        ends = np.minimum(first + PIECES, np.repeat(at[:-1] + pieces, counts))
        return np.maximum.reduceat(best, np.stack([first, ends], 1).ravel(), 0)[::2], counts

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        total, chunks = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts))
        held: list[np.ndarray] = []
        of: list[int] = []

        def work() -> None:
            pooled, counts = self.pooled(held)
            doc = np.repeat(of, counts)
            evidence = self.net.evidence(pooled)
            for c in range(HIDDEN):
                total[:, c] += np.bincount(doc, evidence[:, c], len(texts))
            chunks[:] += np.bincount(doc, minlength=len(texts))
            held.clear(), of.clear()

        size = 0
        for i, text in enumerate(texts):
            for a in range(0, max(1, len(text)), STRETCH):
                held.append(text[a : a + STRETCH + CHUNK])
                of.append(i)
                size += len(held[-1]) + 2 * PIECE
                if size >= STRETCH:
                    work()
                    size = 0
        if held:
            work()
        return self.net.probability(total / np.maximum(chunks, 1)[:, None])


def _scores(net: Net) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            texts = [np.frombuffer(t.as_buffer() or b"", np.uint8) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(texts))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score of every row. Null and empty texts get the score of one chunk of zeros; repeated rows are scored each; an
    empty table gives none."""
    given = plain(docs, "doc_id", "text").select("doc_id", text_of().cast("binary").alias("text"))
    return given.mapInArrow(_scores(net), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op12_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ``fit`` and ``score`` for odd rows. A null id is not held out."""
    out = score(docs, fit(docs, labels))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
