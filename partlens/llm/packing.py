"""Packing of tokenized examples into sequences by vector bin packing.

Every piece has three sizes: tokens, segments (one) and loss-bearing tokens. A sequence is filled by the
dot-product heuristic: of the pieces that still fit under all three limits, the one whose size vector
has the largest dot product with the room that is left goes in. When none fits, a piece is cut to fill
the tokens that remain.

A limit that is not given is derived from the pieces at hand, anew for each sequence: their mean share of
loss-bearing tokens and a margin above it, and twice the segments that a sequence of pieces of their mean
size has. So every sequence is a mix as the pieces are, and the pieces at hand can always fill it.

Packing needs no shuffle: each task packs its own rows through a window of bounded size, and what is
left at the end of a window waits for the next one. A sequence that cannot be filled, as it has all the
segments or loss-bearing tokens it may hold or is the last of its task, is cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_batches, text_of

SEGMENT = "struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint,doc_tokens:bigint>"
SCHEMA = f"sequence_id long, n_tokens long, padded_to long, loss_tokens long, input_ids binary, segments array<{SEGMENT}>"

#: A derived limit of loss-bearing tokens lies this share of a sequence above the mean of the pieces at hand.
LOSS_MARGIN = 1 / 64
#: A derived limit of segments is this many times the mean of the pieces at hand.
SEGMENT_SPREAD = 2


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. ``window`` sequences' worth of pieces are packed at once.

    A limit of loss-bearing tokens below that of tokens keeps every sequence from being all answers or all prompts,
    as far as the window's pieces allow. Where ``segments`` or ``loss_tokens`` is None, each sequence's limit is
    derived from the pieces at hand.
    """

    tokens: int = 4096
    segments: int | None = 256
    loss_tokens: int | None = 4096
    window: int = 64

    def of(self, held: int, pieces: int, loss: int) -> tuple[int, int, int]:
        """The next sequence's limits: of ``held`` tokens in so many pieces at hand, ``loss`` bear loss."""
        segments, most_loss = self.segments, self.loss_tokens
        if segments is None:
            segments = 1 + -(-SEGMENT_SPREAD * self.tokens * pieces // held)
        if most_loss is None:
            most_loss = min(self.tokens, -(-self.tokens * loss // held) + int(self.tokens * LOSS_MARGIN))
        return self.tokens, segments, most_loss


#: Both limits from the pieces at hand, as ``op6_packing`` packs.
DERIVED = Limits(segments=None, loss_tokens=None)


class _Memory:
    """Ids of strings that were seen: number i has ``ids[begin[i]:begin[i + 1]]``. Starts afresh beyond ``most``."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros((1 << 14) + 1, np.int64)

    def make_room(self, strings: list[str]) -> list[str]:
        """Those that are new; forgets all if they would be too many."""
        if len(self.at) + len(strings) > self.most:
            self.clear()
        at = self.at
        return [x for x in strings if x not in at]

    def add(self, strings: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = len(self.at), int(self.begin[len(self.at)])
        ends = used + np.cumsum(counts)
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.begin) < n + len(strings) + 1:
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.ids[used : used + len(ids)] = ids
        self.begin[n + 1 : n + 1 + len(strings)] = ends
        self.at.update(zip(strings, range(n, n + len(strings)), strict=True))

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, strings), np.int64, len(strings))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbers, one after the other, and how many each has."""
        begin = self.begin[which]
        counts = self.begin[which + 1] - begin
        return _stretches(self.ids, begin, counts), counts


def _stretches(ids: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``ids[begin[i]:begin[i] + counts[i]]`` of all i, one after the other."""
    ends = np.cumsum(counts)
    take = np.repeat(begin - ends + counts, counts)
    take += np.arange(len(take))
    return ids[take]


#: Kinds of bytes of plain words in lower case; all that are not ASCII belong to letters.
LETTER, DIGIT = 1, 2
KINDS = np.array([LETTER if 97 <= k <= 122 or k >= 128 else DIGIT if 48 <= k <= 57 else 0 for k in range(256)], np.uint8)


class Words:
    """Token ids of texts, by words. The vocabulary's pre-tokenizer never crosses white space, so a text's ids
    are its words' ids one after the other, and each distinct word of the texts at hand is encoded once.

    The vocabulary lower-cases and cuts a word into runs of letters, single digits and runs of the rest. A
    word of ASCII characters and Latin-1 letters without an apostrophe is cut here, all words at once by the kinds of
    their bytes, and its runs are remembered, so that ``the`` and ``The,`` share one; other words are encoded and
    remembered whole.
    """

    PLAIN = r"^[!-&(-~À-ÖØ-öø-ÿ]+$"
    def __init__(self, path: str, end_id: int, most: int = 450_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.runs_only = Tokenizer.from_file(path)
        self.runs_only.normalizer = normalizers.Sequence([])
        self.runs_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end_id = end_id
        self.runs, self.words = _Memory(most), _Memory(most)

    def _learn_runs(self, runs: list[str]) -> None:
        new = self.runs.make_room(runs)
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            got = self.runs_only.encode(" ".join(part), add_special_tokens=False)
            self.runs.add(part, np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))

    def _learn(self, words: list[str]) -> None:
        got = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        self.words.add(words, np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64))

    def _cut(self, low: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The runs of plain words in lower case, one after the other, and where each word's runs begin and end."""
        if not len(low):
            return low, np.zeros(1, np.int64)
        ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
        kind = KINDS[np.frombuffer(low.buffers()[2], np.uint8)[: ends[-1]]]
        first = np.ones(len(kind), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        first[ends[:-1]] = True
        starts = np.flatnonzero(first)
        runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, ends[-1])), low.buffers()[2])
        return runs, np.searchsorted(starts, ends)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words one after the other, and how many each has."""
        runs, at = self._cut(pc.utf8_lower(words))
        coded = runs.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn_runs(distinct)
        ids, counts = self.runs.gather(self.runs.numbers(distinct)[coded.indices.to_numpy()])
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[at])

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of other words; an empty one has none."""
        if new := self.words.make_room(words):
            self._learn(new)
        return self.words.gather(self.words.numbers(words))

    def encode(self, texts: pa.Array, leading: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, the end id after each; where each text's ids begin and end; and how
        many ids its first ``leading`` words have."""
        words = pc.split_pattern_regex(texts.cast(pa.large_string()), r"[\x20\x09-\x0D]+")
        starts = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary
        plain = pc.and_(pc.match_substring_regex(distinct, self.PLAIN), pc.invert(pc.match_substring(distinct, "<|")))
        other = pc.invert(plain)
        (some, n_some), (rest, n_rest) = self._plain(distinct.filter(plain)), self._whole(distinct.filter(other).to_pylist())
        # the distinct words' ids, and the end of a text as the last of them
        table, sizes = np.concatenate([some, rest, np.array([self.end_id], np.uint32)]), np.concatenate([n_some, n_rest, [1]])
        order = np.concatenate([np.flatnonzero(plain.to_numpy(zero_copy_only=False)), np.flatnonzero(other.to_numpy(zero_copy_only=False)), [len(distinct)]])
        begin_of, size_of = np.zeros((2, len(order)), np.int64)
        begin_of[order], size_of[order] = np.cumsum(sizes) - sizes, sizes
        which = coded.indices.to_numpy().astype(np.int64)
        blank = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
        if blank >= 0:
            which[which == blank] = -1  # blanks at an edge of a text give an empty word
        # each text's words, and the end after them
        n = np.diff(starts)
        every = np.full(len(which) + len(n), len(distinct), np.int64)
        inside = np.ones(len(every), bool)
        inside[np.cumsum(n + 1) - 1] = False
        every[inside] = which
        ends = np.cumsum(n + 1)
        keep = every >= 0
        if not keep.all():
            ends = np.cumsum(keep)[ends - 1]
            every = every[keep]
        counts = size_of[every]
        ids = _stretches(table, begin_of[every], counts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        begin = np.concatenate([[0], ends[:-1]])
        first = np.minimum(begin + (0 if leading is None else leading), ends - 1)
        return ids, upto[np.concatenate([[0], ends])], upto[first] - upto[begin]


_words: dict[tuple[str, int], Words] = {}  # a Python worker serves many tasks


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, most_chars: int = 2_000_000) -> Iterator[tuple]:
    """(doc_id, ids, position where the loss begins) of each row, ``most_chars`` bytes of text (or one row) at once."""
    words = _words.get((vocabulary, end_id)) or _words.setdefault((vocabulary, end_id), Words(vocabulary, end_id))
    for batch in batches:
        size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + most_chars, "right")) - 1)
            part = batch.slice(i, j - i)
            ids, bounds, prompt = words.encode(part.column("text"), part.column("prompt_words").to_numpy())
            loss = np.maximum(part.column("loss_from").to_numpy(), prompt).tolist()
            for k, doc in enumerate(part.column("doc_id").to_pylist()):
                yield doc, ids[bounds[k] : bounds[k + 1]], loss[k]
            i = j


class Packer:
    """Packs pieces (document, ids, start, length) as they come; ``take`` returns finished sequences."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.items: list[tuple] = []  # (doc_id, ids, start, length, loss_from)
        self.held = 0

    def _loss(self, item: tuple) -> int:
        _, _, start, length, loss_from = item
        return max(0, start + length - max(start, loss_from))

    def add(self, doc, ids: np.ndarray, loss_from: int) -> Iterator[list[tuple]]:
        """Takes an example; yields sequences as soon as a window is full. Whole sequences of one long
        example go out at once where loss-bearing tokens are not limited."""
        most, start = self.limits.tokens, 0
        unlimited = (self.limits.loss_tokens or 0) >= most  # else its loss may be too much for one sequence
        while unlimited and len(ids) - start >= most:
            yield [(doc, ids, start, most, loss_from)]
            start += most
        if start < len(ids):
            self.items.append((doc, ids, start, len(ids) - start, loss_from))
            self.held += len(ids) - start
        if self.held >= self.limits.window * self.limits.tokens:
            yield from self._drain(self.limits.tokens * 4)

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._drain(0)

    def _drain(self, rest: int) -> Iterator[list[tuple]]:
        """Sequences until at most ``rest`` tokens are held; one that cannot be filled is cut at powers of two."""
        pool = _Pool(self.items, [self._loss(x) for x in self.items])
        loss = sum(map(self._loss, self.items))
        while self.held > rest and self.held > 0:
            most = np.array(self.limits.of(self.held, pool.pieces_left, loss), np.float64)
            room = most.astype(np.int64)
            got: list[tuple] = []
            while room[0] > 0 and room[1] > 0:
                score = pool.scores(room / np.maximum(most, 1) ** 2)
                fits = (pool.size <= room[0]) & (pool.loss <= room[2])
                # the last segment takes all the room, if a piece can
                k = pool.best(score, fits & (pool.size == room[0])) if room[1] == 1 else None
                if k is None and not (room[1] == 1 and bool((pool.there & self._fills(pool, room)).any())):
                    k = pool.best(score, fits)
                if k is not None:
                    item = pool.take(k)
                    room -= (pool.size[k], 1, pool.loss[k])
                    got.append(item)
                    continue
                able = (pool.size > pool.loss) | (room[2] > 0)
                k = pool.best(score, self._fills(pool, room)) if room[1] == 1 else None
                if k is None:
                    k = pool.best(score, able)
                if k is None:
                    break
                # none fits whole: cut the best piece to the tokens and loss-bearing tokens that remain
                doc, ids, start, length, loss_from = pool.take(k)
                n = int(min(length, room[0], max(0, loss_from - start) + room[2]))
                piece = (doc, ids, start, n, loss_from)
                got.append(piece)
                room -= (n, 1, self._loss(piece))
                left = (doc, ids, start + n, length - n, loss_from)
                if length > n:
                    pool.put(left, self._loss(left))
            n = int(self.limits.tokens - room[0])
            self.held -= n
            loss -= int(most[2]) - int(room[2])
            yield from [got] if n == self.limits.tokens else _powers(got)
        self.items = pool.left()

    @staticmethod
    def _fills(pool: _Pool, room: np.ndarray) -> np.ndarray:
        """Which pieces, cut, fill the tokens that remain: prompts come first, so a piece bears the least loss where cut so."""
        return (pool.size >= room[0]) & (room[0] - (pool.size - pool.loss) <= room[2])


class _Pool:
    """Pieces by their sizes: pieces with as many tokens and loss-bearing tokens are alike, so the choice looks at each
    pair of sizes once, however many pieces there are."""

    def __init__(self, items: list[tuple], loss: list[int]):
        self.at: dict[tuple[int, int], int] = {}
        self.pieces: list[list[tuple]] = []
        self.pieces_left = len(items)
        self._sizes, self._there = np.zeros((2, 64), np.int64), np.zeros(64, bool)
        self._views()
        for item, x in zip(items, loss, strict=True):
            self.pieces[self._slot(item[3], x)].append(item)
        for alike in self.pieces:
            alike.reverse()  # the first to come is the first taken
        self.there[:] = True

    def _slot(self, size: int, loss: int) -> int:
        """The number of a pair of sizes, a new one if it has none."""
        k = self.at.setdefault((size, loss), len(self.pieces))
        if k == len(self.pieces):
            self.pieces.append([])
            if k == len(self._there):
                self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)], axis=1)
                self._there = np.concatenate([self._there, np.zeros_like(self._there)])
            self._sizes[:, k] = size, loss
            self._views()
        return k

    def _views(self) -> None:
        n = len(self.pieces)
        self.size, self.loss, self.there = self._sizes[0, :n], self._sizes[1, :n], self._there[:n]

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """Dot product of each pair's sizes, as shares of the limits, with the shares of room."""
        return self.size * weight[0] + weight[1] + self.loss * weight[2]

    def best(self, score: np.ndarray, fits: np.ndarray) -> int | None:
        able = self.there & fits
        k = int(np.argmax(np.where(able, score, -1.0))) if len(able) else 0
        return k if len(able) and able[k] else None

    def take(self, k: int) -> tuple:
        item = self.pieces[k].pop()
        self.pieces_left -= 1
        self.there[k] = len(self.pieces[k]) > 0
        return item

    def put(self, item: tuple, loss: int) -> None:
        k = self._slot(item[3], loss)
        self.pieces[k].append(item)
        self.pieces_left += 1
        self.there[k] = True

    def left(self) -> list[tuple]:
        return [x for alike in self.pieces for x in reversed(alike)]


def _powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """The pieces of a sequence that is not full, as sequences whose lengths are powers of two."""
    left = sum(x[3] for x in pieces)
    queue = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        got = []
        while room:
            doc, ids, start, length, loss_from = queue.pop()
            n = min(length, room)
            got.append((doc, ids, start, n, loss_from))
            room -= n
            if n < length:
                queue.append((doc, ids, start + n, length - n, loss_from))
        yield got


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("padded_to", pa.int64()), ("loss_tokens", pa.int64()), ("input_ids", pa.binary()),
        ("segments", pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "offset", "doc_tokens")]))),
    ])
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 33
    packer = Packer(limits)
    rows: list[tuple] = []

    def row(pieces: list[tuple]) -> tuple:
        n, segments = 0, []
        for doc, ids, start, length, _ in pieces:
            segments.append({"doc_id": doc, "start": start, "length": length, "offset": n, "doc_tokens": len(ids)})
            n += length
        padded = n if n & (n - 1) == 0 else limits.tokens
        data = b"".join(ids[s : s + k].astype("<u4").tobytes() for _, ids, s, k, _ in pieces)
        return n, padded, sum(packer._loss(x) for x in pieces), data, segments

    def out() -> pa.RecordBatch:
        nonlocal number
        first, number = number, number + len(rows)
        cols = [range(first, number), *zip(*rows, strict=True)]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        rows.clear()
        return batch

    for doc, ids, loss_from in _encoded(batches, vocabulary, end_id):
        for pieces in packer.add(doc, ids, loss_from):
            rows.append(row(pieces))
            if len(rows) >= 256:
                yield out()
    for pieces in packer.finish():
        rows.append(row(pieces))
    if rows:
        yield out()


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, limits: Limits = Limits(), loss_from: str | None = None, prompt: Column | None = None) -> DataFrame:
    """Sequences of at most ``limits.tokens`` tokens: one row each with its ids (little-endian unsigned
    32-bit) and its segments; ``padded_to`` is the length after padding.

    ``docs`` has doc_id and text; ``loss_from`` may name a column with the position from which a
    document's tokens bear loss, and ``prompt`` may give the part of the text, from its start, whose words bear none
    (null or none given: all tokens do). ``vocabulary``: path of the tokenizers file ``word_bpe_49k.json`` (see
    ``Words`` for what is known of it).

    Null or empty text: the document is its end id alone. Repeated rows are packed each, ties are broken by
    row order, a null doc_id stays null, long texts are cut, other columns are ignored; an empty table
    gives no sequences.
    """
    start = F.coalesce(F.col(f"`{loss_from}`").cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")
    words = F.lit(0).cast("long") if prompt is None else F.coalesce(F.regexp_count(prompt, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    given = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), start.alias("loss_from"), words.alias("prompt_words"))
    return small_batches(given).mapInArrow(lambda batches: _packed(batches, vocabulary, end_id, limits), SCHEMA)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(docs: DataFrame) -> DataFrame:
    """One row a piece: where its ids stand in its document and in its sequence, and their checksum."""
    piece = F.transform("segments", lambda s: F.struct(
        s["doc_id"].alias("doc_id"), s["start"].alias("start"), s["length"].alias("length"),
        F.crc32(_bytes(s)).alias("ids_crc32"),
        s["doc_tokens"].alias("doc_tokens"), s["offset"].alias("offset"),
    ))
    # a document is read as an instruction, its first line, and an answer, the lines after it, which bear the loss
    instruction = F.when(F.contains("text", F.lit("\n")), F.substring_index("text", "\n", 1))
    out = pack(docs, public_vocabulary(), limits=DERIVED, prompt=instruction).select("sequence_id", F.explode(piece).alias("p"))
    return out.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def _bytes(s):
    return F.substring("input_ids", (s["offset"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int"))
