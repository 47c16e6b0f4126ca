import zlib

import numpy as np
from tokenizers import Tokenizer

from partlens.llm.packing import Limits, Words, op6_packing, pack, public_vocabulary

SCHEMA = "doc_id long, text string, extra int"


def expected_ids(text):
    t = Tokenizer.from_file(public_vocabulary())
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def rows():
    rng = np.random.default_rng(5)
    words = ["Thandere", "é̂tre", "don't", "42", "<|endoftext|>", " x", "ΑΣ", "..."]
    out = [(i, " ".join(rng.choice(words, rng.integers(1, 400))), i) for i in range(60)]
    return [*out, (100, None, 0), (101, "", 0), (102, " \n", 0), (103, "wordword " * 9000, 0), (None, "null id", 0), (7, "same id", 0), (7, "same id", 0)]


def test_round_trip(spark):
    data = rows()
    got = op6_packing(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    texts = {}
    for i, t, _ in data:
        texts.setdefault(i, []).append(expected_ids(t))
    used = {}
    for r in got:
        ids = [x for x in texts[r.doc_id] if len(x) == r.doc_tokens][0]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        used[(r.doc_id, r.doc_tokens)] = used.get((r.doc_id, r.doc_tokens), 0) + r.length
    for (i, n), total in used.items():
        assert total == n * sum(len(x) == n for x in texts[i])
    assert sum(len(x) for v in texts.values() for x in v) == sum(r.length for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_limits(spark):
    df = spark.createDataFrame([(i, "a b c d e f", 3) for i in range(50)], SCHEMA).coalesce(1)
    limits = Limits(tokens=64, segments=4, loss_tokens=16, window=4)
    got = pack(df, public_vocabulary(), limits=limits, loss_from="extra").collect()
    assert sum(r.n_tokens for r in got) == 50 * 7
    assert all(len(r.segments) <= 4 and r.loss_tokens <= 16 and r.n_tokens <= 64 for r in got)


def test_empty(spark):
    assert op6_packing(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_by_words_are_the_tokenizers():
    words = Words(public_vocabulary(), 2, 50)
    texts = [
        "'s don't I'LL x'd", " leading and trailing ", "", "\u00a0nb\u00a0sp", "İstanbul ΑΣ Å K ǅ ß ẞ ſ", "<|endoftext|>a <|startoftext|>",
        "a_b-c...d 12ab34 ~!@#$%^&*()", "ª º µ × ÷ À Ö Ø Þ þ ÿ \u00ad", "e\u0301 n\u0303", "½ ²³ ¹ 日本語 x", "The the, THE. the", "a\x0bb\x1cc\x85d",
    ]
    import pyarrow as pa

    for _ in range(2):
        ids, bounds, prompt = words.encode(pa.array(texts), np.array([k % 3 for k in range(len(texts))]))
        assert [p for k, p in enumerate(prompt) if k % 3 == 0] == [0] * len(prompt[::3])
        assert prompt[1] == len(expected_ids("leading")) - 1 and prompt[2] == 0
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == expected_ids(t), t


def padding_of(sequences):
    return sum(0 if n & (n - 1) == 0 else 4096 - n for n in sequences)


def test_short_documents_leave_no_padding():
    import time

    from partlens.llm.packing import Packer

    for size, n in ((3, 90_000), (6, 20_000), (12, 20_000), (20, 20_000)):
        began = time.perf_counter()
        packer, ids = Packer(Limits(loss_tokens=3840)), np.zeros(size, np.uint32)
        got = [s for i in range(n) for s in packer.add(i, ids, i % 2)] + list(packer.finish())
        assert sum(x[3] for s in got for x in s) == size * n
        assert padding_of(sum(x[3] for x in s) for s in got) == 0
        assert all(len(s) <= 256 and sum(packer._loss(x) for x in s) <= 3840 for s in got)
        assert time.perf_counter() - began < 30


def test_derived_limits_hold_and_fill_every_sequence():
    from partlens.llm.packing import LOSS_MARGIN, Packer

    limits_of = []

    class Seen(Limits):
        def of(self, *held):
            limits_of.append(super().of(*held))
            return limits_of[-1]

    rng = np.random.default_rng(8)
    longer = [(int(n), int(n * rng.random())) for n in rng.integers(1, 3000, 1500)] + [(60_000, 0), (60_000, 60_000), (70_000, 30_000)]
    mixed = longer[:400] + [(int(n), int(n // 8)) for n in rng.integers(1, 12, 30_000)]
    for examples in (longer, mixed, [(n, 0) for n, _ in longer], [(n, n) for n, _ in longer], [(3, 1)] * 20_000):
        rng.shuffle(examples)
        packer = Packer(Seen(segments=None, loss_tokens=None))
        got = [(s, limits_of[-1]) for i, (n, k) in enumerate(examples) for s in packer.add(i, np.zeros(n, np.uint32), int(k))]
        got += [(s, limits_of[-1]) for s in packer.finish()]
        tokens, loss = [sum(x[3] for x in s) for s, _ in got], [sum(packer._loss(x) for x in s) for s, _ in got]
        assert sum(tokens) == sum(n for n, _ in examples) and sum(loss) == sum(n - k for n, k in examples)
        assert all(len(s) <= most and x <= most_loss for (s, (_, most, most_loss)), x in zip(got, loss, strict=True))
        assert padding_of(tokens) == 0 and sum(n < 4096 for n in tokens) <= 12  # the last sequence, in powers of two
    assert Limits(segments=None, loss_tokens=None).of(8192, 4, 4096) == (4096, 5, 2048 + int(4096 * LOSS_MARGIN))


def test_every_limit_binds_and_prompts_fill_up():
    from partlens.llm.packing import Packer

    rng = np.random.default_rng(3)
    packer = Packer(Limits(tokens=256, segments=6, loss_tokens=192, window=16))
    examples = [(int(n), int(rng.integers(0, n // 2 + 1))) for n in rng.integers(1, 700, 300)] + [(2, 0)] * 200
    got = [s for i, (n, k) in enumerate(examples) for s in packer.add(i, np.zeros(n, np.uint32), k)] + list(packer.finish())
    places = {}
    for s in got:
        for doc, _, start, length, _ in s:
            places.setdefault(doc, []).append((start, length))
    for i, (n, _) in enumerate(examples):
        at = 0
        for start, length in sorted(places[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    tokens, loss = [sum(x[3] for x in s) for s in got], [sum(packer._loss(x) for x in s) for s in got]
    assert max(len(s) for s in got) == 6 and max(loss) == 192 and max(tokens) == 256
    assert sum(n == 256 for n in tokens) > 0.5 * sum(tokens) / 256  # prompts are spread, so that most sequences are full


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two\nthree four", 9, 8, "x")], "doc_id long, text string, loss_from int, sequence_id int, prompt_words string")
    got = op6_packing(df).collect()
    assert sum(r.length for r in got) == len(expected_ids("one two\nthree four")) and {r.doc_id for r in got} == {1}
    one = pack(df, public_vocabulary(), prompt=__import__("pyspark.sql.functions", fromlist=["x"]).lit("one two")).collect()
    assert sum(r.loss_tokens for r in one) == len(expected_ids("three four"))


def test_words_of_many_parts_are_not_remembered_whole():
    import pyarrow as pa

    words = Words(public_vocabulary(), 2)
    rng = np.random.default_rng(4)
    parts = ["word", "Éa", "42", "-", "x", "ÿ", "&", "7"]
    texts = [" ".join("".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(200)) for _ in range(20)]
    texts += ["", " ", "İa ẞb K× don't <|x|> ab<|", "\u00d7\u00f7 \u00aa1", "9" * 50]
    ids, bounds, _ = words.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == expected_ids(t), t
    assert len(words.words.at) < 20 and len(words.runs.at) > 20  # runs are, and words that are not plain
    assert words.encode(pa.array([], pa.string()))[0].tolist() == []
