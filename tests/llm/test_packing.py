import random
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from quarry.llm import packing, tokens

from .brute import best_fit_rooms, documents


def test_plan_equals_one_by_one_best_fit():
    for seed in range(120):
        rng = random.Random(seed)
        capacity = rng.choice([5, 16, 37, 64])
        lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(0, 90))]
        histogram = {n: lengths.count(n) for n in lengths}
        runs, rooms = sorted(packing.plan_runs(histogram, capacity)), {}
        for k, (n, first, sequence, offset) in enumerate(runs):
            end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else histogram[n]
            for rank in range(first, end):
                rooms.setdefault(sequence + rank - first, []).append((offset, n))
        left = []
        for placed in rooms.values():
            at = 0
            for offset, n in sorted(placed):
                assert offset == at
                at += n
            left.append(capacity - at)
        assert sorted(left) == best_fit_rooms(lengths, capacity)


def test_tightest_room():
    tree = packing.CapacityTree(20)
    assert tree.tightest(1) is None
    for room in (3, 9, 20):
        tree.set(room, True)
    assert [tree.tightest(n) for n in (0, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]


def test_ids_are_the_tokenizers():
    whole = Tokenizer.from_file(tokens.default_path())
    whole.encode_special_tokens = True
    rng, encoder = random.Random(1), tokens.encoder(tokens.default_path())
    pool = "abcZé ß²½ \n\t\r\x0b\x1c\x1f\x85\xa0 _'sdl'llve1९٣中文Ж!?.,<|endoftext|>\u0301🙂"
    for k in range(800):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        text = "".join(c for c in text if ord(c) < 0x250) if k % 2 else text
        packed = encoder.ids(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == whole.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_the_tokenizers():
    """With the tokenizer in its default setting."""
    whole = Tokenizer.from_file(tokens.default_path())
    rng, encoder = random.Random(3), tokens.encoder(tokens.default_path())
    pool = ["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "a", "word", " it's", "é", "٣", "🙂", "9"]
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>"]
    for text in texts + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(400)]:
        packed = encoder.ids(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == whole.encode(text, add_special_tokens=False).ids


def test_pack_documents(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 1, 5, 30, 30, 200])))) for i in range(60)]
    texts += [(60, None), (61, ""), (None, "no id"), (7, texts[7][1]), (62, "long " * 3000)]
    rows = packing.pack_documents(documents(spark, texts), tokens.default_path(), capacity=64).collect()
    whole = Tokenizer.from_file(tokens.default_path())
    want = []
    for i, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == order(want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in held.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 64
    assert len(held) == len(best_fit_rooms([n for *_, n, _ in want], 64))


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), tokens.default_path()).collect() == []


@pytest.mark.parametrize("length,capacity", [(3, 10), (10, 10), (1, 4)])
def test_equal_lengths(length, capacity):
    runs = sorted(packing.plan_runs({length: 7}, capacity))
    last = max(sequence + (runs + [(0, 7)])[k + 1][1] - first - 1 for k, (_, first, sequence, _) in enumerate(runs))
    assert last + 1 == -(-7 // (capacity // length))
