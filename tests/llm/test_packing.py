import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locusgrid.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(counts, capacity):
    """The sequences of a plan, checked on the way."""
    bins, seen = defaultdict(list), defaultdict(int)
    for length, first, count, sequence, each, offset in P.plan(dict(counts), capacity):
        assert first == seen[length]
        seen[length] += count
        for k in range(count):
            bins[sequence + k // each].append((offset + k % each * length, length))
    assert dict(seen) == {k: v for k, v in counts.items() if v}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in own) <= 2
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 64), st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=12))
def test_plan_places_every_piece_without_gaps(capacity, counts):
    counts = {k: v for k, v in counts.items() if k <= capacity}
    used = placed(counts, capacity)
    total = sum(k * v for k, v in counts.items())
    assert used * capacity >= total
    assert used <= 2 * -(-total // capacity) + 1


def test_plan_is_close_to_the_least():
    counts = {n: random.Random(n).randint(1, 40) for n in range(1, 2049)}
    assert placed(counts, 2048) <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 2048)


def test_runs_do_not_grow_with_the_corpus():
    counts = {n: random.Random(n).randint(1, 40) for n in range(1, 2049)}
    many = {n: c * 100_003 for n, c in counts.items()}
    assert len(P.plan(many)) < 8000


TEXTS = ["", "plain words, and marks!!", "I'm we'll don't 'S it's", "\x1cb a\x1cb", "<|endoftext|> a<|startoftext|>b",
         "É éé\u0085z 12'34  x", "é İstanbul ΑΣ ß ẞ ſ K", "東京 ½²ª x’s​", "a" * 500, "1" * 300, "-+" * 200]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    data = P.word_ids(PATH).of(text)
    assert list(struct.unpack(f"<{len(data) // 4}I", data)) == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    want = P.word_ids(PATH).tokenizer.encode(text, add_special_tokens=False).ids
    data = P.word_ids(PATH).of(text)
    assert list(struct.unpack(f"<{len(data) // 4}I", data)) == want


def test_full_tables_are_emptied():
    words = P.WordIds(PATH, held=3)
    assert words.of("a b c d e f a b") == b"".join(words.of(w) for w in "abcdefab") and len(words) <= 3


def test_pack_and_sequences(spark, docs):
    r = random.Random(2)
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 700), (3, "word " * 700)]
    rows += [(10 + i, " ".join(r.choices(["the", "of", "idea", "Grüße"], k=r.randint(1, 60)))) for i in range(120)]
    got = P.pack(docs(rows), PATH, capacity=64, keep_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), 64):
            part = ids[i:i + 64]
            want.append((doc, i // 64, i, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(map(str, want)) == sorted(str(tuple(x)[:5]) for x in got)
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length, x.ids))
    for own in by.values():
        at = 0
        for offset, length, ids in sorted(own):
            assert offset == at and len(ids) == 4 * length
            at += length
        assert at <= 64
    whole = {x.sequence_id: bytes(x.ids) for x in P.sequences(P.pack(docs(rows), PATH, 64, keep_ids=True)).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(x.length for x in got)
    assert P.pack(docs([]), PATH).count() == 0
