"""Tokens, token counts and packing against the tokenizer itself and exact rebuilding."""

import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexiflow.llm import packing, token_counts, tokens
from lexiflow.llm import words as W


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(bpe, text):
    return bpe.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(bpe):
    rng = random.Random(1)
    odd = ["a", "é", " ", "\n", "\t", " ", " ", "　", "'s", "12", "!", "<|endoftext|>", "\r\n", "漢字", "Ab", "…", "\x85"]
    texts = ["", " ", "\n\n"] + ["".join(rng.choice(odd) + " " * rng.choice((0, 1, 1, 2)) for _ in range(rng.randrange(30)))
                                 for _ in range(400)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    enc = tokens.Encoder(tokens.default_ranks_path())
    for _ in range(2):  # the second time from what it knows
        ids, at = enc.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [ids_of(bpe, t) for t in texts]


def test_forgetting_encoder(bpe, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    enc = tokens.Encoder(tokens.default_ranks_path())
    for text in ("one two three", "two three four five", "one six"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert enc.encode(raw, np.array([0, len(raw)]))[0].tolist() == ids_of(bpe, text)


def check_pieces(rows, texts, bpe, capacity):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in texts.items():
        ids, at = ids_of(bpe, text) + [0], 0
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // capacity)))
        for p in pieces:
            assert p.start == at and (p.piece == 0 or p.length == capacity)
            assert zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by_seq


def test_pack_sample(sample, bpe):
    rows = packing.pack_documents(sample).collect()
    texts = {r.doc_id: r.text for r in sample.collect()}
    by_seq = check_pieces(rows, texts, bpe, 2048)
    total = sum(r.length for r in rows)
    assert len(by_seq) <= 1.03 * total / 2048 + 1


def test_pack_odd_rows(odd, odd_rows, bpe):
    with_ids = packing.pack_documents(odd, with_ids=True)
    rows = with_ids.collect()
    per_id = collections.Counter()
    for r in odd_rows:
        per_id[r[0]] += len(ids_of(bpe, r[1])) + 1
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.length
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert got == per_id
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    for s in packing.packed_sequences(with_ids).collect():
        assert sum(len(x) for x in s.ids) == 4 * s.n_tokens <= 4 * 2048


def brute_best_fit(lengths, capacity):
    """Number of bins of the same method, one item at a time."""
    gaps = []
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    while large:
        a = large.pop(0)
        fit = next((n for n in large if n <= capacity - a), None)
        if fit:
            large.remove(fit)
        gaps.append(capacity - a - (fit or 0))
    for s in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return len(gaps)


def test_plan_equals_item_by_item_best_fit():
    rng = random.Random(3)
    for capacity in (10, 30, 97):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(60))] + [rng.randint(1, 4)] * rng.randrange(30)
            hist = collections.Counter(lengths)
            plan = packing.plan_bins(hist, capacity)
            used = collections.Counter()
            for bins, contents in plan:
                assert sum(n * c for n, c in contents) <= capacity
                for n, c in contents:
                    used[n] += bins * c
            assert used == hist
            assert sum(b for b, _ in plan) == brute_best_fit(lengths, capacity)


def test_plan_size_follows_the_capacity_not_the_items():
    hist = {n: 10 ** 9 + n for n in range(1, 2049)}
    plan = packing.plan_bins(hist, 2048)
    assert len(plan) < 3 * 2048
    assert sum(b for b, _ in plan) * 2048 < 1.01 * sum(n * c for n, c in hist.items())


def test_token_counts(odd, odd_rows, bpe):
    lengths = [len(ids_of(bpe, r[1])) for r in odd_rows]
    for r in token_counts.token_counts(odd).collect():
        limit = r.context_limit
        assert r.n_docs == lengths.count(limit) and r.n_docs_longer == sum(n > limit for n in lengths)
        assert r.n_tokens_cut == sum(min(n, limit) for n in lengths) and r.n_tokens_total == sum(lengths)
        assert r.n_tokens_up_to == sum(n for n in lengths if n <= limit)
        assert abs(r.quantile - sum(n <= limit for n in lengths) / len(lengths)) < 1e-12
    assert {r.context_limit for r in token_counts.token_counts(odd).collect()} == set(lengths)


def test_empty_tables(empty):
    assert packing.pack_documents(empty).count() == 0
    assert token_counts.token_counts(empty).count() == 0


def test_word_hashes_do_not_depend_on_the_place():
    h = W.Hasher()
    a, b = b"alpha beta gamma", b"xx\tgamma\n alpha"
    words = []
    for raw in (a, b):
        buf = np.frombuffer(raw, np.uint8)
        s, e, _ = W.word_spans(buf, np.array([0, len(raw)]))
        words.append(dict(zip([raw[x:y] for x, y in zip(s, e)], h.spans(buf, s, e).tolist())))
    assert words[0][b"alpha"] == words[1][b"alpha"] and words[0][b"gamma"] == words[1][b"gamma"]
    assert len(set(words[0].values())) == 3
