"""Cutting-stock packing: every id once, no padding, the program against its optimality conditions."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm import cutting, packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(BPE)
    ids = [(k, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in docs]
    have = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    by = defaultdict(list)
    for key in have:
        by[key[0], key[4]].append(key)
    for k, own in ids:  # a document's pieces follow one another and hold its ids
        at = 0
        while at < len(own):
            fit = [p for p in by[k, len(own)] if p[1] == at and have[p] and p[3] == zlib.crc32(np.array(own[at : at + p[2]], "<u4").tobytes())]
            assert fit, (k, at)
            have[fit[0]] -= 1
            at += fit[0][2]
        assert at == len(own)
    assert not +have
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)
    return len(sequences), sum(len(own) for _, own in ids)


WORDS = "the cat sat on a mat and looked at every house in the long street while rain fell".split()


@pytest.mark.parametrize("capacity", [64, 100])
def test_every_id_once_without_padding(spark, documents, capacity):
    rng = np.random.default_rng(5)
    docs = [(k, " ".join(rng.choice(WORDS, rng.integers(0, 90)))) for k in range(300)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (400, None), (401, ""), (402, "word " * 3000), (403, "x<|endoftext|>y"), (404, "nospace" * 500), (None, docs[3][1])]
    df = spark.createDataFrame([(k, t, "own") for k, t in docs], "doc_id long, text string, line string")
    used, tokens = check(cutting.packed(df, BPE, capacity).collect(), docs, capacity)
    assert used <= tokens // capacity + 40


def test_one_length_is_cut(spark):
    docs = [(k, " ".join(["mat"] * 40)) for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    used, tokens = check(cutting.packed(df, BPE, 64).collect(), docs, 64)
    assert used == tokens // 64 + bin(tokens % 64).count("1")


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = [(k, " ".join(["mat"] * (30 + k % 7))) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(tuple, cutting.packed(df, BPE, 64).collect()))
    monkeypatch.setattr(cutting, "FEW", -1)
    assert sorted(map(tuple, cutting.packed(df, BPE, 64).collect())) == one


def test_empty_table(spark):
    assert cutting.packed(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []


def every_pattern(sizes, need, capacity):
    tops = [min(n, capacity // s) for s, n in zip(sizes, need, strict=True)]
    fits = set(cutting.targets(capacity))
    for counts in itertools.product(*[range(t + 1) for t in tops]):
        if sum(s * n for s, n in zip(sizes, counts, strict=True)) in fits:
            yield counts


@pytest.mark.parametrize("seed", range(6))
def test_program_is_optimal(seed, monkeypatch):
    """No pattern at all, found by enumeration, is worth more at the final prices than a sequence costs."""
    monkeypatch.setattr(cutting, "GAP", 0.0)
    rng = np.random.default_rng(seed)
    need = np.zeros(25, np.int64)
    need[rng.choice(np.arange(2, 24), 6, replace=False)] = rng.integers(1, 9, 6)
    made = cutting.program(need, 24)
    for counts in every_pattern(made.sizes, made.need, 24):
        assert np.dot(counts, made.price) <= 1 + 1e-5
    assert (made.price <= made.line + 1e-6).all()
    covered = np.zeros(25)
    for pattern, amount in made.amounts().items():
        assert sum(s * n for s, n in pattern) in cutting.targets(24)
        for s, n in pattern:
            covered[s] += n * amount
    assert (covered <= need + 1e-6).all()
    assert made.value == pytest.approx(sum(made.amounts().values()) + ((need - covered) * np.arange(25)).sum() * (1 + cutting.CUT) / 24, abs=1e-4)


@pytest.mark.parametrize("mean,deviation,n", [(5.5, 1.0, 3000), (6.0, 0.4, 5000), (7.4, 0.1, 500)])
def test_plan_covers_the_histogram(mean, deviation, n):
    lengths = np.clip(np.random.default_rng(1).lognormal(mean, deviation, n).astype(int), 1, 2048)
    demand = np.bincount(lengths, minlength=2049)
    plan = cutting.planned(demand, 2048)
    used = np.zeros(2049, np.int64)
    for pattern, times in plan.patterns:
        assert sum(s * k for s, k in pattern) in cutting.targets(2048)
        for s, k in pattern:
            used[s] += k * times
    assert (used + plan.rest == demand).all()
    assert plan.bound <= plan.cost * (1 + 1e-9) and plan.cost - plan.bound <= cutting.GAP * plan.cost + 1e-6
    if mean < 7:  # long ones alone have no partners and are cut
        assert plan.rest.sum() <= 0.05 * n


def test_cache_of_units_is_bounded_by_bytes(monkeypatch):
    """Texts without spaces are single units: they are not remembered, and others only up to a number of bytes."""
    monkeypatch.setattr(packing, "CACHE_BYTES", 50_000)
    encoder = packing.Encoder(BPE)
    for k in range(30):
        texts = [f"{k}" + "文字" * 400 + f" {k}x{j}" for j in range(50)]
        assert [len(x) // 4 for x in encoder(texts)] == [len(e.ids) for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert sum(len(u) + len(v or b"") for u, v in encoder.known.items()) < 100_000
        assert max(map(len, encoder.known), default=0) <= packing.LONGEST_UNIT
