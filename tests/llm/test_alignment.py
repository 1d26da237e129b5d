"""Alignment of two tokenizers against a brute-force version."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orrery.llm import alignment
from orrery.llm.packing import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text, a, b):
    """(id, bytes) of both sides, none where a side does not give the text back."""
    symbol = byte_symbols()
    encoded = a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(symbol[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens, strict=True)]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (one, two) if all(b"".join(x for _, x in side) == whole for side in (one, two)) else ([], [])


def ends(side):
    out, at = [], 0
    for _, x in side:
        at += len(x)
        out.append(at)
    return out


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    per = []
    for key, text in rows:
        one, two = tokens(text, a, b) if text else ([], [])
        e, f = ends(one), ends(two)
        spans = [(i, j) for i in range(len(e)) for j in range(len(f)) if e[i] - len(one[i][1]) < f[j] and f[j] - len(two[j][1]) < e[i]] if len(e) < 300 else None
        links = [(one[i][0], two[f.index(x)][0]) for i, x in enumerate(e) if x in set(f)]
        groups, low = [], 0
        for x in sorted(set(e) & set(f)):
            groups.append("|".join(",".join(str(t) for (t, _), y in zip(side, z, strict=True) if low < y <= x) for side, z in ((one, e), (two, f))))
            low = x
        per.append((key, one, two, spans, links, ";".join(groups)))
    count = Counter(x for p in per for x in p[4])
    best: dict[int, int] = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (k, len(one), len(two), said.count(";") + 1 if said else 0, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else "", spans)
        for k, one, two, spans, links, said in per
    ]


WORDS = ["the", "tokenizers", "naïve", "Straße", "日本語", "don't", "<|endoftext|>", "</s>", "x=1;", "a▁b", "12345", "🙂🙂", "unhappiness", "ﬁne", "İ", "á", "(see", "above)."]


def texts(seed):
    rng = random.Random(seed)
    plain = [" ".join(rng.choice(WORDS[:7] + WORDS[10:13]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    lines = ["\n".join(" ".join(rng.choice(WORDS[:6]) for _ in range(5)) for _ in range(6)) for _ in range(10)]
    odd = [rng.choice(["  ", "\t", "\n\n", " \n", "\r\n", " ", "\x1c", "\x00", " "]).join(rng.choice(WORDS) for _ in range(8)) for _ in range(60)]
    ends_ = [" lead", "trail ", "\nfirst", "last\n", "\n", " ", "", None, "▁", "a"]
    return list(enumerate([*plain, *lines, *odd, *ends_]))


@pytest.mark.parametrize("frequent", [1 << 19, 20, 0])
def test_against_brute_force(spark, monkeypatch, frequent):
    """The same rows whether all counts are broadcast, few or none."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = texts(frequent)
    rows += [rows[0], rows[0], (None, rows[1][1]), (5, "the other text of five")]
    df = spark.createDataFrame([(k, t, 1.5) for k, t in rows], "doc_id long, text string, pairs double").repartition(3)
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_overlaps) for r in alignment.scored(df, A, B).collect())
    want = sorted((str(w[0]), *w[1:8], len(w[8])) for w in brute(rows))
    assert got == want
    assert any(w[1] for w in want) and any(not w[1] for w in want)


def test_spans(spark):
    rows = texts(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.aligned(df, A, B).collect()}
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    for w in brute(rows):
        r = got[w[0]]
        one, two = tokens(rows[w[0]][1], a, b) if rows[w[0]][1] else ([], [])
        assert (r.ids_a, r.ids_b) == ([i for i, _ in one], [i for i, _ in two])
        assert (r.ends_a, r.ends_b) == (ends(one), ends(two))
        assert sorted(zip(r.overlap_a, r.overlap_b, strict=True)) == sorted(w[8])
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_cache_and_chunks_do_not_matter(monkeypatch):
    made = [t for _, t in texts(2) if t]
    want = [[x.tolist() for x in side] for side in alignment.Aligner(A, B)(made)]
    monkeypatch.setattr(alignment, "CACHE_BYTES", 0)
    aligner = alignment.Aligner(A, B)
    got = [[[], []], [[], []]]
    for k, t in enumerate(made):
        for side, (ids, _) in zip(got, aligner([t]), strict=True):
            side[0] += ids.tolist()
            side[1] += [k] * len(ids)
    assert got == want


def test_very_long_and_empty(spark):
    rows = [(1, "word " * 60_000 + "end"), (2, "x" * 20_000), (3, None)]
    got = {r.doc_id: r for r in alignment.scored(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert got[1].n_groups == 60_001 and got[2].n_links > 0 and got[3].groups_sha256 == "" and got[3].count_sum == 0
    assert alignment.scored(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
