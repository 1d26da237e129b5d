"""Line dedup, decontamination and near-duplicates: against their SQL, and by hand on odd rows."""

import random
import re

import pytest
from oracle import rows, sql_rows

from orrery.llm import decontaminate, linededup, neardup

LONG = " ".join(f"w{i}" for i in range(60))
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "One"), (6, LONG), (7, LONG), (7, LONG), (None, LONG), (8, LONG + " tail"), (9, "É é ß"), (10, "a " * 30000)]


def test_search_against_sql(spark, documents):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate((25, 10, 9, 1, 12, 40))] + [(6, None), (7, "--"), (None, LONG)]
    texts = [" ".join(rng.choices(words, k=80)) + ", " + (items[i % 6][1].upper() if i % 2 else "") + ". x" for i in range(40)]
    sf = documents([(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "!?")])
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    names, want = sql_rows(decontaminate.SQL.replace("FROM benchmark", "FROM benchmark WHERE item_id IS NOT NULL"), sf)
    assert rows(decontaminate.op3(spark, sf)) == want
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows(decontaminate.digest(decontaminate.search(docs, bench, block_bytes=100))) == want


def test_search_odd_rows(spark, documents):
    sf = documents(ODD)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS item", "2 AS w")
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (1, "ONE")], "item_id long, text string")
    found = decontaminate.search(docs, bench)
    assert found.count() == len(ODD) and {"item", "w"} <= set(found.columns)
    hit = {r.doc_id for r in decontaminate.digest(found).where("contaminated").collect()}
    assert hit == {4, 5, 6, 7, 8, None}
    assert decontaminate.search(docs, bench.limit(0)).where("size(__items) > 0").count() == 0
    assert decontaminate.search(docs.limit(0), bench).count() == 0


def test_tables_of_a_block_are_bounded():
    """Whatever the words: a block's tables keep to the stated bytes for each byte of its text."""
    rng = random.Random(8)
    for item in (lambda: " ".join(rng.choices("abcdefgh", k=40)), lambda: "a", lambda: " ".join(str(rng.randrange(10**6)) for _ in range(300)), lambda: " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 12)))):
        items, size = [], 0
        while size < 1 << 19:
            items.append((str(len(items)), item()))
            size += len(items[-1][1])
        tables, ids = decontaminate.patterns(items, 10)
        shared = sum(x.nbytes for x in (tables[0].text, tables[0].starts, tables[0].ends, tables[0].word))
        assert shared + sum(t.nbytes() - shared for t in tables) <= decontaminate.TABLE_BYTES * size
    assert decontaminate.TABLE_BYTES * decontaminate.BLOCK_BYTES <= 256 << 20


def test_search_keeps_other_columns(spark, documents):
    sf = documents([(1, "one two"), (2, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "7 AS __k2", "8 AS __spans", "9 AS item")
    bench = spark.createDataFrame([(i, f"one two {i}") for i in range(9)] + [(99, "two")], "item_id long, text string")
    for block in (1 << 20, 20):
        got = decontaminate.search(docs, bench, block_bytes=block).orderBy("doc_id").collect()
        assert [(r["__k2"], r.item, r["__spans"], r["__items"]) for r in got] == [(7, 9, [1, 2], ["99"]), (7, 9, [], [])]


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def noisy(rng, words, share):
    return [rng.choice(("zz", "yy", "xx")) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("size", "few"), [(2, 24), (2, 2), (5, 24)])
def test_near_duplicates(spark, documents, monkeypatch, size, few):
    monkeypatch.setattr(neardup, "FEW", few)
    rng = random.Random(size * 100 + few)
    texts = []
    for _ in range(8):
        base = [f"t{rng.randrange(5000)}" for _ in range(rng.choice((3, 12, 80, 300)))]
        texts += [" ".join(base)] + [" ".join(noisy(rng, base, rng.choice((0, 0.01, 0.03, 0.06, 0.1)))) for _ in range(25)]
    texts += [None, "", " ", "Solo", "solo", "two words"]
    sf = documents(list(enumerate(texts)))
    want, counts = brute(texts, size, 80)
    got = neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), size).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want
    assert [r.n_shingles for r in got] == counts
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_near_duplicates_odd_rows(spark, documents):
    docs = spark.read.parquet(documents(ODD) + "/documents.parquet").selectExpr("*", "1 AS sig", "2 AS component")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (7, 6, False), (8, 6, False), (None, None, True)} <= got
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for n, shared in ((40, 32), (2000, 1700), (2000, 900)):
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], rng.integers(0, 2**63, n - shared, dtype=np.uint64)]))
        true = shared / (2 * n - shared)
        assert abs(neardup.estimate(neardup.registers(a), neardup.registers(b), len(a), len(b)) - true) < 0.12


def test_line_dedup(spark, documents):
    rng = random.Random(9)
    plain = lambda: " ".join(f"q{rng.randrange(10**6)}" for _ in range(12))
    passage = " ".join(f"p{i}x" for i in range(55))
    docs = [(i, "\n".join([plain(), f"posted by user{i} at page {i} of the old forum", passage if i % 3 == 0 else plain(), "Ok."])) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "same line of four tokens\nsame line of four tokens"), (104, docs[1][1]), (None, passage)]
    sf = documents(docs)
    names, want = sql_rows(linededup.SQL.replace("AS (SELECT doc_id, text, string_split", "AS (SELECT doc_id, text, string_split"), sf)
    got = rows(linededup.op2(spark, sf))
    assert [r for r in got if r[0] != "None"] == [r for r in want if r[0] != "None"]
    after = {r.doc_id: r.text for r in linededup.op2(spark, sf).collect()}
    assert sum(passage in (t or "") for i, t in after.items() if i is not None) == 1
    assert "posted" not in after[7] and after[0] == docs[0][1] and after[103] == docs[33][1]
    assert after[100] is None and after[101] == "" and after[None] == passage
    assert linededup.without_lines(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


@pytest.mark.parametrize("n", [60, 6_000, 100_000])
def test_templates_hold_at_size(spark, documents, n):
    """Lines of one template with two fields of 512 values fall however often a value recurs; prose stays."""
    rng = random.Random(n)
    line = lambda: f"Posted by the member {words[rng.randrange(512)]} of the old forum for {words[rng.randrange(512)]} and friends of the house"
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(512)]
    prose = [" ".join(rng.choices(words, k=14)) for _ in range(200)]
    every = max(1, n // 200)
    docs = [(i, f"{line()}\n{prose[i // every]}" if i % every == 0 and i // every < 200 else line()) for i in range(n)]
    got = linededup.op2(spark, documents(docs)).collect()
    assert sum(r.n_dropped for r in got) >= 0.9 * (n - 1)
    assert sum(p in (r.text or "") for r in got for p in [prose[r.doc_id // every] if r.doc_id % every == 0 and r.doc_id // every < 200 else "\0"]) == sum(i % every == 0 and i // every < 200 for i in range(n))


def test_line_dedup_repeated_ids_and_columns(spark, documents):
    """Rows of one id keep their own lines; columns of any name pass through; equal rows are cut alike."""
    boiler, other = "this is one line of boilerplate text", "only here is this line of text"
    rows = [(1, f"{boiler}\nfirst of all the texts here"), (2, f"second of all the texts\n{boiler}"), (2, f"yes it is the second\n{other}"), (3, boiler), (3, boiler)]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet").selectExpr("*", "1 AS __x", "2 AS `h`", "3 AS line", "4 AS __dropped", "5 AS `a.b`")
    out = linededup.without_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "__dropped"] + ["__lines", "__dropped"]
    got = sorted((r.doc_id, r.text, tuple(r["__dropped"]), r["__x"], r["a.b"]) for r in out.collect())
    want = [(1, rows[0][1], ()), (2, rows[1][1].split("\n")[0], (1,)), (2, rows[2][1], ()), (3, "", (0,)), (3, "", (0,))]
    assert got == sorted((*w, 1, 5) for w in want)


def test_line_dedup_of_very_long_lines(spark, documents):
    long = " ".join(f"w{i}x" for i in range(20_000))
    sf = documents([(1, long), (2, long.replace(" w500x ", " other ")), (3, "a\n" * 5_000)])
    assert [r.n_dropped for r in linededup.op2(spark, sf).orderBy("doc_id").collect()] == [0, 1, 0]


def test_near_duplicates_of_repeated_ids(spark, documents):
    """Texts under one id are one document: what is near any of them is linked with it."""
    rng = random.Random(31)
    a, b = ([f"{c}{rng.randrange(9999)}" for _ in range(200)] for c in "ab")
    near = lambda w: " ".join([*w[:-2], "other", "end"])
    rows = [(1, near(a)), (2, " ".join(a)), (2, " ".join(b)), (3, near(b)), (5, "alone"), (5, "alone"), (6, " ".join(a)), (6, "six"), (7, "six"), (8, "eight")]
    got = neardup.near_duplicates(spark.read.parquet(documents(rows) + "/documents.parquet")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (5, 5), (5, 5), (6, 1), (6, 1), (7, 1), (8, 8)]
