"""WARC, packing, quality rules, sharding, scoring, chats, pages and the pipeline on small tables."""

import base64
import hashlib
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from oracle import rows as plain_rows
from oracle import sql_rows

from orrery.llm import chat, common, htmltext, linededup, lmscore, packing, quality, sharding, warc

FULL = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [(1, "u1", "a"), (2, "u2", "x" + FULL + "WARC/1.0\r\nfoo " + warc.MAGIC), (3, "u3", None), (4, "u\r\n4", ""), (5, "u5", FULL * 3), (6, None, "é" * 3000), (7, "u7", "a"), (9, "u9", FULL + "tail"), (10, "u", warc.MAGIC)]


@pytest.mark.parametrize("split", [150, 700, 1 << 27])
def test_warc_round_trip(spark, split):
    pages = PAGES + [(i, "u", "p%d" % (i % 7) * (i % 50)) for i in range(20, 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS n").coalesce(2)
    path = warc.scratch_path(spark, "test")
    warc.write_warc(df, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = {r.page_id: r for r in warc.read_warc(spark, path, payload=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(pages)
    first: dict = {}
    for i, _, html in pages:
        first.setdefault(html or "", i)
    for i, _, html in pages:
        r, data = got[i], (html or "").encode()
        assert r.valid and r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
        assert r.record_type == "revisit" or r.payload == data


def test_warc_of_nothing(spark):
    path = warc.scratch_path(spark, "test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_repeated_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (2, "u", "b"), (None, "u", "a")]
    path = warc.scratch_path(spark, "test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()]
    assert Counter(got) == Counter({(1, "response", None): 2, (2, "revisit", 1): 1, (2, "response", None): 1, (None, "response", None): 1})


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
TEXTS = ["x  y", " lead x", "tail ", "a \n b", "a\n b", "q <|endoftext|> r", "a  b", "a   b", "it's 10½ ²³ _x __ a_b", "日本語 テスト", None, "", " ", "word " * 5000, "x" * 3000, "same text", "same text"]


def test_pack(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    sf = documents(list(enumerate(TEXTS)) + [(i, "some words of prose " * (i % 90)) for i in range(100, 400)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, TOKENIZER, ids=True).toPandas().sort_values(["doc_id", "piece"])
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for doc, part in got.groupby("doc_id"):
        want = tokenizer.encode(text[doc], add_special_tokens=False).ids + [0]
        assert b"".join(part.ids) == np.array(want, "<u4").tobytes()
        assert (part.start == np.cumsum(part.length) - part.length).all()
        assert (part.length.iloc[1:] == 2048).all() and (len(part) == 1 or len(want) > 2048)
    placed = got.sort_values(["sequence_id", "offset"])
    ends = (placed.offset + placed.length).groupby(placed.sequence_id).shift(fill_value=0)
    assert (ends == placed.offset).all() and (placed.groupby("sequence_id").length.sum() <= 2048).all()
    assert placed.sequence_id.nunique() <= -(-placed.length.sum() // 2048) + 1
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize(("low", "high", "n"), [(600, 760, 20000), (1, 2047, 5000), (900, 1100, 999), (1, 30, 5000), (2047, 2048, 10)])
def test_plan_covers_and_is_no_worse_than_best_fit(low, high, n):
    demand = np.bincount(np.random.default_rng(n).integers(low, high + 1, n), minlength=2049)
    plan = packing.planned(demand, 2048)
    made = np.zeros(2049, int)
    for config, times in plan:
        assert sum(s * k for s, k in config) <= 2048
        for s, k in config:
            made[s] += k * times
    assert (made == demand).all()
    rest = demand.copy()
    rest[2048] = 0
    assert sum(t for _, t in plan) <= demand[2048] + sum(t for _, t in packing._filled(rest, 2048))
    if (low, high) == (600, 760):
        assert sum(t for _, t in plan) < 1.02 * n / 3  # three to a sequence


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_configurations_hold_most_pieces_at_the_bound(sf):
    """Of the tables' lengths most pieces are placed by configurations, in at most one sequence more than the bound."""
    import os

    import pyarrow.parquet as pq

    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    demand = np.zeros(2049, np.int64)
    for batch in packing._pieces(iter(pq.read_table(path, columns=["doc_id", "text"]).to_batches(max_chunksize=2000)), TOKENIZER, 2048, False):
        demand += np.bincount(batch.column("length").to_numpy(), minlength=2049)
    got = packing.solved(demand, 2048)
    assert got.bound <= got.sequences <= np.ceil(got.bound - 1e-6) + 1
    assert got.left < 0.1 * (demand.sum() - demand[2048])


def test_dual_bound_on_small_demands():
    """The bound never passes the fewest sequences, found by trying all."""
    from functools import lru_cache

    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.randint(2, 12) for _ in range(7)), reverse=True)

        @lru_cache(None)
        def fewest(at, rooms, sizes=tuple(sizes)):
            if at == len(sizes):
                return len(rooms)
            used = [fewest(at + 1, tuple(sorted((*rooms[:i], r - sizes[at], *rooms[i + 1 :])))) for i, r in enumerate(rooms) if r >= sizes[at]]
            return min([*used, fewest(at + 1, tuple(sorted((*rooms, 12 - sizes[at]))))])

        got = packing.solved(np.bincount(sizes, minlength=13), 12)
        assert got.bound <= fewest(0, ()) + 1e-9 and got.sequences <= fewest(0, ()) + 1


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_statistics(spark, documents):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b", "é ß €uro", "x\x0by\x0cz\rq", "same\nsame\n \n same", "w " * 500, " nbsp  "]
    texts += [" ".join(rng.choices("ab", k=60)) for _ in range(20)] + [" ".join(rng.choices(["a", "b#", "c\n", "|"], k=90)) for _ in range(20)]
    sf = documents(list(enumerate(texts)))
    for r in quality.op5(spark, sf).collect():
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judged(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


def test_quality_rejects_outliers_only(spark, documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(40, 400))) for _ in range(200)]
    junk = [" ".join(word() + "%%%" for _ in range(100)) for _ in range(8)]
    sf = documents([(i, t, "en", "s1") for i, t in enumerate(clean)] + [(1000 + i, t, "en", "s1") for i, t in enumerate(junk)] + [(2000, clean[0], None, None)])
    kept = {r.doc_id for r in quality.op5(spark, sf).where("kept").collect()}
    assert kept == {*range(200), 2000}


def test_quality_judges_small_groups(spark, documents):
    """Outliers in a small source fall by their language's estimate, those in a small language by that of all rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    clean = lambda: " ".join(word() for _ in range(rng.randint(40, 400)))
    junk = lambda: " ".join(word() + "%%%" for _ in range(100))
    rows = [(i, clean(), "en", "big") for i in range(200)] + [(300 + i, clean(), "en", f"small{i % 3}") for i in range(30)] + [(400 + i, clean(), "xx", "big") for i in range(10)]
    bad = [(1000, junk(), "en", "small0"), (1001, junk(), "en", "alone"), (1002, junk(), "xx", "big"), (1003, junk(), None, None)]
    got = {r.doc_id: r.kept for r in quality.op5(spark, documents(rows + bad)).collect()}
    assert got == {r[0]: True for r in rows} | {r[0]: False for r in bad}
    assert quality.judged(spark.read.parquet(documents(rows + bad) + "/documents.parquet")).where("NOT base_failed AND distance IS NULL").count() == 0


def test_quality_whose_groups_are_all_small(spark, documents):
    """The estimate of all rows judges even where no language has rows enough."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(40, 400))), "abcdefgh"[i % 8], "s") for i in range(160)]
    kept = {r.doc_id for r in quality.op5(spark, documents([*rows, (900, " ".join(word() + "%%%" for _ in range(100)), "z", "s")])).where("kept").collect()}
    assert kept == set(range(160))


def test_covariance_determinant_against_numpy(spark, documents):
    """The distances of the last step are those of numpy with the same rows nearest."""
    rng = np.random.default_rng(2)
    assert quality._TRIANGLE == [(i, j) for i in range(5) for j in range(i + 1)]
    a = rng.normal(size=(50, 5))
    cov = np.cov(a.T, bias=True)
    row = {"u%d" % i: float(a[:, i].mean()) for i in range(5)} | {f"c_{i}_{j}": float(cov[i, j]) for i, j in quality._TRIANGLE} | {f"x{i}": float(a[0, i]) for i in range(5)}
    from pyspark.sql import functions as F

    df = quality._factored(spark.createDataFrame([row]))
    got = df.select(quality._distance([F.col(f"u{i}") for i in range(5)], {}).alias("d")).first().d
    d = a[0] - a.mean(0)
    assert got == pytest.approx(d @ np.linalg.solve(cov + quality.FLOOR**2 * np.eye(5), d), rel=1e-9)


def brute_determinant(x, share, starts, rng):
    """Half the log determinant and the mean of the best of many random starts, in numpy."""
    h, best = int(np.ceil(share * len(x))), (np.inf, None)
    for _ in range(starts):
        near = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(20):
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + quality.FLOOR**2 * np.eye(5)
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            near = x[np.argsort(d, kind="stable")[:h]]
        best = min(best, (np.linalg.slogdet(np.cov(near.T, bias=True) + quality.FLOOR**2 * np.eye(5))[1] / 2, near.mean(0).tolist()))
    return best


def test_smallest_determinant_against_many_starts(spark):
    """On small groups with a clump of outliers the determinant and the mean are those of 200 random starts."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for g in range(4):
        x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
        x[:12] = x[:12] * 0.1 + 9 + g  # a fifth, close together
        want[g] = brute_determinant(x, quality.SHARE, 200, rng)
        rows += [(2, "l", str(g), *map(float, r)) for r in x]
    fit = spark.createDataFrame(rows, "g0 int, g1 string, g2 string, " + ", ".join(f"x{i} double" for i in range(5)))
    for few in (True, False):
        for r in quality.estimates(fit, few).collect():
            half, mean = want[int(r.g2)]
            assert half - 0.01 < r.determinant < half + 0.3
            assert [r[f"u{i}"] for i in range(5)] == pytest.approx(mean, abs=0.5)


def fewest(sizes, shards):
    """The least largest part over all contiguous partitions."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = ends.astype(float).copy()
    for _ in range(shards - 1):
        best = np.array([min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))])
    return best[-1]


def test_shards(spark, documents):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, "t%d" % rng.randrange(120) * rng.randrange(1, 40)) for i in range(300)] + [(1000 + i, "hot text") for i in range(150)] + [(2000, None), (2001, ""), (2001, "")]
    sf = documents(rows)
    got = sharding.op6(spark, sf).toPandas()
    assert len(got) == len(rows)
    groups = spark.read.parquet(f"{sf}/documents.parquet").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("b")).groupBy("h").agg(F.sum("b").alias("b")).orderBy("h").toPandas()
    assert got.groupby("shard")["size"].sum().max() == fewest(groups.b.to_numpy(), 24) == sharding.smallest_capacity(groups.b.to_numpy(), 24)
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.assign(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


def test_deep_cells_give_the_same_capacity(spark, documents):
    rng = random.Random(8)
    g = [(rng.randrange(-(2**63), 2**63), rng.randrange(1, 1000)) for _ in range(3000)]
    table = sharding.written(spark.createDataFrame(g, "hash long, bytes long"), "groups")
    order = sorted(g)
    sizes = np.array([b for _, b in order])
    for bits, fetch in ((16, 10**6), (4, 10), (6, 40)):
        last = sharding.boundaries(table, 24, bits, fetch)
        part = np.searchsorted(last, [h for h, _ in order], "left")
        assert np.bincount(part, sizes).max() == sharding.smallest_capacity(sizes, 24)


def test_scores(spark, documents):
    rng = random.Random(2)
    good, bad = ([f"{k}{i}" for i in range(40)] for k in "gb")
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=50))) for i in range(200)] + [(900, None), (901, ""), (902, "?!")]
    sf = documents(rows)
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in lmscore.op7(spark, sf).collect()}
    assert max(got[i].score for i in range(101, 200, 2)) < min(got[i].score for i in range(100, 200, 2))
    assert got[900].score is None and got[901].n_tokens == 0 and len(got) == 203
    model = lmscore.fitted(spark.read.parquet(f"{sf}/documents.parquet"))
    assert model.words.sum() == 200 * 50 and model.pairs.sum() == 200 * 49


def test_chats(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(100)}" for _ in range(n))
    turns = []
    for c in range(60):
        for t in range(rng.randint(2, 9)):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", say(rng.randint(3, 8)) + "?" if t % 2 == 0 else say(30) + "\n" + say(25)))
    turns += [(100, 0, "user", None), (101, None, "user", "x"), (102, 0, None, "no role"), (None, 0, "user", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS line", "2 AS block")
    lines = chat.written(chat._numbered(chat.seen(chat.transcripts(df))), "lines")
    model = chat.fit(lines)
    got = {(r.conv_id, r.line): r for r in chat.parse(lines, model).collect()}
    truth = [r for r in lines.collect() if r.role]
    assert sum(got[r.conv_id, r.line].role == r.role for r in truth) > 0.95 * len(truth)
    out = chat.format_chats(df)
    assert out.where("canonical NOT LIKE '<|%|>%'").count() == 0
    assert chat.format_chats(df.limit(0)).count() == 0


def test_rows_of_one_turn_follow_one_another(spark):
    rows = [(1, 0, "user", "A1\nA2\nA3"), (1, 0, "user", "B1\nB2\nB3"), (1, 1, "assistant", "ok then"), (1, 0, "user", "A1\nA2\nA3")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = [r.text for r in chat._numbered(chat.seen(chat.transcripts(df))).orderBy("line").collect()]
    said = "".join(re.sub(".*(..)$", r"\1", x) for x in lines if x)
    assert sorted(re.findall("A1A2A3|B1B2B3", said)) == ["A1A2A3", "A1A2A3", "B1B2B3"]


def viterbi(model, rows):
    """The best path by trying every state at every line, and the line before it."""
    scores = model.scores({f: np.array([r[f] for r in rows]) for f in chat.FEATURES})
    best = {s: (model.start[s] + scores[0][s], [s]) for s in range(chat.STATES)}
    for t in range(1, len(rows)):
        best = {s: max((v + model.move[p, s] + scores[t][s], [*path, s]) for p, (v, path) in best.items()) for s in range(chat.STATES)}
    return max(best.values())


def test_held_out_roles_and_plain_viterbi(spark):
    """Conversations of one half, parsed with counts of the other: the path is the best one, and nearly all roles are right."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(100)}" for _ in range(n))
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", say(rng.randint(3, 8)) + "?" if t % 2 == 0 else say(30) + "\n" + say(25)) for c in range(80) for t in range(rng.randint(2, 9))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    lines = chat.written(chat._numbered(chat.seen(chat.transcripts(df))), "lines")
    half = lines.where(chat.fold_of() == 0)
    model = chat.fit(lines.where(chat.fold_of() == 1))
    got, right = {}, 0
    for r in chat.parse(half, model).collect():
        got.setdefault(r.conv_id, {})[r.line] = (r.role, r.begins)
    truth = half.orderBy("conv_id", "line").collect()
    for conv in got:
        rows = [r for r in truth if r.conv_id == conv]
        score = lambda path: sum(model.scores({f: np.array([r[f]]) for f in chat.FEATURES})[0][s] for r, s in zip(rows, path)) + model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        path = [2 * chat.ROLES.index(got[conv][r.line][0]) + (not got[conv][r.line][1]) for r in rows]
        assert score(path) == pytest.approx(viterbi(model, rows)[0], rel=1e-9)
        right += sum(got[conv][r.line][0] == r.role for r in rows)
    assert right > 0.95 * len(truth)


def test_blocks_do_not_change_the_path(spark, monkeypatch):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"say {t}\nand more {t}?") for t in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    lines = chat.written(chat._numbered(chat.seen(chat.transcripts(df))), "lines")
    model = chat.fit(lines)
    paths = []
    for size in (10**6, 7, 1):
        monkeypatch.setattr(chat, "BLOCK", size)
        paths.append([(r.line, r.role, r.begins) for r in chat.parse(lines, model).orderBy("line").collect()])
    assert paths[0] == paths[1] == paths[2]


def test_pages_held_out():
    field = htmltext.trained()
    right = total = 0
    for html, main in htmltext.labelled_pages(150, 77):
        found = htmltext.blocks(html)
        got = field.decode([f for _, f in found])
        right += sum(g == (t in main) for g, (t, _) in zip(got, found, strict=True))
        total += len(got)
    assert right > 0.98 * total


@pytest.mark.parametrize("open_", ["<b>", "<p><div><b><h2>x</h2>", "<x{}>", "<div>", "<li><b>"])
def test_many_unclosed_tags_take_linear_time(open_):
    import time

    def took(n):
        began = time.process_time()
        found = htmltext.blocks("<article><p>before</p>" + "".join(open_.replace("{}", str(i)) for i in range(n)) + "<p>after</p></article>")
        assert found[0][0] == "before" and found[-1][0] == "after"
        return time.process_time() - began

    assert took(100_000) < 40 * max(took(10_000), 0.05)


def test_unclosed_choices_end_at_the_next_block():
    html = "<article><p>One.</p><select><option>a<option>b<p>Two is here.</p></article>"
    assert [t for t, _ in htmltext.blocks(html)] == ["One.", "Two is here."]


def test_page(spark):
    html = (
        "<html><head><title>T</title><style>x</style></head><body><nav><a href=/>Home</a> <a href=/b>B</a></nav><header>Site</header><aside class=sidebar>See also <a href=/c>this</a></aside>"
        "<article><h1>Big  news</h1><p>First&nbsp;&amp; <b>bold</b> words,\n here.<p>Second one &lt;x&gt; is longer than that.<script>var a='</p>';</script></article>"
        '<div class="ad">Buy now</div><div id="comments"><div class="comment"><p>I like it.</p></div></div><form>Mail <input></form><footer>&copy; me</footer></body></html>'
    )
    rows = [(1, "u", html), (2, None, None), (3, "v", ""), (4, "w", "<p>"), (1, "u", html)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5
    assert [r.text for r in got if r.page_id == 1] == ["Big news\nFirst & bold words, here.\nSecond one <x> is longer than that."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3, 4))


def test_pipeline(spark, documents):
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9))) for _ in range(n))
    base = [prose(120) for _ in range(90)]
    item = " ".join(f"item{i}" for i in range(14))
    rows = list(enumerate(base)) + [(100, base[0]), (101, base[1] + " more"), (102, prose(60) + " " + item + " " + prose(60)), (103, "too short"), (104, None)]
    sf = documents(rows)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = linededup.written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        docs = out
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == {*range(90), 100, 101, 102} and kept[1] == kept[0] - {100}  # line dedup takes all of an exact copy
    assert kept[3] == kept[2] - {102} and set(range(90)) <= kept[3]
    assert corpus_pipeline.run(spark, sf).where("doc_id < 90").selectExpr("count(DISTINCT doc_id)").first()[0] == 90


def test_pipeline_keeps_one_of_each_group_of_copies(spark, documents):
    import corpus_pipeline

    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9))) for _ in range(n))
    base = [f"{prose(2)}\n{prose(60)}\n{prose(50)}\n{prose(1)}" if i % 2 else prose(120) for i in range(80)]
    short = "\n".join(prose(3) for _ in range(30))
    copies = [(100 + 10 * g + k, base[g] if k < 3 else base[g] + " more") for g in range(6) for k in range(4)]
    sf = documents([*enumerate(base), *copies, (200, short)])
    spark.createDataFrame([(0, "no such item " + prose(12))], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    for g in range(6):
        assert len(got & {g, *(i for i, _ in copies if (i - 100) // 10 == g)}) == 1
    assert set(range(6, 80)) <= got and 200 in got


@pytest.mark.parametrize(("words", "pairs"), [(1 << 18, 1 << 19), (5, 5), (0, 0)])
def test_scores_are_those_of_exact_counts(spark, documents, monkeypatch, words, pairs):
    """More distinct pairs than 2^20 hashed cells tell apart, whatever share of words and pairs is broadcast."""
    monkeypatch.setattr(lmscore, "HOT_WORDS", words)
    monkeypatch.setattr(lmscore, "HOT_PAIRS", pairs)
    rng = random.Random(21)
    many = 1_500_000 if pairs > 5 else 3_000
    rows = [(i, " ".join(f"w{rng.randrange(20000)}" if rng.random() < 0.9 else "the" for _ in range(many // 40))) for i in range(40)]
    rows += [(100, "the w1 The w1"), (100, "the w1 The w1"), (100, "w2"), (None, "w3 the w3"), (101, None), (102, "?!")]
    sf = documents(rows)
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{sf}/labels.parquet")
    tokens = [(d, re.findall("[a-z0-9]+", (t or "").lower())) for d, t in rows]
    counts = []
    for chosen in ([w for d, w in tokens if d is not None and d < 40 and d % 2], [w for _, w in tokens]):
        counts.append((Counter(x for w in chosen for x in w), Counter(p for w in chosen for p in zip(w, w[1:]))))
    vocabulary = len(counts[1][0])

    def mean(w, one, two):
        total, out = sum(one.values()), 0.0
        for a, b in zip([None, *w], w):
            share = 0.6 if one.get(a) else 0.0
            out -= np.log((share * two[a, b] / one[a] if share else 0.0) + (1 - share) * (one[b] + 0.5) / (total + 0.5 * vocabulary))
        return out / len(w)

    assert plain_rows(lmscore.op7(spark, sf)) == sql_rows(lmscore.SQL, sf)[1]
    want = sorted((str(d), len(w), *((round(mean(w, *c), 7) for c in counts) if w else (None, None))) for d, w in tokens)
    got = sorted((str(r.doc_id), r.n_tokens, *(None if x is None else round(x, 7) for x in (r.target_loss, r.background_loss))) for r in lmscore.op7(spark, sf).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == (pytest.approx(w[2:], abs=1e-6) if w[2] is not None else (None, None))


def test_pipeline_judges_rows_apart_from_ids(spark, documents):
    """A bad row takes no other row of its id with it, and a null id saves none; columns of any name pass through."""
    from orrery.llm import pipeline

    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9))) for _ in range(n))
    item = " ".join(f"item{i}" for i in range(14))
    rows = [(i, prose(120)) for i in range(70)] + [(5, "too short"), (None, "too short"), (None, prose(90)), (6, prose(60) + " " + item), (None, prose(60) + " " + item)]
    sf = documents(rows)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS `a.b`", "2 AS gone", "3 AS c0")
    for name, stage in pipeline.STAGES[:-1]:
        out = linededup.written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        docs = out
    assert Counter(r.doc_id for r in docs.collect()) == Counter([*range(70), None])


def test_no_temporary_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    assert common.scratch_path(session("local[4]"), "x").startswith("file:")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_path(session("spark://head:7077"), "x")
