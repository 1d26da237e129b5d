"""Pages, batches and sets that used to crash, stall or lose rows."""

import itertools
import random
import time

import numpy as np
import pytest

from orrery.llm import htmltext, linededup, lmscore, neardup

PIECES = ["<", ">", "</", "/>", "<!--", "-->", "<![", "]]>", "<!", "<?", "&", "&#", "&#x", ";", "'", '"', "=", " ", "\n", "p", "div", "<p>", "<b>", "a", "title='", "<script>", "</script>", "<!doctype", "[CDATA[", "é", "\0", "&amp", "&#0;", "&#99999999999999999999;", "<select>", "<option>", "</p>", "<table><tr><td>"]


def test_no_odd_page_is_an_error():
    rng = random.Random(8)
    for _ in range(50_000):
        for text, features in htmltext.blocks("".join(rng.choices(PIECES, k=rng.randrange(1, 25)))):
            assert text == " ".join(text.split()) and features


@pytest.mark.parametrize("piece", ["<a ", "<p title='", "<!--", "<![", "<p a=\"'", "</", "<script>", "&#99999999", "<a href=x ", "<p x=", "<!-- -", "</script"])
def test_unclosed_markup_takes_linear_time(piece):
    def took(n):
        began = time.process_time()
        htmltext.blocks(piece * n)
        return time.process_time() - began

    assert took(100_000) < 40 * max(took(10_000), 0.02)


@pytest.mark.parametrize(
    "html,texts",
    [("<!-- x", []), ("<![foo[ x ]]>y", ["y"]), ("<![ <p>x", ["x"]), ("<!-->a", ["a"]), ("a < b", ["a < b"]), ("<p>x<p title='y>z", ["x"]), ("<p>x</p><script>y", ["x"]), ("&#" + "9" * 6000 + ";x", ["�x"]), ("<P CLASS=a>x</P>y", ["x", "y"])],
)
def test_malformed_markup(html, texts):
    assert [t for t, _ in htmltext.blocks(html)] == texts


def test_decoding_against_enumeration():
    rng = np.random.default_rng(2)
    field = htmltext.Field(rng.normal(size=(len(htmltext.FEATURES), 2)), rng.normal(size=(2, 2)))
    for _ in range(40):
        rows = [list(rng.choice(len(htmltext.FEATURES), 4, replace=False)) for _ in range(rng.integers(1, 9))]

        def score(path, rows=rows):
            return sum(field.state[r, y].sum() for r, y in zip(rows, path, strict=True)) + sum(field.move[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert [int(x) for x in field.decode(rows)] == list(best)


def test_many_short_rows_of_a_batch():
    """More rows than 16 bits number in one batch: each pack numbers its own."""
    import pyarrow as pa

    n = 150_000
    batch = pa.RecordBatch.from_arrays([pa.array(["a b"] * n), pa.array(range(n)), pa.array(range(n)), pa.array([False] * n)], names=["text", "doc_id", "key", "good"])
    packs = list(lmscore._packs(iter([batch])))
    assert max(len(p.n) for p in packs) < 1 << 16
    assert np.concatenate([p.doc_id.to_numpy() for p in packs]).tolist() == list(range(n))
    assert sum(len(p.word) for p in packs) == 2 * n


def test_scores_whatever_the_batch(spark, tmp_path):
    spark.range(80_000, numPartitions=1).selectExpr("id AS doc_id", "concat('w', id % 97, ' w', id % 31, ' w', id % 7) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 80_000, 3).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    for size in ("10000", "200000"):
        spark.conf.set(name, size)
        try:
            seen.append(sorted(map(str, lmscore.op7(spark, str(tmp_path)).where("doc_id % 1000 = 0").collect())))
        finally:
            spark.conf.set(name, before)
    assert len(seen[0]) == 80 and seen[0] == seen[1]


def test_no_pair_at_the_threshold_is_lost_by_its_estimate():
    """100,000 pairs of sets exactly 0.8 alike, of 3 to 5,000 shingles: none is given up unseen."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    lost = pairs = 0
    for n, times in ((4, 40_000), (8, 20_000), (20, 15_000), (80, 15_000), (400, 8_000), (1000, 1_500), (4000, 500)):
        for low in range(0, times, 500):
            rows = {c: [] for c in ("a", "b", "sx", "sy", "rx", "ry")}
            for k in range(low, min(low + 500, times)):
                whole = np.unique(rng.integers(0, 2**63, n + n // 4 + 8, dtype=np.uint64))[: n + n // 4]
                x, y = np.sort(rng.permutation(whole)[:n]), whole
                for c, v in zip(rows, (k, k, x.tobytes(), y.tobytes(), *(b"" if 2 * len(whole) <= neardup.EXACT else neardup.registers(s).tobytes() for s in (x, y))), strict=True):
                    rows[c].append(v)
            (batch,) = neardup._confirmed(iter([pa.RecordBatch.from_pydict(rows)]), 80)
            lost += batch.column("linked").to_pylist().count(False)
            pairs += batch.num_rows
    assert pairs == 100_000 and lost == 0


def test_cutting_many_lines_is_linear(spark, documents):
    def took(n):
        lines = [f"line number {chr(97 + k % 26)}{k} of this very long text" for k in range(n)]
        sf = documents([(1, "\n".join(lines)), (2, "\n".join(lines[::2] + ["an own line of the second"]))], f"d{n}")
        docs = spark.read.parquet(f"{sf}/d{n}.parquet")
        cut = linededup.drops(docs.select("doc_id", "text")).cache()
        cut.count()
        began = time.perf_counter()
        out = {r.doc_id: r for r in linededup.without_lines(docs).collect()}
        return time.perf_counter() - began, out

    small, _ = took(4_000)
    large, out = took(40_000)
    assert large < 10 * max(small, 2)
    assert out[1]["__lines"] == 40_000 and out[2]["text"].endswith("an own line of the second")
    assert all(len(r["text"].split("\n")) == r["__lines"] - len(r["__dropped"]) for r in out.values())
