"""Chat formatting: a hidden Markov model over the lines of a transcript, roles by Viterbi, then canonical turns.

A state is a role and whether the line begins a turn. A line is seen as a marker class (which speaker mark it starts
with, if any) and a few line features, taken as independent given the state. The probabilities are counted, with
smoothing, over lines whose roles are known. Transcripts may be long: they are cut into blocks, each block gives the
best score from every state before it to every state at its end, and these are joined along the transcript before the
blocks are traced back, so that no task needs a whole transcript and the path is that of plain Viterbi. Lines and
turns are numbered, and blocks joined, by spans of a transcript, with one row a span where a transcript's spans meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import written
from orrery.llm.words import mixed

ROLES = ["system", "user", "assistant"]
#: Speaker marks by role, in the ways that transcripts write them.
MARKS = {"system": ["System:", "SYSTEM:", "[system]", "### System:"], "user": ["User:", "Human:", "Q:", "[user]", "### User:"], "assistant": ["Assistant:", "AI:", "A:", "[assistant]", "### Assistant:"]}
#: Lines of a block, and blocks of a span.
BLOCK, SPAN = 512, 1024
#: Steps of a logarithm: scores are whole numbers, whose sums do not depend on how lines are put together.
UNIT = 1 << 40
#: Least steps that a line and a state set at random, so that of paths equally likely always the same is found.
TIE_BITS = 10
#: Lines after which scores are made small again: whole numbers of this size are exact.
EXACT = 16
#: Parts of the conversations: each is parsed by the model of the others, so that no line is parsed by its own counts.
FOLDS = 2
#: Lines that the marks' own meaning counts for, beside those that are counted.
PRIOR = 8
STATES = 2 * len(ROLES)  # role, and begins (even) or goes on (odd)
FEATURES = ("mark", "after_blank", "question", "size")
VALUES = {"mark": len(ROLES) + 1, "after_blank": 2, "question": 2, "size": 4}


def transcripts(turns: DataFrame) -> DataFrame:
    """Lines (conv_id, line, text, role, begins) of transcripts written from ``turns`` (conv_id, turn, role, text).

    A hash of the conversation picks how it writes marks; each eighth turn or so has a blank line before it and no
    mark. role and begins are the truth, for counting and for measuring; parsing does not read them.
    """
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int")
    marks = F.lit(None).cast("string")
    for role in ROLES:
        marks = F.when(F.col("role") == role, F.get(F.array(*map(F.lit, MARKS[role])), pick)).otherwise(marks)
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("mark")), F.lit(8)) == 0
    body = F.coalesce("text", F.lit(""))
    whole = F.when(marks.isNull() | bare, F.concat(F.lit("\n"), body)).otherwise(F.concat(marks, F.lit(" "), body))
    turns = _told_apart(turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text"))
    lines = turns.select("conv_id", "turn", "part", "role", F.posexplode(F.split(whole, "\n")).alias("k", "text"), F.when(marks.isNull() | bare, 1).otherwise(0).alias("first"))
    return lines.select("conv_id", "turn", "part", "k", "text", "role", (F.col("k") == F.col("first")).alias("begins"))


def _told_apart(turns: DataFrame) -> DataFrame:
    """Adds ``part``, by which rows of one conv_id and turn follow one another; equal rows are numbered where there are any."""
    equal = turns.groupBy("conv_id", "turn", F.xxhash64("role", "text").alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    if equal.isEmpty():
        return turns.withColumn("part", F.xxhash64("role", "text"))
    copies = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    copies = copies.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    return copies.withColumn("part", F.xxhash64("role", "text", "copy")).drop("copy")


def seen(lines: DataFrame) -> DataFrame:
    """Adds the marker class and line features; ``lines`` has conv_id, turn, part, k (its order) and text."""
    mark = F.lit(0)
    for i, role in enumerate(ROLES):
        any_ = F.lit(False)
        for m in MARKS[role]:
            any_ = any_ | F.col("text").startswith(m)
        mark = F.when(any_, i + 1).otherwise(mark)
    blank = F.trim("text") == ""
    size = F.when(blank, 0).when(F.length("text") < 40, 1).when(F.length("text") < 160, 2).otherwise(3)
    return lines.withColumns({"mark": mark, "question": F.col("text").rlike("\\?\\s*$").cast("int"), "size": size, "blank": blank})


@dataclass
class Model:
    """Log probabilities in steps: start by state, move from state to state, and one table a feature."""

    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]

    def scores(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        """By line and state; with the lines' numbers ties are broken."""
        out = sum(self.emit[f][:, columns[f]].T for f in FEATURES)
        if "line" in columns:
            place = columns["line"].astype(np.uint64)[:, None] * np.uint64(STATES) + np.arange(STATES, dtype=np.uint64)
            out = out + (mixed(place) >> np.uint64(64 - TIE_BITS)).astype(float)
        return out


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds line (from 0) and after_blank; a turn's lines are one task's at most, transcripts are not.

    Turns are sorted over the cluster into even chunks; a chunk numbers its own lines, and where its transcript begins
    before it, the chunks before (a row each) give what to start from.
    """
    ends = lines.groupBy("conv_id", "turn", "part").agg(F.count("*").alias("n"), F.max_by("blank", "k").alias("last_blank"))
    ends = written(ends.repartitionByRange("conv_id", "turn", "part").withColumn("chunk", F.spark_partition_id()), "ends")
    chunks = ends.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n"), F.max_by("last_blank", F.struct("turn", "part")).alias("last_blank"))
    over = Window.partitionBy("conv_id").orderBy("chunk")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.lag("last_blank").over(over).alias("start_blank"))
    w = Window.partitionBy("conv_id", "chunk").orderBy("turn", "part")
    own = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ends = ends.withColumns({"own": own, "own_blank": F.lag("last_blank").over(w)}).join(chunks, ["conv_id", "chunk"])
    ends = ends.select("conv_id", "turn", "part", (F.col("start") + F.col("own")).alias("base"), F.coalesce("own_blank", "start_blank", F.lit(False)).alias("carried"))
    inside = Window.partitionBy("conv_id", "turn", "part").orderBy("k")
    placed = lines.withColumn("after", F.lag("blank").over(inside)).withColumn("row", F.row_number().over(inside) - 1)
    placed = placed.join(ends, ["conv_id", "turn", "part"])
    return placed.withColumns({"line": F.col("base") + F.col("row"), "after_blank": F.coalesce("after", "carried").cast("int")}).drop("base", "row", "after", "carried")


def fit(lines: DataFrame) -> Model:
    """Counts over all numbered lines with role and begins."""
    states = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) * 2 - 2 + F.when(F.col("begins"), 0).otherwise(1)
    known = lines.where(F.col("role").isin(ROLES)).withColumn("state", states.cast("int"))
    previous = known.select("conv_id", (F.col("line") + 1).alias("line"), F.col("state").alias("previous"))
    moves = known.join(previous, ["conv_id", "line"], "left").groupBy("previous", "state").agg(F.count("*").alias("n")).collect()
    start, move = np.ones(STATES), np.ones((STATES, STATES))
    for r in moves:
        if r.previous is None:
            start[r.state] += r.n
        else:
            move[r.previous, r.state] += r.n
    emit = {f: np.ones((STATES, VALUES[f])) for f in FEATURES}
    # what is known before anything is counted: marks stand where their role begins, a role goes on or another begins
    for i in range(len(ROLES)):
        emit["mark"][2 * i, i + 1] += PRIOR
        emit["mark"][2 * i + 1, 0] += PRIOR
        move[2 * i : 2 * i + 2, 2 * i + 1] += PRIOR
        move[[s for s in range(STATES) if s // 2 != i], 2 * i] += PRIOR / 2
    for r in known.groupBy("state", *FEATURES).agg(F.count("*").alias("n")).collect():
        for f in FEATURES:
            emit[f][r.state, r[f]] += r.n
    steps = lambda n: np.rint(np.log(n / n.sum(-1, keepdims=True)) * UNIT)
    return Model(steps(start), steps(move), {f: steps(e) for f, e in emit.items()})


def _columns(rows: pa.Table) -> dict[str, np.ndarray]:
    return {f: rows.column(f).to_numpy() for f in (*FEATURES, "line")}


def _summary(model: Model, rows: pa.Table) -> np.ndarray:
    """Best score from each state before a block to each state at its end."""
    best = np.where(np.eye(STATES) > 0, 0.0, -np.inf)
    for t, s in enumerate(model.scores(_columns(rows))):
        best = (best[:, :, None] + model.move[None]).max(axis=1) + s
        if t % EXACT == 0:
            best -= best.max()
    return best - best.max()


def _trace(model: Model, rows: pa.Table, entry: np.ndarray, last: int | None) -> list[int]:
    """States of a block's lines, given the scores of the states before it and the state at its end (else the best one)."""
    score, back = entry, []
    for t, s in enumerate(model.scores(_columns(rows))):
        step = score[:, None] + (model.move if t or rows.column("block")[0].as_py() else np.where(np.eye(STATES) > 0, model.start[None], -np.inf))
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + s
        if t % EXACT == 0:
            score -= score.max()
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1]


def fold_of(conv_id: str = "conv_id") -> Column:
    return F.pmod(F.xxhash64(conv_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


def parse(lines: DataFrame, models: Model | list[Model]) -> DataFrame:
    """(conv_id, line, text, role, begins) by Viterbi, for numbered lines with features, which should be a table.

    With several models a conversation is parsed by that of its fold.
    """
    models = models if isinstance(models, list) else [models]
    fold = fold_of() if len(models) == FOLDS else F.lit(0)
    blocks = lines.select("conv_id", "line", "text", *FEATURES, F.floor(F.col("line") / BLOCK).alias("block"), fold.alias("fold"))

    def summary(rows: pa.Table) -> pa.Table:
        rows, model = rows.sort_by("line"), models[rows.column("fold")[0].as_py()]
        block = rows.column("block")[0].as_py()
        if block == 0:
            emitted = model.scores(_columns(rows.slice(0, 1)))[0]
            first = np.where(np.eye(STATES) > 0, model.start + emitted, -np.inf)
            rest = _summary(model, rows.slice(1))
            best = (first[:, :, None] + rest[None]).max(axis=1)
            best -= best.max()
        else:
            best = _summary(model, rows)
        return pa.table({"conv_id": rows.column("conv_id").slice(0, 1), "block": pa.array([block]), "best": pa.array([best.ravel().tolist()])})

    def matrices(rows: pa.Table) -> list[np.ndarray]:
        return [np.array(b).reshape(STATES, STATES) for b in rows.column("best").to_pylist()]

    def product(rows: pa.Table) -> pa.Table:
        """Of a span what a block has: the best score from each state before it to each at its end."""
        rows = rows.sort_by("block")
        first, *rest = matrices(rows)
        for b in rest:
            first = (first[:, :, None] + b[None]).max(axis=1)
            first -= first.max()
        return pa.table({"conv_id": rows.column("conv_id").slice(0, 1), "span": rows.column("span").slice(0, 1), "best": pa.array([first.ravel().tolist()])})

    def joined(rows: pa.Table, order: str, entry: np.ndarray, last: int | None) -> tuple[pa.Table, list[np.ndarray], list[int]]:
        """Scores of the states before each row and the state at its end, rows in order; without ``last`` the best one."""
        rows = rows.sort_by(order)
        best, entries = matrices(rows), [entry]
        for b in best:
            entries.append((entries[-1][:, None] + b).max(axis=0))
            entries[-1] -= entries[-1].max()
        ends = [int(entries[-1].argmax()) if last is None else last]
        for e, b in zip(reversed(entries[1:-1]), reversed(best[1:]), strict=True):
            ends.append(int((e + b[:, ends[-1]]).argmax()))
        return rows, entries[:-1], ends[::-1]

    def over_spans(rows: pa.Table) -> pa.Table:
        rows, entries, ends = joined(rows, "span", np.zeros(STATES), None)
        ends[-1] = None  # the last span finds its end itself
        return pa.table({"conv_id": rows.column("conv_id"), "span": rows.column("span"), "before": pa.array([e.tolist() for e in entries]), "end": pa.array(ends, pa.int32())})

    def over_blocks(rows: pa.Table) -> pa.Table:
        rows, entries, ends = joined(rows, "block", np.array(rows.column("before")[0].as_py()), rows.column("end")[0].as_py())
        return pa.table({"conv_id": rows.column("conv_id"), "block": rows.column("block"), "entry": pa.array([e.tolist() for e in entries]), "last": pa.array(ends, pa.int32())})

    def trace(rows: pa.Table) -> pa.Table:
        rows, model = rows.sort_by("line"), models[rows.column("fold")[0].as_py()]
        states = _trace(model, rows, np.array(rows.column("entry")[0].as_py() or [0.0] * STATES), rows.column("last")[0].as_py())
        return pa.table({"conv_id": rows.column("conv_id"), "line": rows.column("line"), "text": rows.column("text"), "role": [ROLES[s // 2] for s in states], "begins": [s % 2 == 0 for s in states]})

    # a transcript of one block needs nothing from others; that of several has a line of this number, once
    several = lines.where(F.col("line") == BLOCK).select("conv_id")
    sums = blocks.join(several, "conv_id", "left_semi").groupBy("conv_id", "block").applyInArrow(summary, "conv_id long, block long, best array<double>")
    sums = written(sums.withColumn("span", F.floor(F.col("block") / SPAN)), "blocks")
    spans = sums.groupBy("conv_id", "span").applyInArrow(product, "conv_id long, span long, best array<double>")
    spans = spans.groupBy("conv_id").applyInArrow(over_spans, "conv_id long, span long, before array<double>, end int")
    ends = sums.join(spans, ["conv_id", "span"]).groupBy("conv_id", "span").applyInArrow(over_blocks, "conv_id long, block long, entry array<double>, last int")
    return blocks.join(ends, ["conv_id", "block"], "left").groupBy("conv_id", "block").applyInArrow(trace, "conv_id long, line long, text string, role string, begins boolean")


def _unmarked(text: Column) -> Column:
    longest = sorted((m for ms in MARKS.values() for m in ms), key=len, reverse=True)
    out = text
    for m in reversed(longest):
        out = F.when(text.startswith(m), F.ltrim(F.substr(text, F.lit(len(m) + 1)))).otherwise(out)
    return out


def _turns(parsed: DataFrame) -> DataFrame:
    """Adds turn (from 0): a line that begins one, or has another role than the line before, starts the next.

    Blocks count their own starts; a block's first line meets the last one of the block before; the starts of the blocks
    before are summed by spans, and those of spans by transcripts.
    """
    lines = written(parsed.withColumn("block", F.floor(F.col("line") / BLOCK)), "parsed")
    up = Window.partitionBy("conv_id", "block").orderBy("line")
    lines = lines.withColumn("starts", F.col("begins") | (F.col("role") != F.lag("role").over(up)))
    first = F.min(F.struct("line", "begins", "role"))
    inner = F.sum(F.when(F.col("line") % BLOCK > 0, F.col("starts").cast("long")).otherwise(0))
    blocks = written(lines.groupBy("conv_id", "block").agg(first.alias("first"), F.max(F.struct("line", "role")).alias("last"), inner.alias("inner")), "starts")
    before = blocks.select("conv_id", (F.col("block") + 1).alias("block"), F.col("last.role").alias("previous"))
    starts = F.col("first.begins") | F.col("previous").isNull() | (F.col("first.role") != F.col("previous"))
    blocks = blocks.join(before, ["conv_id", "block"], "left").select("conv_id", "block", "inner", starts.cast("long").alias("own"), F.floor(F.col("block") / SPAN).alias("span"))
    n = F.col("own") + F.col("inner")
    below = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    spans = blocks.groupBy("conv_id", "span").agg(F.sum(n).alias("n"))
    spans = spans.select("conv_id", "span", F.coalesce(F.sum("n").over(below("conv_id").orderBy("span")), F.lit(0)).alias("so_far"))
    inside = F.coalesce(F.sum(n).over(below("conv_id", "span").orderBy("block")), F.lit(0))
    blocks = blocks.withColumn("inside", inside).join(spans, ["conv_id", "span"]).select("conv_id", "block", "own", (F.col("inside") + F.col("so_far")).alias("base"))
    numbered = lines.join(blocks, ["conv_id", "block"])
    starts = F.when(F.col("line") % BLOCK == 0, F.col("own")).otherwise(F.col("starts").cast("long"))
    return numbered.withColumn("turn", F.col("base") + F.sum(starts).over(up.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("block", "starts", "own", "base")


def rendered(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, canonical) from parsed lines: turns numbered from 0, marks cut, text trimmed."""
    turns = _turns(parsed)
    body = F.when(F.col("begins"), _unmarked(F.col("text"))).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", body.alias("t")))), lambda x: x["t"]), "\n")
    out = turns.groupBy("conv_id", "turn").agg(F.max_by("role", "line").alias("role"), F.regexp_replace(text, "^\\s+|\\s+$", "").alias("text"))
    return out.withColumn("canonical", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>")))


def format_chats(turns: DataFrame) -> DataFrame:
    """Canonical turns of the transcripts of ``turns`` (conv_id, turn, role, text).

    Rows without conv_id or turn belong to no transcript; a null or unknown role writes no mark; a null text is an
    empty line; rows of one turn follow one another whole, in the order of a hash, equal ones too; extra columns are
    ignored; an empty table gives none. A conversation is parsed by a model that was
    counted on others; marks have a prior of PRIOR lines, which alone speaks where there are no others. Of paths that
    are equally likely one is taken by a hash of lines' numbers and states.
    """
    lines = written(_numbered(seen(transcripts(turns))), "transcripts")
    return rendered(parse(lines, [fit(lines.where(fold_of() != f)) for f in range(FOLDS)]))


def op8(spark, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, written as a transcript and parsed."""
    turns = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turns.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), F.sha2("canonical", 256).alias("sha256"))
