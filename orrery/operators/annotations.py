"""Annotation records brought to one schema, filtered and checked for their files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text

#: Everything that a raw record may have; what a source lacks is null.
RAW = dict.fromkeys("scene_id scene_name video question raw_question prompt ground_truth answer solution data_path data_source dataset question_type question_id".split(), "string")
RAW |= dict.fromkeys("image answers answer_labels options".split(), "array<string>")
RAW["conversations"] = "array<struct<from: string, value: string>>"
#: First words that name a question type.
FIRST_WORDS = ["What", "Is", "How", "Can", "Which"]


def completed(rows: DataFrame) -> DataFrame:
    """``rows`` with every column of RAW, absent ones null."""
    return rows.select(*rows.columns, *[F.lit(None).cast(kind).alias(name) for name, kind in RAW.items() if name not in rows.columns])


def _path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def _stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(_path(c), "/"), -1), r"(?<=.)\.[^.]*$", "")


def scene_id() -> Column:
    """The record's scene: named, or from the first image's name or folder, or the video's stem."""
    first = F.try_element_at("image", F.lit(1))
    code = F.regexp_extract(first, r"(scene\d{4}_\d{2})", 1)
    parts = F.split(_path(first), "/")
    from_image = F.when(code != "", code).when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "images"), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return F.coalesce("scene_id", "scene_name", from_image, _stem(F.col("video")))


def answers() -> Column:
    """Answers given, else from turns, ground truth, a single answer, its labels, or the solution's tag."""
    turns = F.transform(F.filter("conversations", lambda c: c["from"] == "gpt"), lambda c: F.coalesce(c["value"], F.lit("")))
    labels = F.filter(F.transform("answer_labels", lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(
        F.col("answers"),
        F.when(F.col("question").isNull(), turns),
        F.when(F.col("ground_truth").isNotNull(), F.array("ground_truth")),
        F.when(F.col("answer").isNotNull(), F.array("answer")),
        F.when(F.size(labels) > 0, F.array(F.array_join(labels, ", "))),
        F.when(F.col("solution").isNotNull(), F.array(text.answer_tag(F.col("solution")))),
    )


def question() -> Column:
    """The question, the first human turn without media tags, or the prompt; options follow on lines of their own."""
    human = F.get(F.filter("conversations", lambda c: c["from"] == "human"), F.lit(0))["value"]
    asked = F.coalesce("question", F.when(F.col("conversations").isNotNull(), text.without_media(F.coalesce(human, F.lit("")))), F.trim("prompt"))
    lettered = F.forall("options", lambda o: F.trim(o).rlike(r"^[A-Za-z][.|)]\s"))
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    made = F.when(lettered, F.col("options")).otherwise(F.transform("options", lambda o, i: F.concat(F.lit("("), F.get(letters, i), F.lit(") "), o)))
    return F.when((F.size("options") > 0) & (asked != ""), F.concat(asked, F.lit("\n"), F.array_join(made, "\n"))).otherwise(asked)


def question_type(asked: Column) -> Column:
    """The type given, unless N/A; else the question's first word if it is one of FIRST_WORDS, else Others."""
    words = F.filter(F.split(F.coalesce(F.nullif("raw_question", F.lit("")), asked), r"\s+"), lambda w: w != "")
    first = F.initcap(F.lower(F.get(words, F.lit(0))))
    derived = F.when(first.isin(FIRST_WORDS), first).otherwise("Others")
    return F.when(F.col("question_type").isNull() | (F.col("question_type") == "N/A"), derived).otherwise(F.col("question_type"))


def normalized(rows: DataFrame, path_map: Mapping[str, str] | None = None) -> DataFrame:
    """scene_id, question, answers, data_path, question_type, question_id of raw records."""
    raw = completed(rows)
    parts = F.split(_path(F.col("video")), "/")
    source = F.coalesce(F.nullif("data_source", F.lit("")), F.nullif("dataset", F.lit("")), F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))))
    paths = F.lit(None).cast("string")
    for name, path in (path_map or {}).items():
        paths = F.when(source == name, path).otherwise(paths)
    asked = question()
    return raw.select(scene_id().alias("scene_id"), asked.alias("question"), answers().alias("answers"), F.coalesce("data_path", paths).alias("data_path"), question_type(asked).alias("question_type"), "question_id")


def usable(rows: DataFrame, required: Sequence[str] = ("scene_id", "question", "data_path")) -> DataFrame:
    return rows.na.drop(subset=list(required))


def of_types(rows: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    kept = rows.where(F.col("question_type").isin(list(include))) if include else rows
    return kept.where(~F.coalesce(F.col("question_type").isin(list(exclude)), F.lit(False))) if exclude else kept


def available(rows: DataFrame, roots: DataFrame, scenes: DataFrame, images: DataFrame) -> DataFrame:
    """``rows`` with the reason why files are missing, null where all are there.

    ``roots`` (data_path), ``scenes`` (data_path, scene_id) and ``images`` (the same) are listings.
    """
    marked = rows.join(roots.select("data_path").distinct().withColumn("__r", F.lit(1)), "data_path", "left")
    marked = marked.join(scenes.select("data_path", "scene_id").distinct().withColumn("__s", F.lit(1)), ["data_path", "scene_id"], "left")
    marked = marked.join(images.select("data_path", "scene_id").distinct().withColumn("__i", F.lit(1)), ["data_path", "scene_id"], "left")
    reason = F.when(F.col("__r").isNull(), F.concat(F.lit("missing_root:"), F.col("data_path"))).when(F.col("__s").isNull(), F.concat(F.lit("missing_scene_dir:"), F.col("scene_id"))).when(F.col("__i").isNull(), F.concat(F.lit("missing_images:"), F.col("scene_id")))
    return marked.select(*rows.columns, reason.alias("reason"))


def split_questions(questions: DataFrame, answers_: DataFrame) -> DataFrame:
    """Questions (array ``questions``) with answers (array ``annotations``) by id; the last of a repeated id counts."""
    from orrery.operators.joins import lookup

    q = questions.select(F.explode("questions").alias("q")).select(F.col("q.question_id").cast("string").alias("question_id"), "q.scene_id", "q.situation", "q.question")
    a = answers_.select(F.posexplode("annotations").alias("pos", "a"))
    a = a.select(F.col("a.question_id").cast("string").alias("question_id"), F.transform("a.answers", lambda x: x["answer"]).alias("answers"), F.col("a.question_type").alias("question_type"), "pos")
    joined = lookup(q, a, ["question_id"], "pos").drop("pos")
    raw = F.col("question")
    asked = F.when(F.coalesce("situation", F.lit("")) != "", F.concat("situation", F.lit(" "), raw)).otherwise(raw)
    return joined.select("question_id", "scene_id", asked.alias("question"), raw.alias("raw_question"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), "question_type")


def registry_name(name: Column) -> Column:
    """(base, weight, percent) of ``base@weight`` or ``base%percent``."""
    weight, percent = F.regexp_extract(name, r"@([\d.]+)$", 1), F.regexp_extract(name, r"%(\d+)$", 1)
    base = F.regexp_replace(name, r"(@[\d.]+|%\d+)$", "")
    return F.struct(base.alias("base"), F.when(weight != "", weight.cast("double")).alias("weight"), F.when(percent != "", percent.cast("int")).alias("percent"))


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with different columns; what a frame lacks is null."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole


def stripped(rows: DataFrame, internal: Sequence[str] = ()) -> DataFrame:
    """Without internal columns and those that begin with an underscore."""
    return rows.drop(*[c for c in rows.columns if c in internal or c.startswith("_")])


def image_folder(name: Column, base: str) -> Column:
    return name.rlike(rf"^{base}(?:_\d+x\d+)?$")


def effective_size(width: Column, height: Column, most: tuple[int, int] | None, cap: bool) -> Column:
    """Size (width, height) at which a frame is read: scaled to fit ``most``, under ``cap`` never upwards."""
    if most is None:
        return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    scale = F.least(most[0] / width, most[1] / height)
    scale = F.least(scale, F.lit(1.0)) if cap else scale
    return F.struct(*[F.greatest(F.bround(c * scale).cast("int"), F.lit(1)).alias(n) for c, n in ((width, "width"), (height, "height"))])


def sized(scenes: DataFrame, wanted: tuple[int, int], policy: str = "exact", fallback: str = "error", most: tuple[int, int] | None = None) -> DataFrame:
    """``scenes`` (width, height of the frames found) with ``effective`` and whether it is a ``mismatch`` with ``wanted``.

    Policy ``cap`` takes ``wanted`` for a ceiling and nothing for a mismatch. Policy ``exact`` fails at the first other
    size, marks it where ``fallback`` is ``warn``, and looks at none where it is ``off``. A scene of unknown size is none.
    """
    if policy not in ("exact", "cap") or fallback not in ("error", "warn", "off"):
        raise ValueError(f"no policy {policy} with fallback {fallback}")
    width, height = F.col("width"), F.col("height")
    other = F.coalesce((width != wanted[0]) | (height != wanted[1]), F.lit(False))
    if policy == "cap" or fallback == "off":
        mismatch = F.lit(False)
    elif fallback == "warn":
        mismatch = other
    else:
        said = F.concat(F.lit(f"frames are not {wanted[0]}x{wanted[1]} but "), width.cast("string"), F.lit("x"), height.cast("string"))
        mismatch = F.when(other, F.raise_error(said).cast("boolean")).otherwise(False)
    return scenes.withColumns({"effective": effective_size(width, height, most, policy == "cap"), "mismatch": mismatch})


def sizes_achieved(checked: DataFrame) -> DataFrame:
    """Scenes and mismatches for each size found and the effective one."""
    return checked.where("width IS NOT NULL AND height IS NOT NULL").groupBy("width", "height", "effective").agg(F.count("*").alias("scenes"), F.count_if("mismatch").alias("mismatches"))


def template_question(label: Column, key: Column, templates: Sequence[str]) -> Column:
    """One of the templates, by a hash of ``key``, with the label in place of {}."""
    from orrery.operators.sampling import draw

    pick = F.get(F.array(*map(F.lit, templates)), (draw(key) % len(templates)).cast("int"))
    return F.replace(pick, F.lit("{}"), label)


def task_mix(names: str) -> list[tuple[str, int]]:
    """Tasks of a comma list; how often one is named is its weight."""
    counts: dict[str, int] = {}
    for name in filter(None, (n.strip() for n in names.split(","))):
        counts[name] = counts.get(name, 0) + 1
    return list(counts.items())


def substituted(tasks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tasks (task, weight) renamed by ``mapping`` (task, real); a task without a name is an error."""
    joined = tasks.join(mapping, "task", "left")
    return joined.select(F.coalesce("real", F.raise_error(F.concat(F.lit("no counterpart of "), F.col("task"))).cast("string")).alias("task"), "weight")
