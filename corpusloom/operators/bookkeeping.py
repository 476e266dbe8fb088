"""Design grid, prompts, resume, ingest and staleness of a generated corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import composite_id, fill_template, id_part, short_hash, strip_all

GRID_COLUMNS = ("id", "arm", "theorem", "technique", "direction", "language", "style", "sample_index")


def factor(spark: SparkSession, name: str, levels: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in levels], f"{name} string")


def default_record(df: DataFrame, **values: Column) -> DataFrame:
    """The grid columns, null unless given or present."""
    kinds = {"sample_index": "int"}
    cols = [values.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in GRID_COLUMNS]
    return df.select(*cols)


def _times(df: DataFrame, *others: DataFrame) -> DataFrame:
    # a full factorial is the product of its factors by definition; the factors are small dimensions
    for o in others:
        df = df.crossJoin(o)
    return df


def full_grid(spark: SparkSession, techniques: DataFrame, directions: DataFrame, languages: DataFrame, styles: DataFrame, targets: DataFrame, samples: int, scope_samples: int, own_theorem: str) -> DataFrame:
    """Technique x language x style x k, direction x language x k and target x language x k.

    The one-column frames `technique`, `direction`, `language`, `style`,
    `target` give the levels; an empty factor empties its arm. The target
    'centre' keeps the corpus' own theorem.
    """
    k = spark.range(samples).select(F.col("id").cast("int").alias("sample_index"))
    ks = spark.range(scope_samples).select(F.col("id").cast("int").alias("sample_index"))
    t = _times(techniques, languages, styles, k).withColumns({"id": composite_id(F.lit("t"), "technique", "language", "style", "sample_index"), "arm": F.lit("technique"), "theorem": F.lit(own_theorem)})
    x = _times(directions, languages, k).withColumns({"id": composite_id(F.lit("x"), "direction", "language", "sample_index"), "arm": F.lit("extreme"), "theorem": F.lit(own_theorem)})
    s = _times(targets, languages, ks).withColumns({"id": composite_id(F.lit("s"), "target", "language", "sample_index"), "arm": F.lit("scope"), "theorem": theorem_of("target", own_theorem)})
    return default_record(t).unionByName(default_record(x)).unionByName(default_record(s))


def theorem_of(target: str, own_theorem: str) -> Column:
    """The centre target means the corpus' own theorem."""
    return F.when(F.col(target) == "centre", F.lit(own_theorem)).otherwise(F.col(target))


def target_of(theorem: str, own_theorem: str) -> Column:
    """P6 inverse."""
    return F.when(F.col(theorem) == own_theorem, F.lit("centre")).otherwise(F.col(theorem))


def guard_ids(df: DataFrame, most: int = 64) -> DataFrame:
    """Fails the job at an id longer than `most`."""
    return df.withColumn("id", F.when(F.assert_true(F.col("id").isNull() | (F.length("id") <= most), F.lit(f"an id is longer than {most}")).isNull(), F.col("id")))


def render_prompts(df: DataFrame, templates: DataFrame, instructions: DataFrame, descriptions: DataFrame) -> DataFrame:
    """P5: prompt from the arm's template, the language's instruction and the design's description.

    `templates(arm, template)`, `instructions(language, instruction)`,
    `descriptions(arm, level, description)`; a missing part gives a null prompt
    instead of an error.
    """
    level = F.coalesce("technique", "direction", "theorem")
    out = df.withColumn("level", level).join(templates, "arm", "left").join(instructions, "language", "left").join(descriptions, ["arm", "level"], "left")
    return out.withColumn("prompt", fill_template("template", description="description", instruction="instruction")).drop("level", "template", "instruction", "description")


def requests(df: DataFrame, model: str, max_tokens: int) -> DataFrame:
    """One nested request per grid row, as JSON."""
    body = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"))
    return guard_ids(df).select(F.col("id").alias("custom_id"), F.to_json(body).alias("params"))


BLOCKS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))


def flatten_response(content: Column | str) -> Column:
    """The text blocks joined and stripped; empty for a response without text."""
    c = F.col(content) if isinstance(content, str) else content
    texts = F.transform(F.filter(c, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return strip_all(F.array_join(texts, ""))


def pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id is not done yet (left anti); null ids are kept."""
    return grid.join(done.select("id").distinct(), "id", "left_anti")


def first_collected(df: DataFrame, order: list[str]) -> DataFrame:
    """Ingest keeps the first collection of an id: a partial minimum per id, no sort of groups."""
    rest = [c for c in df.columns if c != "id"]
    key = F.struct(*order)
    return df.groupBy("id").agg(F.min_by(F.struct(*rest), key).alias("r")).select("id", *[F.col("r")[c].alias(c) for c in rest])


def attach_meta(results: DataFrame, meta: DataFrame) -> DataFrame:
    """Results with the request's labels by custom_id; unknown results are dropped."""
    return results.join(meta, results["custom_id"] == meta["id"]).drop("custom_id")


def ingest_counters(df: DataFrame) -> DataFrame:
    """Ok, err, truncated, tokens in and out. An empty table gives zeros."""
    ok = F.col("stop_reason").isNotNull() & (F.col("stop_reason") != "error")
    return df.agg(
        F.count_if(ok).alias("ok"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("err"),
        F.count_if(F.col("stop_reason") == "max_tokens").alias("truncated"),
        F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def other_settings(stored: DataFrame, model: str, effort: str) -> DataFrame:
    """model, effort, n: settings of stored records that differ from those of a run; null counts as different.

    A corpus that holds any must not be appended to, since it would mix the
    settings with every factor.
    """
    same = F.col("model").eqNullSafe(F.lit(model)) & F.col("effort").eqNullSafe(F.lit(effort))
    return stored.where(~same).groupBy("model", "effort").agg(F.count("*").alias("n"))


def guard_settings(stored: DataFrame, model: str, effort: str) -> None:
    """Refuses a corpus made with another model or effort."""
    found = other_settings(stored, model, effort).limit(1).collect()
    if found:
        raise ValueError(f"the corpus holds records of {found[0]['model']}, {found[0]['effort']}, not only of {model}, {effort}")


def stale_flags(stored: DataFrame, rendered: DataFrame) -> DataFrame:
    """Id, label, stale: the stored prompt differs from the rendered one or none can be rendered.

    `rendered(id, fresh_prompt)` holds one row per id; stored rows keep their number.
    """
    out = stored.join(rendered, "id", "left")
    return out.select(*stored.columns, (~F.col("prompt").eqNullSafe(F.col("fresh_prompt"))).alias("stale"))


def label() -> Column:
    """The first non-empty of direction, technique, theorem."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("direction", "technique", "theorem")])


def prompt_hashes(df: DataFrame, pattern: str) -> DataFrame:
    """Per direction and theorem the sorted set of short hashes of the criterion found in the prompt.

    The set is bounded by the distinct criteria, not by the rows.
    """
    criterion = F.regexp_extract("prompt", pattern, 1)
    return df.select("direction", "theorem", short_hash(criterion).alias("h")).distinct().groupBy("direction", "theorem").agg(F.sort_array(F.collect_list("h")).alias("hashes"))


def id_parts(df: DataFrame) -> DataFrame:
    """What an id spells out; null for opaque ids."""
    spelled = F.col("id").rlike("^[txs]__")
    return df.withColumns({"id_arm": F.when(spelled, id_part("id", 1)), "id_level": F.when(spelled, id_part("id", 2)), "id_language": F.when(spelled, id_part("id", 3))})
