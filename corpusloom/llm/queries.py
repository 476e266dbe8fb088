"""The pN_ queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import answers, clusters, language, leakage, packing, segment, splits
from corpusloom.session import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "proofs_primes")


def _filter(spark: SparkSession, sf_dir: str) -> language.LanguageFilter:
    return language.filter_from(_primes(spark, sf_dir), "line_no", "proof", "language")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_pairs(clusters.cluster_versions(_table(spark, sf_dir, "primes"), "row_idx", "proof"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_versions(_table(spark, sf_dir, "primes"), "row_idx", "proof")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "primes")
    members = clusters.cluster_versions(rows, "row_idx", "proof")
    direction = _primes(spark, sf_dir).where("direction is not null").groupBy("id").agg(F.lower(F.trim(F.min_by("direction", "line_no"))).alias("direction"))
    return clusters.describe_clusters(members, rows.select("row_idx", "id").join(direction, "id", "left").select("row_idx", "direction"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.truncation(_primes(spark, sf_dir)).where("truncated").select("line_no")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.truncation_rates(_primes(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.document_languages(_primes(spark, sf_dir), _filter(spark, sf_dir), "line_no", "proof", "language", "prompt")
    return rows.where("mixed or not label_right").select("line_no", "lang_found")


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(_primes(spark, sf_dir), _filter(spark, sf_dir), "line_no", "proof", "language", "prompt")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_segments(_primes(spark, sf_dir), _filter(spark, sf_dir), "line_no", "proof")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.defective_pairs(_primes(spark, sf_dir), _filter(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    techniques, shares = splits.read_dimensions(spark, sf_dir)
    return splits.keep_cells_together(_primes(spark, sf_dir), techniques, shares).where("relabelled").drop("relabelled", "split")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    techniques, shares = splits.read_dimensions(spark, sf_dir)
    return splits.keep_cells_together(_primes(spark, sf_dir), techniques, shares).drop("relabelled")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = splits.small_rows(_table(spark, sf_dir, "containers"), "capacity_tokens")[0][0]
    return packing.fill_containers(_table(spark, sf_dir, "documents"), capacity)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "eval_items").select("item_id", "text").orderBy("item_id")
    return leakage.leaked_items(_table(spark, sf_dir, "documents"), map(tuple, items.toLocalIterator()))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentence_units(_table(spark, sf_dir, "documents")).select("doc_id", "end_pos")


def p8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentence_units(_table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------
# what SQL can say of the results


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text with a letter: its rows, and the clusters they are in."""
    rows = _table(spark, sf_dir, "primes").select("row_idx", F.md5("proof").alias("text"), F.col("proof").rlike("[A-Za-z\\x{4e00}-\\x{9fff}]").alias("worded")).where("worded")
    members = clusters.cluster_versions(_table(spark, sf_dir, "primes"), "row_idx", "proof")
    return rows.join(members, "row_idx").groupBy("text").agg(F.count("*").alias("rows"), F.count_distinct("cluster").alias("clusters"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its records, and whether truncated and limit-bound ones are no more than these."""
    r = answers.truncation_rates(_primes(spark, sf_dir))
    return r.select("source", "records", ((F.col("truncated") <= F.col("records")) & (F.col("at_limit") <= F.col("truncated"))).alias("nested"))


def p4_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty answers among the empty ones, and rows with a defect beside an exclusive one."""
    found = p4_found(spark, sf_dir).groupBy("line_no").agg(F.collect_set("defect").alias("d"))
    exclusive = F.arrays_overlap("d", F.array(F.lit("empty"), F.lit("refusal"), F.lit("copied")))
    both = _primes(spark, sf_dir).select("line_no", F.coalesce(F.length("proof"), F.lit(0)).alias("n")).join(found, "line_no", "left")
    return both.agg(F.count_if((F.col("n") == 0) & F.array_contains("d", "empty")).alias("empty"), F.count_if(exclusive & (F.size("d") > 1)).alias("beside"))


def p5_torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records split, cells in more than one split, and whether each split is within 2 % of its share."""
    techniques, shares = splits.read_dimensions(spark, sf_dir)
    rows = splits.keep_cells_together(_primes(spark, sf_dir), techniques, shares)
    torn = rows.groupBy("technique", "style", "language").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn"))
    wanted = spark.createDataFrame(shares, "split string, share double").select("split", (F.col("share") / sum(x for _, x in shares)).alias("share"))
    near = rows.groupBy("split").agg(F.count("*").alias("n")).join(wanted, "split").agg(F.sum("n").alias("records"), F.max(F.abs(F.col("n") - F.col("share") * rows.count())).alias("off"))
    return near.join(F.broadcast(torn)).select("records", "torn", (F.col("off") <= 0.02 * F.col("records")).alias("near"))


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, containers over their capacity, documents whose pieces leave a gap or are split though they fit, and whether the containers are 95 % full."""
    capacity = splits.small_rows(_table(spark, sf_dir, "containers"), "capacity_tokens")[0][0]
    rows = stored(packing.fill_containers(_table(spark, sf_dir, "documents"), capacity))
    full = rows.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("overfull"), (F.sum("t") >= 0.95 * capacity * F.greatest(F.count("*") - 1, F.lit(0))).alias("well_filled"))
    whole = rows.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("last"), F.count("*").alias("k"))
    docs = whole.agg(F.count("*").alias("documents"), F.count_if((F.col("t") != F.col("last")) | (F.col("k") != F.ceil(F.col("t") / capacity))).alias("broken"))
    return docs.join(F.broadcast(full)).select("documents", "overfull", "broken", "well_filled")


def p7_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found leaks in which the document holds the item's text as it is."""
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    items = _table(spark, sf_dir, "eval_items").select("item_id", "text")
    return p7_found(spark, sf_dir).join(texts, "doc_id").join(items, "item_id").where(F.contains("whole", F.col("text"))).select("doc_id", "item_id")


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with units, units that overlap or are out of order, and letters outside of units."""
    other = r"[^\p{L}\p{N}]+"
    units = segment.sentence_units(_table(spark, sf_dir, "documents"))
    spans = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "start_pos", "end_pos"))).alias("u"))
    rows = spans.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    inside = F.aggregate("u", F.lit(0), lambda n, x: n + F.length(F.regexp_replace(F.substring(F.col("text"), x["start_pos"] + 1, x["end_pos"] - x["start_pos"]), other, "")))
    order = F.aggregate(F.arrays_zip(F.slice("u", F.lit(1), F.greatest(F.size("u") - 1, F.lit(0))).alias("a"), F.slice("u", 2, F.size("u")).alias("b")), F.lit(0), lambda n, z: n + F.when(z["a"]["end_pos"] > z["b"]["start_pos"], 1).otherwise(0))
    outside = F.length(F.regexp_replace("text", other, "")) - inside
    return rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum(order), F.lit(0)).alias("disorder"), F.coalesce(F.sum(outside), F.lit(0)).alias("outside"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_members, p1_clusters, p2_found, p2_rates, p3_found, p3_languages, p3_segments, p4_found, p5_found, p5_splits, p6_containers, p7_found, p7_leaks, p8_found, p8_units, p1_copies, p2_records, p4_exclusive, p5_torn, p6_filled, p7_verbatim, p8_cover)
    }


def oracle_sql() -> dict[str, str]:
    """The operators cannot be said in SQL; what must hold of their results can. They are tested against brute force besides."""
    return {
        "p1_copies": "SELECT md5(proof) AS text, count(*) AS rows, 1 AS clusters FROM primes WHERE regexp_matches(proof, '[A-Za-z\\x{4e00}-\\x{9fff}]') GROUP BY 1",
        "p2_records": "SELECT batch_id AS source, count(*) AS records, true AS nested FROM proofs_primes GROUP BY 1",
        "p4_exclusive": "SELECT count(*) FILTER (proof IS NULL OR proof = '') AS empty, 0 AS beside FROM proofs_primes",
        "p5_torn": "SELECT count(*) AS records, 0 AS torn, true AS near FROM proofs_primes WHERE lower(trim(arm)) = 'technique'",
        "p6_filled": "SELECT count(*) AS documents, 0 AS overfull, 0 AS broken, true AS well_filled FROM documents WHERE text <> ''",
        "p7_verbatim": "SELECT doc_id, item_id FROM documents d JOIN eval_items i ON contains(d.text, i.text)",
        "p8_cover": r"SELECT count(*) AS documents, 0 AS disorder, 0 AS outside FROM documents WHERE regexp_matches(text, '[^\s\x{00A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}\x0B\x1C-\x1F\x{85}]')",
    }
