"""Truncated texts and defective prompt-response pairs.

Truncation: the length of every text is recomputed under several encodings
(code points, UTF-8 bytes, UTF-16 units, entity-escaped, JSON-escaped,
JSON-escaped in ASCII, CRLF lines), before what transfer put behind it. Per
source and encoding, a length at which texts pile up far above the lengths
around it is a hidden storage limit, if most of those texts end cut. Every
ending is then inspected; an ending that may be whole or cut (a dot that may
stand inside a number) is decided by how all texts go on behind such a number,
and else by the limit.

Pairs: see `records` for empty, refusing and copying answers; the language is
compared with the one the prompt asks for.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import endings, language, records
from corpusloom.session import stored

ENCODINGS = ("chars", "utf8", "utf16", "html", "json", "json_ascii", "crlf")


def encoded_lengths(text: str) -> list[int]:
    """The text's length under each of ENCODINGS."""
    n = len(text)
    crlf = n + text.count("\n") - text.count("\r\n")
    escaped = n + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * (text.count('"') + text.count("'"))
    ascii_json = len(json.dumps(text)) - 2
    if text.isascii():
        return [n, n, n, escaped, ascii_json, ascii_json, crlf]
    return [n, len(text.encode("utf-8", "surrogatepass")), len(text.encode("utf-16-le", "surrogatepass")) // 2, escaped, len(json.dumps(text, ensure_ascii=False)) - 2, ascii_json, crlf]


#: Share of all decimals that a context must hold to be kept, so at most 1 / DECIMAL_SHARE contexts are sent to the workers.
DECIMAL_SHARE = 1e-5


def decimal_contexts(df: DataFrame, text_col: str, least: int = 8, share: float = 0.95) -> frozenset[str]:
    """Contexts (the words before a number) in which numbers with a dot behind go on in `share` of all cases, over all texts.

    Counts are added up per batch, then per context; a context must hold
    DECIMAL_SHARE of all decimals, which bounds their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(endings.number_contexts(text))
            names = sorted({c for c, _ in counts})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[c, True] for c in names], pa.int64()), pa.array([counts[c, False] for c in names], pa.int64())], names=["context", "goes_on", "ends"])

    counted = df.select(df[text_col].cast("string").alias("text")).mapInArrow(run, "context string, goes_on long, ends long").groupBy("context").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    counted = stored(counted.where(F.col("goes_on") >= least))
    total = counted.agg(F.sum("goes_on")).first()[0] or 0
    kept = counted.where((F.col("goes_on") >= DECIMAL_SHARE * total) & (F.col("goes_on") >= share * (F.col("goes_on") + F.col("ends"))))
    return frozenset(r["context"] for r in kept.select("context").limit(int(1 / DECIMAL_SHARE) + 1).collect())


def assess(df: DataFrame, id_col: str, text_col: str, prompt_col: str, source_col: str, table: language.LanguageFilter | None = None) -> DataFrame:
    """One row per record: id, source, nature, ends (0 whole, 1 cut, 2 unsure), lengths, other_language.

    `nature` is 'empty', 'refusal', 'copied' or 'content'. With a language
    filter, `other_language` tells that no whole sentence outside quotations is
    in the language the prompt asks for. `lengths` are those before debris. Null texts are empty, null prompts ask
    for nothing. A narrow map; equal rows give equal rows.
    """
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            T.StructField("source", T.StringType()),
            T.StructField("nature", T.StringType()),
            T.StructField("ends", T.IntegerType()),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("other_language", T.BooleanType()),
        ]
    )

    decimal = decimal_contexts(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, prompts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            natures = [records.nature(t, p) for t, p in zip(texts, prompts)]
            ends, lengths = [], []
            for text, kind in zip(texts, natures):
                if kind == "content":
                    code, marked = endings.ending(text, decimal)
                    ends.append(endings.CUT if marked and code == endings.UNSURE else code)
                else:
                    ends.append(endings.WHOLE)
                lengths.append(encoded_lengths(endings.before_debris(text)) if text and kind == "content" else None)
            other = [False] * len(texts)
            if table is not None:
                spoken = language.speak([t if k == "content" else None for t, k in zip(texts, natures)], prompts, table)
                for i, (p, s) in enumerate(zip(prompts, spoken)):
                    asked = language.asked_language(p)
                    if asked in table.languages and s.spans:
                        said = s.counts() or {lang: 1 for lang in s.found()}
                        other[i] = bool(said) and asked not in said
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(natures), pa.array(ends, pa.int32()), pa.array(lengths, pa.list_(pa.int32())), pa.array(other)], names=schema.names)

    return df.select(df[id_col], df[source_col].cast("string"), df[text_col].cast("string"), df[prompt_col].cast("string")).mapInArrow(run, schema)


#: Lengths that one task of the search for limits looks at.
BLOCK = 4096


def storage_limits(assessed: DataFrame, around: int = 25, times: float = 6.0, least: int = 6, cut_share: float = 0.6) -> DataFrame:
    """Hidden limits: source, encoding, length, records, cut.

    Texts of a source that share one encoded length count as piled up when they
    are at least `least` and `times` the mean count of the lengths within
    `around`, and as a limit when `cut_share` of them end cut. The counts are
    pre-aggregated per source, encoding and length before the window, so a hot
    source costs its distinct lengths, not its rows.
    """
    long = assessed.where("nature = 'content' and lengths is not null").select("source", "ends", F.posexplode("lengths").alias("encoding", "length"))
    piles = long.groupBy("source", "encoding", "length").agg(F.count("*").alias("records"), F.count_if(F.col("ends") == 1).alias("cut"))
    # blocks of lengths overlap by what is looked at, so none is judged from one side
    block = F.floor(F.col("length") / BLOCK)
    blocks = F.array_distinct(F.array(*(F.floor((F.col("length") + k) / BLOCK) for k in (0, -around, around))))
    near = Window.partitionBy("source", "encoding", "block").orderBy("length").rangeBetween(-around, around)
    return (
        piles.withColumn("block", F.explode(blocks))
        .withColumn("density", (F.sum("records").over(near) - F.col("records")) / F.lit(2 * around))
        .where(F.col("block") == block)
        .where((F.col("records") >= least) & (F.col("records") >= times * F.greatest(F.col("density"), F.lit(0.5))) & (F.col("cut") >= cut_share * F.col("records")))
        .select("source", "encoding", "length", "records", "cut")
    )


def _verdicts(assessed: DataFrame) -> DataFrame:
    """assessed with `truncated`, `limit_encoding`, `limit_length`.

    A record meets a limit when its length is the limit: one that lost blanks
    behind a dot to it ended there. Of the limits met, the one with most records is named.
    """
    kept = stored(assessed)
    limits = storage_limits(kept)
    by_source = limits.groupBy("source").agg(F.collect_list(F.struct("records", "encoding", "length")).alias("limits"))
    joined = kept.join(by_source.withColumnRenamed("source", "limit_source"), F.col("source").eqNullSafe(F.col("limit_source")), "left")
    met = F.array_max(F.filter("limits", lambda x: F.get("lengths", x["encoding"]) == x["length"]))
    names = F.array(*map(F.lit, ENCODINGS))
    return joined.withColumn("met", met).select(
        "id",
        "source",
        "nature",
        "other_language",
        ((F.col("nature") == "content") & ((F.col("ends") == 1) | (F.col("ends") == 2) & F.col("met").isNotNull())).alias("truncated"),
        F.get(names, F.col("met.encoding")).alias("limit_encoding"),
        F.col("met.length").alias("limit_length"),
    )


def truncation(df: DataFrame, id_col: str = "line_no", text_col: str = "proof", prompt_col: str = "prompt", source_col: str = "batch_id") -> DataFrame:
    """One row per record: id, source, nature, truncated, limit_encoding, limit_length.

    Empty, refusing and prompt-copying answers are not truncated. Null sources
    form one group. Repeated ids are judged row by row. An empty table gives
    an empty result.
    """
    return _verdicts(assess(df, id_col, text_col, prompt_col, source_col)).drop("other_language").withColumnRenamed("id", id_col)


def truncation_rates(df: DataFrame, id_col: str = "line_no", text_col: str = "proof", prompt_col: str = "prompt", source_col: str = "batch_id") -> DataFrame:
    """Per source: records, truncated, rate, at_limit and the limit met most often."""
    rows = truncation(df, id_col, text_col, prompt_col, source_col)
    limit = F.struct("limit_encoding", "limit_length")
    return rows.groupBy("source").agg(
        F.count("*").alias("records"),
        F.count_if("truncated").alias("truncated"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate"),
        F.count_if(F.col("truncated") & F.col("limit_length").isNotNull()).alias("at_limit"),
        F.mode(F.when(F.col("limit_length").isNotNull(), limit), True).alias("limit"),
    ).select("source", "records", "truncated", "rate", "at_limit", F.col("limit.limit_encoding").alias("limit_encoding"), F.col("limit.limit_length").alias("limit_length"))


def defective_pairs(df: DataFrame, table: language.LanguageFilter, id_col: str = "line_no", text_col: str = "proof", prompt_col: str = "prompt", source_col: str = "batch_id") -> DataFrame:
    """One row per defect: id, defect in empty, refusal, copied, truncated, other_language.

    The first three exclude every other defect. Null answers are empty; null
    prompts can be neither copied nor asked in a language.
    """
    rows = _verdicts(assess(df, id_col, text_col, prompt_col, source_col, table))
    defects = F.when(F.col("nature") != "content", F.array("nature")).otherwise(F.array_compact(F.array(F.when(F.col("truncated"), F.lit("truncated")), F.when(F.col("other_language"), F.lit("other_language")))))
    return rows.select(F.col("id").alias(id_col), F.explode(defects).alias("defect"))
