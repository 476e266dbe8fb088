"""Record schemas of the corpus."""

from pyspark.sql import types as T

USAGE = T.StructType([T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])

#: One generated answer with its design labels.
RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("arm", T.StringType()),
        T.StructField("theorem", T.StringType()),
        T.StructField("technique", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("style", T.StringType()),
        T.StructField("sample_index", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("effort", T.StringType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("proof", T.StringType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("usage", USAGE),
    ]
)

#: What a request carries, apart from the answer.
META = T.StructType([f for f in RECORD.fields if f.name not in ("prompt", "proof", "stop_reason", "usage")])
