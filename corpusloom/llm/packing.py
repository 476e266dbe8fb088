"""Containers of fixed capacity filled by harmonic packing.

Texts are measured in tokens of a public tokenizer. A text longer than the
capacity is cut into full pieces and a rest; every other item stays whole.
Items fall into reciprocal classes: class k holds lengths in (C/(k+1), C/k],
and exactly k of them fill a container of that class. Containers of a class
are filled by that fixed count, independently in every worker. The gap each
full container leaves is then topped up, best fit, with the short items (class
`small` and above), and only the short items left over open containers of
their own.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file: a name that every worker finds among its public tokenizers, or a path.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Tokens handled by one worker group; sets how many groups are packed apart.
GROUP_TOKENS = 2_000_000

_ENCODINGS: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path if os.sep in path else public_tokenizers.path(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("corpusloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, tokens (null for a null text). A narrow map; texts are not shipped on."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            counts = [None if t is None else len(enc.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=schema.names)

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, schema)


def pack(lengths: list[int], capacity: int, small: int | None = None) -> list[int]:
    """Container number (from 0) of each item; every length is 1..capacity.

    Without `small`, the boundary between counted classes and short items that
    needs the fewest containers is taken.
    """
    if small is None:
        return min((pack(lengths, capacity, s) for s in range(2, 12)), key=lambda w: max(w, default=-1))
    where = [-1] * len(lengths)
    room: list[int] = []
    classes: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        classes.setdefault(capacity // n, []).append(i)
    for k in sorted(c for c in classes if c < small):
        # neighbours in length share a container, so gaps differ and suit different short items
        members = sorted(classes[k], key=lambda i: (-lengths[i], i))
        for at in range(0, len(members), k):
            group = members[at : at + k]
            for i in group:
                where[i] = len(room)
            room.append(capacity - sum(lengths[i] for i in group))
    gaps = sorted((r, b) for b, r in enumerate(room) if r)
    rest = []
    for i in sorted((i for k, m in classes.items() if k >= small for i in m), key=lambda i: (-lengths[i], i)):
        at = bisect_right(gaps, (lengths[i] - 1, 1 << 60))
        if at == len(gaps):
            rest.append(i)
            continue
        r, b = gaps.pop(at)
        where[i] = b
        room[b] = r - lengths[i]
        if room[b]:
            insort(gaps, (room[b], b))
    filling: list[int] = []
    space = capacity
    for i in rest:  # longest first: containers of one class after the other
        if lengths[i] > space:
            filling, space = [], capacity
        if not filling:
            room.append(0)
        filling.append(i)
        where[i] = len(room) - 1
        space -= lengths[i]
        room[-1] = space
    return where


def fill_containers(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, small: int | None = None) -> DataFrame:
    """One row per document or piece: id, piece_no, first_token, tokens, container.

    `container` is "<group>-<number>"; groups of about GROUP_TOKENS tokens are
    packed apart, so their number grows with the input and no worker holds more
    than its group. Null and empty texts take no room and get no row; ids that
    repeat are separate items. Texts longer than the capacity give full pieces
    and one rest; `first_token` tells where a piece starts.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    from corpusloom.session import checkpoint

    counted = checkpoint(token_counts(df, id_col, text_col, tokenizer).where("tokens > 0"))
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP_TOKENS))
    pieces = counted.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))))
    pieces = pieces.select(
        id_col,
        "piece_no",
        (F.col("piece_no").cast("long") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece_no").cast("long") * capacity).alias("tokens"),
    )
    # pieces of one long text spread over the groups too
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64(F.col(id_col), F.col("piece_no")), F.lit(groups)).cast("int"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("container", T.StringType())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select([*pieces_names, "group"]).sort_by([("tokens", "descending"), (id_col, "ascending"), ("piece_no", "ascending")])
        group = key[0].as_py()
        where = pack(table.column("tokens").to_pylist(), capacity, small)
        return table.select(pieces_names).append_column("container", pa.array([f"{group}-{b}" for b in where], pa.string()))

    pieces_names = pieces.columns
    return grouped.groupBy("group").applyInArrow(run, schema)
