"""Clusters of versions of one text by Markov clustering.

Sentences are folded to words, so case, spacing, markup and variable letters do
not count. Wordings of one sentence are then brought together: those that differ
in one word (replaced, added or dropped) share a mark, and those with the same
telling numbers are aligned word by word. Each text becomes the set of its
sentences; texts with equal sets are one node. Nodes are linked to a few anchors
per sentence (the smallest hashes of the nodes that hold it), and a link is kept
when more than half of the sentences of the shorter text recur. What the anchors
leave apart is then searched exactly, by the rarest sentences of each node.
Markov clustering alternates sparse squaring of the column-stochastic link
matrix, inflation and the pruning of small entries; attractor rows define the
clusters and the members with the strongest flow represent them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import fold, records, segment
from corpusloom.session import stored

#: Anchors per sentence, and wordings per group that others are aligned with in one round.
ANCHORS = 8
#: Holders of one sentence, or members of one cluster, that one task joins with all others.
SALT_ROWS = 2000
#: Share of the longer wording's words that must align, beside equal numbers.
ALIGNED = 0.5
_BASE = 0x9E3779B97F4A7C15 | 1
_LONGS = T.ArrayType(T.LongType())


# --------------------------------------------------------------------------
# wordings of sentences


@lru_cache(maxsize=1 << 17)
def _word(w: str) -> tuple[int, bool, bool]:
    """Hash of a word, whether it is a number, whether it belongs to a spaceless script."""
    return xxhash.xxh3_64_intdigest(w), w.isdigit(), bool(segment.CJK.match(w))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def wording_key(words: list[str]) -> int:
    """One 64-bit key for the words in their order."""
    return xxhash.xxh3_64_intdigest("\x1f".join(words)) - (1 << 63)


def sentence_wordings(text: str | None) -> dict[int, str]:
    """Key and folded words of the text's sentences; sentences without a word are none."""
    words = fold.words_of_each([text[a:b].replace("\x1e", " ") for a, b in segment.units(text)])
    return {wording_key(ws): " ".join(ws) for ws in words if ws}


def telling_numbers(words: list[str]) -> int | None:
    """A key of the numbers in their order; None unless there are two with four digits in all."""
    numbers = [w for w in words if w.isdigit()]
    if len(numbers) < 2 or sum(map(len, numbers)) < 4:
        return None
    return _signed(xxhash.xxh3_64_intdigest("\x1f".join(numbers)))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def wording_marks(wordings: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(wording number, mark): hashes of each wording and of what is left of it without one word other than a number.

    In spaceless scripts up to four adjacent characters are left out. Two
    wordings share a mark when they are equal after one word of each, or of
    one, is left out. A quarter of the words may go at most. The hashes are
    polynomials of the words, taken from running sums over all wordings at once.
    """
    size = np.array([len(w) for w in wordings], np.int64)
    total = int(size.sum())
    up, down = _powers(1 << max(4, total.bit_length()))
    known = [_word(w) for ws in wordings for w in ws]
    h = np.array([k[0] for k in known], np.uint64)
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    numbers, sparse = upto([k[1] for k in known]), upto([not k[2] for k in known])
    end = np.cumsum(size)
    start = end - size
    with np.errstate(over="ignore"):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * down[:total], dtype=np.uint64)))
        owners, marks = [np.flatnonzero(size)], [((run[end] - run[start]) * up[end])[size > 0]]
        for k in range(1, 5):
            wide = np.flatnonzero(size >= 4 * k)
            if not len(wide):
                break
            places = size[wide] - k + 1
            owner = np.repeat(wide, places)
            at = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) + start[owner]
            may = (numbers if k == 1 else sparse)[at + k] == (numbers if k == 1 else sparse)[at]
            owner, at = owner[may], at[may]
            a, b = start[owner], end[owner]
            # words before the gap move up by it, so both sides meet as in a wording without it
            owners.append(owner)
            marks.append((run[at] - run[a]) * up[b - k] + (run[b] - run[at + k]) * up[b])
        # as if every wording began at the same place
        owner, mark = np.concatenate(owners), np.concatenate(marks)
        left = np.concatenate([size[o] - k for k, o in enumerate(owners)])
        return owner, (mark ^ (left.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))).view(np.int64)


def wordings_align(a: list[int], b: list[int], share: float = ALIGNED) -> bool:
    """Whether `share` of the longer wording's words (numbers aside) stand in the other in the same order."""
    longer = max(len(a), len(b))
    return longer == 0 or min(len(a), len(b)) >= share * longer and records.lcs_length(a, b) >= share * longer


def _inspected(wordings: DataFrame) -> DataFrame:
    """key, grp (of wordings with the same telling numbers, else null), words (hashes, for those), marks (for all others, else none). A narrow map."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("grp", T.LongType()), T.StructField("words", _LONGS), T.StructField("marks", _LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [text.split(" ") for text in batch.column(1).to_pylist()]
            groups = [telling_numbers(ws) for ws in words]
            hashed = [None if g is None else [_signed(_word(w)[0]) for w in ws if not w.isdigit()] for g, ws in zip(groups, words)]
            owner, mark = wording_marks([[] if g is not None else ws for g, ws in zip(groups, words)])
            order = np.argsort(owner, kind="stable")
            bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words))))).astype(np.int32)
            marks = pa.ListArray.from_arrays(pa.array(bounds), pa.array(mark[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.int64()), pa.array(hashed, pa.list_(pa.int64())), marks], names=schema.names)

    return wordings.select("key", "wording").mapInArrow(run, schema)


def _aligned_with(pairs: DataFrame, share: float) -> DataFrame:
    """key, to: the first of the leaders (in order of key) that each wording aligns with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, mine, leaders = (batch.column(k).to_pylist() for k in range(3))
            to = [next((x["key"] for x in ls if wordings_align(m, x["words"], share)), None) for m, ls in zip(mine, leaders)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int64())], names=["key", "to"])

    return pairs.select("key", "words", "leaders").mapInArrow(run, "key long, to long")


def _same_numbers(inspected: DataFrame, share: float = ALIGNED) -> DataFrame:
    """src, dst: each wording with telling numbers and the leader it aligns with.

    In each round up to ANCHORS wordings lead their group and all others are
    aligned with them; those that align with none go on among themselves, until
    every wording has a leader. A group is never gathered: leaders are few and
    are joined to the members.
    """
    rest = inspected.where("grp is not null").select("key", "grp", "words")
    held = rest.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    rest = stored(rest.join(held, "grp", "left_semi").select("key", "grp", "words"))
    out = None
    while rest.head(1):
        part = F.pmod(_digest("key"), F.lit(ANCHORS))
        leaders = rest.groupBy("grp", part.alias("part")).agg(F.min_by(F.struct("key", "words"), _digest("key")).alias("x")).groupBy("grp").agg(F.array_sort(F.collect_list("x")).alias("leaders"))
        # a leader that aligns with a lesser one follows it
        to = _aligned_with(rest.join(leaders, "grp"), share)
        found = stored(to)
        now = found.where("to is not null").select(F.col("key").alias("src"), F.col("to").alias("dst"))
        out = now if out is None else out.unionByName(now)
        left = rest.join(found.where("to is null").select("key"), "key", "left_semi").select("key", "grp", "words")
        rest = stored(left, rest)
    spark = inspected.sparkSession
    return (spark.createDataFrame([], "src long, dst long") if out is None else out).where("src <> dst")


def sentence_classes(wordings: DataFrame) -> DataFrame:
    """key, class: the least key of all wordings of a sentence, for those that have others.

    `wordings` holds key and wording (folded words joined by blanks), each key once.
    """
    inspected = stored(_inspected(wordings))
    marks = inspected.where("grp is null").select("key", F.explode("marks").alias("mark"))
    # a mark's holders point to the least of them: no task holds them all
    least = marks.groupBy("mark").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("mark", "low")
    near = marks.join(least, "mark").where("key <> low").select(F.col("key").alias("src"), F.col("low").alias("dst"))
    return components(near.unionByName(_same_numbers(inspected)).distinct()).select(F.col("node").alias("key"), F.col("comp").alias("class"))


def worded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, keys (sorted), wordings (in the order of the keys). A narrow map."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("keys", _LONGS), T.StructField("wordings", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(sentence_wordings(t).items()) for t in batch.column(1).to_pylist()]
            keys, texts = [[k for k, _ in f] for f in found], [[w for _, w in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))], names=schema.names)

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, schema)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node (hash of the set of sentences, null without any), keys (sorted classes of sentences)."""
    rows = stored(worded(df, id_col, text_col).withColumn("own", F.when(F.size("keys") > 0, F.xxhash64("keys"))))
    wordings = rows.select(F.explode(F.arrays_zip("keys", "wordings")).alias("s")).groupBy(F.col("s.keys").alias("key")).agg(F.first("s.wordings").alias("wording"))
    classes = sentence_classes(wordings)
    own = rows.where("own is not null").groupBy("own").agg(F.first("keys").alias("keys"))
    placed = own.select("own", F.explode("keys").alias("key")).join(classes, "key", "left").groupBy("own").agg(F.sort_array(F.collect_set(F.coalesce("class", "key"))).alias("keys"))
    return rows.select(id_col, "own").join(placed, "own", "left").select(id_col, F.when(F.col("keys").isNotNull(), F.xxhash64("keys")).alias("node"), F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys"))


# --------------------------------------------------------------------------
# links of texts


def anchored(nodes: DataFrame, share: float = 0.5) -> DataFrame:
    """src, dst, w: verified links of each node to anchors of its keys, w above `share`.

    Per key the nodes fall into ANCHORS parts by hash and the smallest hash of
    each part is an anchor, found with a map-side partial minimum; a key held
    by very many nodes gives each of them ANCHORS candidates, so candidates
    grow linearly. Candidates are verified on the whole key sets.
    """
    held = nodes.select("node", F.explode("keys").alias("key"))
    digest = _digest("node")
    # the part is the same in every key, so that one node tends to anchor all keys of its text
    anchors = held.groupBy("key", F.pmod(digest, F.lit(ANCHORS)).alias("part")).agg(F.min_by("node", digest).alias("dst"), F.count("*").alias("n"))
    by_key = anchors.groupBy("key").agg(F.collect_list("dst").alias("anchors"), F.sum("n").alias("n")).where("n > 1")
    candidates = held.join(by_key, "key").select(F.col("node").alias("src"), F.explode("anchors").alias("dst")).where("src <> dst").distinct()
    return _verified(candidates, nodes, share)


def _digest(col: str) -> Column:
    return F.xxhash64(F.lit("anchor"), col)


def _verified(candidates: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The candidates (src, dst, ...) of which more than `share` of the shorter node's sentences recur, with w."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("keys").alias("a")), nodes.select(F.col("node").alias("dst"), F.col("keys").alias("b"))
    both = candidates.join(a, "src").join(b, "dst")
    return both.select(*candidates.columns, (F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b"))).alias("w")).where(F.col("w") > share)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reached) for all nodes of the edges (src, dst); ends when nothing changes."""
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("comp")))
    total = None
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        low = label.join(near, "node").select("node", F.least("comp", "near").alias("comp"))
        hop = label.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        label = stored(low.join(hop, "comp").select("node", F.least("comp", "further").alias("comp")), label)
        # labels only fall, so an equal sum means that none changed
        now = label.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return label
        total = now


def bridges(nodes: DataFrame, edges: DataFrame, share: float = 0.5) -> DataFrame:
    """src, dst, w: links between the components of `edges`, from an exact search over all pairs.

    More than `share` of the shorter node's sentences recur, so one of its
    n - floor(share * n) rarest does: these are joined with all sentences of the
    nodes that are not shorter. Sentences whose holders are all in one
    component cannot join two and are left out; one held by very many nodes
    is salted. Of the verified links of a node into another component those to
    the component's anchors among them are kept; what is left out joins nodes
    that are connected already. Links lead from the node that has fewer of them,
    so that a text which shares its few sentences with very many is no long column.
    """
    comps = components(edges)
    held = nodes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.size("keys").alias("size"), F.explode("keys").alias("key"))
    by_key = held.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    by_key = by_key.select("key", "n", (F.col("low") < F.col("high")).alias("open"))
    ranked = held.join(by_key, "key").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("n", "key")))
    ranked = stored(ranked.where("open").select("node", "comp", "size", "key", "rank", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("parts")))
    rare = ranked.where(F.col("rank") <= F.col("size") - F.floor(F.col("size") * share))
    rare = rare.select(F.col("node").alias("src"), F.col("comp").alias("src_comp"), F.col("size").alias("src_size"), "key", F.pmod(_digest("node"), F.col("parts")).cast("int").alias("salt"))
    whole = ranked.select(F.col("node").alias("dst"), F.col("comp").alias("dst_comp"), F.col("size").alias("dst_size"), "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    met = rare.join(whole, ["key", "salt"]).where("src_comp <> dst_comp and src_size <= dst_size").select("src", "dst", "dst_comp").distinct()
    found = _verified(met, nodes, share).withColumn("part", F.pmod(_digest("dst"), F.lit(ANCHORS)))
    first = F.min_by(F.struct("dst", "w"), _digest("dst")).alias("d")
    kept = stored(found.groupBy("src", "dst_comp", "part").agg(first).select("src", "d.dst", "d.w"))
    degree = kept.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    both = kept.join(degree.select(F.col("node").alias("src"), F.col("n").alias("a")), "src").join(degree.select(F.col("node").alias("dst"), F.col("n").alias("b")), "dst")
    turn = F.col("a") > F.col("b")
    return both.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "w")


def links(nodes: DataFrame, share: float = 0.5) -> DataFrame:
    """src, dst, w: verified links that connect every two nodes (node, keys) that all pairs above `share` connect."""
    near = stored(anchored(nodes, share))
    return near.unionByName(bridges(nodes, near, share))


def _columns(entries: DataFrame, least: float, power: float) -> DataFrame:
    """j, col: the entries (i, j, m) of each column, inflated, without those under `least`, summing to one.

    A column keeps its greatest entry (of equal ones the smallest row) and at
    most 1/least others, so it fits one row.
    """
    cols = entries.groupBy("j").agg(F.collect_list(F.struct("i", F.pow("m", F.lit(power)).alias("m"))).alias("col"))
    # the sum and the greatest entry are taken once per column, not per entry
    for floor in (least, 0.0):
        cols = cols.withColumn("s", F.aggregate("col", F.lit(0.0), lambda t, e: t + e["m"]))
        shares = F.transform(F.arrays_zip("col", F.array_repeat("s", F.size("col")).alias("s")), lambda z: F.struct(z["col"]["i"].alias("i"), (z["col"]["m"] / z["s"]).alias("m")))
        cols = cols.select("j", shares.alias("col"))
        if floor:
            top = F.array_max(F.transform("col", lambda e: F.struct(e["m"], (-e["i"]).alias("i"))))["i"]
            cols = cols.withColumn("top", -top).select("j", F.filter("col", lambda e: (e["m"] >= floor) | (e["i"] == F.col("top"))).alias("col"))
    return cols


def markov_clusters(edges: DataFrame, inflation: float = 1.6, least: float = 0.005, steps: int = 100, settled: float = 1e-3) -> DataFrame:
    """node, cluster, flow for all nodes that have links (src, dst, w).

    Column src of the matrix holds src's own weight and its links, so a column
    holds no more entries than a node has anchors, in its keys and in other components. Each step squares by one
    join on the middle index (a hot anchor's row is split by adaptive skew
    handling) and one exchange on the column, after which sums, inflation and
    pruning stay local, and ends in a checkpoint. The loop ends when every column has settled
    on one row, or when two steps have changed neither the entries' number nor any column's leading row; it fails after `steps`, where it would not have settled. Of rows
    with equal flow the smallest node wins.
    """
    # an anchor needs no column entry for each node linked to it: only links between anchors go both ways
    anchors = edges.select(F.col("dst").alias("src")).distinct()
    back = edges.join(anchors, "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    loops = both.groupBy("src").agg(F.max("w").alias("w")).select("src", F.col("src").alias("dst"), "w")
    arcs = edges.select("src", "dst", "w").unionByName(back).unionByName(loops)
    entries = arcs.groupBy(F.col("dst").alias("i"), F.col("src").alias("j")).agg(F.max("w").alias("m"))
    matrix = stored(_columns(entries, 0.0, 1.0))
    lead = F.array_max(F.transform("col", lambda e: F.struct(F.round(e["m"], 6).alias("m"), (-e["i"]).alias("low"))))
    same, before = 0, None
    for _ in range(steps):
        right = matrix.select("j", F.explode("col").alias("e")).select("j", F.col("e.i").alias("k"), F.col("e.m").alias("b"))
        left = matrix.select(F.col("j").alias("k"), "col")
        products = right.join(left, "k").select("j", "b", F.explode("col").alias("e")).select("j", F.col("e.i").alias("i"), (F.col("e.m") * F.col("b")).alias("p"))
        squared = products.repartition("j").groupBy("j", "i").agg(F.sum("p").alias("m"))
        matrix = stored(_columns(squared, least, inflation), matrix)
        leads = F.sum(F.xxhash64("j", lead["low"]).cast("decimal(38,0)"))
        state = matrix.agg(F.sum(F.size("col")).alias("n"), F.sum(F.aggregate("col", F.lit(0.0), lambda t, e: t + e["m"] * (1 - e["m"]))).alias("unsettled"), F.count("*").alias("cols"), leads.alias("leads")).first()
        now = (state["n"], state["leads"])
        same = same + 1 if now == before else 0
        if not state["n"] or state["unsettled"] < settled * state["cols"] or same == 2:
            break
        before = now
    else:
        raise RuntimeError(f"the clustering has not settled after {steps} steps")
    top = F.array_max(F.transform("col", lambda e: F.struct(F.round(e["m"], 9).alias("m"), (-e["i"]).alias("low"))))
    chosen = stored(matrix.select(F.col("j").alias("node"), top.alias("t")).select("node", (-F.col("t.low")).alias("to"), F.col("t.m").alias("flow")))
    # attractors that send their flow to one another are one cluster, however long the chain
    arrows = chosen.where("node <> to").select(F.col("node").alias("src"), F.col("to").alias("dst"))
    return chosen.select("node", "flow").join(components(arrows), "node", "left").select("node", F.coalesce("comp", "node").alias("cluster"), "flow")


def cluster_versions(df: DataFrame, id_col: str = "row_idx", text_col: str = "proof") -> DataFrame:
    """One row per text: id, cluster (a node hash), flow.

    Texts without a word have no keys: each is a cluster of its own with the id
    as name, flow 0. Null texts likewise. Equal texts share a node, so exact
    copies cost one row each. Repeated ids give repeated rows.
    """
    rows = stored(keyed(df, id_col, text_col))
    nodes = stored(rows.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys")))
    found = stored(markov_clusters(links(nodes)))
    joined = rows.select(id_col, "node").join(found, "node", "left")
    alone = F.coalesce(F.col("node"), F.xxhash64(F.lit("alone"), F.col(id_col)))
    return joined.select(id_col, F.coalesce("cluster", alone).alias("cluster"), F.coalesce("flow", F.lit(0.0)).alias("flow"))


def cluster_pairs(members: DataFrame, id_col: str = "row_idx") -> DataFrame:
    """row_a < row_b for all pairs within a cluster; a large cluster is salted, so no task holds more than SALT_ROWS of it on one side."""
    rows = stored(members.select("cluster", id_col).distinct())
    parts = rows.groupBy("cluster").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").select("cluster", "parts")
    sized = rows.join(parts, "cluster")
    a = sized.select("cluster", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int").alias("salt"), F.col(id_col).alias("row_a"))
    b = sized.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col(id_col).alias("row_b"))
    return a.join(b, ["cluster", "salt"]).where("row_a < row_b").select("row_a", "row_b")


def describe_clusters(members: DataFrame, labels: DataFrame, id_col: str = "row_idx", typical: int = 3) -> DataFrame:
    """cluster, size, typical (ids of the strongest members), directions (label: count).

    `labels` holds id_col and `direction`; rows without a label count in size only.
    """
    strongest = Window.partitionBy("cluster", "part").orderBy(F.desc("flow"), id_col)
    # strongest of each hash part first, then of the parts: no task sorts a whole cluster
    parts = members.withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(64))).withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= typical)
    best = parts.groupBy("cluster").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("flow")).alias("f"), F.col(id_col).alias("id")))), lambda x: x["id"]), 1, typical).alias("typical"))
    counted = members.join(labels, id_col, "left").groupBy("cluster", "direction").agg(F.count("*").alias("n"))
    shape = counted.groupBy("cluster").agg(
        F.sum("n").alias("size"),
        F.array_sort(F.collect_list(F.when(F.col("direction").isNotNull(), F.concat_ws(":", "direction", F.col("n").cast("string"))))).alias("directions"),
    )
    return shape.join(best, "cluster").select("cluster", "size", F.array_join(F.transform("typical", lambda x: x.cast("string")), ",").alias("typical"), F.array_join("directions", ",").alias("directions"))
