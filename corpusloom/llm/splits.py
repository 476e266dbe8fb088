"""Train, validation and test splits that keep related records together.

The records of one design cell share a split however the cell is written. The
cell is read from the record: the prompt that was asked, else its labels where
they can be read. Components (cells) of equal size and label profile form
bundles; the bundles' integral shares come from a flow with convex deviation
costs, and members are assigned by hash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import comb, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.language import asked_language
from corpusloom.session import stored

# Ways to ask for and to label the two styles.
STYLE_NAMES = {"terse": "terse t ter compact short brief concise dry kurz bref breve", "verbose": "verbose v verb expanded long detailed lengthy full ausführlich"}
STYLE_PHRASES = {"terse": "brief and formal|symbols before words|dry, compressed|compressed manner|little prose|terse|concise", "verbose": "explain each idea|at length|newcomer|take your time|motivate all|verbose|in detail"}
_STYLES = {w: k for k, ws in STYLE_NAMES.items() for w in ws.split()}
_STYLE_RE = {k: re.compile(v, re.I) for k, v in STYLE_PHRASES.items()}
_LETTERS = re.compile(r"[^a-z0-9]+")


def _squash(text: str) -> str:
    return _LETTERS.sub("", text.lower())


def _distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours, given up above `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


class Techniques:
    """Finds the canonical technique behind a label, a prompt or an id.

    `rows` are (technique, summary); the fixed vocabulary is small.
    """

    def __init__(self, rows: list[tuple[str, str | None]]):
        self.codes = sorted({c for c, _ in rows if c})
        self.exact = {_squash(c): c for c in self.codes}
        self.parts = {c: sorted(p for p in _LETTERS.split(c.lower()) if p) for c in self.codes}
        self.swapped: dict[str, set[str]] = defaultdict(set)
        for c, parts in self.parts.items():
            self.swapped["".join(parts)].add(c)
        self.words = {p for parts in self.parts.values() for p in parts}
        self.summaries = sorted(((_squash(s), c) for c, s in rows if c and s), key=lambda x: -len(x[0]))
        self.memo: dict[str, str | None] = {}

    def from_prompt(self, prompt: str | None) -> str | None:
        flat = _squash(prompt or "")
        return next((c for s, c in self.summaries if s and s in flat), None) if flat else None

    def from_id(self, row_id: str | None) -> str | None:
        parts = (row_id or "").split("__")
        return self.exact.get(_squash(parts[1])) if len(parts) > 2 else None

    def from_label(self, label: str | None) -> str | None:
        if not label or not label.strip():
            return None
        if label not in self.memo:
            self.memo[label] = self._read(label)
        return self.memo[label]

    def _read(self, label: str) -> str | None:
        flat = _squash(label)
        if not flat:
            return None
        if flat in self.exact:
            return self.exact[flat]
        pieces = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", label.strip()).lower()) if p]
        same = self.swapped.get("".join(sorted(pieces)), set())
        if len(same) == 1:
            return next(iter(same))
        if len(pieces) == 2:
            full = []
            for p in pieces:  # shortened parts
                fits = {w for w in self.words if w.startswith(p)} if len(p) >= 3 else set()
                full.append(fits or {p})
            fits = [c for c, parts in self.parts.items() if len(parts) == 2 and any(parts == sorted((x, y)) for x in full[0] for y in full[1])]
            if len(fits) == 1:
                return fits[0]
        near = sorted((_distance(flat, s, 2), c) for s, c in self.exact.items())
        if near and near[0][0] <= 2 and (len(near) == 1 or near[1][0] > near[0][0]):
            return near[0][1]
        return None


def style_of(label: str | None, prompt: str | None) -> str | None:
    code = _STYLES.get(_squash(label or ""))
    if code:
        return code
    found = [k for k, p in _STYLE_RE.items() if p.search(prompt or "")]
    if len(found) == 1:
        return found[0]
    near = [k for k in STYLE_NAMES if label and _distance(_squash(label), k, 2) <= 2]
    return near[0] if len(near) == 1 else None


def design_cells(df: DataFrame, techniques: list[tuple[str, str | None]]) -> DataFrame:
    """One row per technique-arm record: line_no, technique, style, language, relabelled.

    The technique is what the prompt asks for, else what the label means, else
    what the id spells out; a part that cannot be read is null, and such records
    form cells of their own with the parts that can. `relabelled` tells that a
    field as written differs from the cell. A narrow map.
    """
    schema = T.StructType(
        [T.StructField("line_no", df.schema["line_no"].dataType), T.StructField("technique", T.StringType()), T.StructField("style", T.StringType()), T.StructField("language", T.StringType()), T.StructField("relabelled", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Techniques(techniques)
        for batch in batches:
            out = []
            for rid, tech, style, lang, prompt in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                asked = finder.from_prompt(prompt)
                cell = (asked or finder.from_label(tech) or finder.from_id(rid), style_of(style, prompt), asked_language(prompt))
                out.append((*cell, (tech, style, lang) != cell))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[k], pa.string()) for k in range(3)), pa.array(cols[3], pa.bool_())], names=schema.names)

    arm = df.where(F.lower(F.trim("arm")) == "technique")
    return arm.select("line_no", "id", "technique", "style", "language", "prompt").mapInArrow(run, schema)


# --------------------------------------------------------------------------
# quotas by flow


#: Distributions of all bundles up to which every one is tried.
ALL_WAYS = 200_000


class _Network:
    """Flow of components from bundles to splits: what lies on the arcs and what changing it costs.

    The arcs into a split cost the square of the split's deviation from its
    wanted records, overall and, weighed, within the profile.
    """

    def __init__(self, bundles: list[tuple[int, str, int]], shares: list[float], weight: float):
        profiles = sorted({p for _, p, _ in bundles})
        self.size = np.array([s for s, _, _ in bundles], float)
        self.profile = np.array([profiles.index(p) for _, p, _ in bundles], int)
        self.number = np.array([n for _, _, n in bundles], int)
        self.k, self.weight, share = len(shares), weight, np.array(shares)
        # the flow that may divide components deviates nowhere; its whole part is kept
        self.given = np.floor(self.number[:, None] * share[None, :] + 1e-9).astype(int)
        records = self.size * self.number
        self.want = records.sum() * share
        self.want_in = np.array([records[self.profile == p].sum() for p in range(len(profiles))])[:, None] * share
        self.moves = [(a, c) for a in range(self.k) for c in range(self.k) if a != c]
        step = np.zeros((len(self.moves), self.k))
        for m, (a, c) in enumerate(self.moves):
            step[m, a], step[m, c] = -1, 1
        self.step, self.turn = step, step @ step.T

    def off(self) -> tuple[np.ndarray, np.ndarray]:
        """Deviations of the splits, overall and per profile."""
        carried = self.given * self.size[:, None]
        inside = np.zeros_like(self.want_in)
        np.add.at(inside, self.profile, carried)
        return carried.sum(0) - self.want, inside - self.want_in

    def cost(self) -> float:
        whole, inside = self.off()
        return float((whole**2).sum() + self.weight * (inside**2).sum())

    def augment(self) -> None:
        """Sends what is left of the bundles, greatest components first, each unit along its cheapest arc."""
        rest = self.number - self.given.sum(1)
        for b in sorted(np.flatnonzero(rest), key=lambda b: (-self.size[b], self.profile[b], b)):
            for _ in range(int(rest[b])):
                whole, inside = self.off()
                pull = whole + self.weight * inside[self.profile[b]]
                direct = 2 * self.size[b] * pull + (1 + self.weight) * self.size[b] ** 2
                self.given[b, int(direct.argmin())] += 1

    def change(self) -> np.ndarray:
        """Cost change of moving one unit of each bundle (row) along each move (column); infinite where there is none."""
        whole, inside = self.off()
        pull = whole[None, :] + self.weight * inside[self.profile]
        d = 2 * self.size[:, None] * (pull @ self.step.T) + 2 * (1 + self.weight) * self.size[:, None] ** 2
        for m, (a, _) in enumerate(self.moves):
            d[self.given[:, a] < 1, m] = np.inf
        return d

    def push(self, b: int, m: int, n: int = 1) -> None:
        a, c = self.moves[m]
        self.given[b, a] -= n
        self.given[b, c] += n

    def cancel(self) -> None:
        """Cancels cycles of negative cost: of one bundle, many units at once, then of two bundles."""
        while True:
            d = self.change()
            b, m = np.unravel_index(int(d.argmin()), d.shape)
            if d[b, m] < -1e-9:
                # along one move the cost is a parabola in the units
                curve = 2 * (1 + self.weight) * self.size[b] ** 2
                units = int(min(self.given[b, self.moves[m][0]], max(1, round((curve - d[b, m]) / (2 * curve)))))
                self.push(b, m, units)
                continue
            open_ = np.flatnonzero(np.isfinite(d.ravel()))
            row, col = np.unravel_index(open_, d.shape)
            best = (-1e-9, None)
            for at in range(0, len(open_), 1000):
                r, c = row[at : at + 1000], col[at : at + 1000]
                same = 1 + self.weight * (self.profile[r][:, None] == self.profile[row][None, :])
                both = d[r, c][:, None] + d[row, col][None, :] + 2 * self.size[r][:, None] * self.size[row][None, :] * self.turn[np.ix_(c, col)] * same
                # two units of one bundle from one split need both to be there
                source = np.array([a for a, _ in self.moves])
                twice = (r[:, None] == row[None, :]) & (source[c][:, None] == source[col][None, :])
                both[twice & (self.given[r, source[c]] < 2)[:, None]] = np.inf
                k = int(both.argmin())
                if both.ravel()[k] < best[0]:
                    x, y = divmod(k, len(open_))
                    best = (both.ravel()[k], ((r[x], c[x]), (row[y], col[y])))
            if best[1] is None:
                return
            for b, m in best[1]:
                self.push(b, m)

    def all_ways(self) -> bool:
        """Tries every distribution where there are at most ALL_WAYS; whether it did."""
        ways = [comb(int(n) + self.k - 1, self.k - 1) for n in self.number]
        if prod(ways) > ALL_WAYS:
            return False
        parts = [np.array([np.diff((-1, *bars, n + self.k - 1)) - 1 for bars in combinations(range(n + self.k - 1), self.k - 1)]) for n in map(int, self.number)]
        inside = np.zeros((1, *self.want_in.shape))
        for b, part in enumerate(parts):
            more = np.zeros((len(part), *self.want_in.shape))
            more[:, self.profile[b]] = part * self.size[b]
            inside = (inside[:, None] + more[None]).reshape(-1, *self.want_in.shape)
        cost = ((inside.sum(1) - self.want) ** 2).sum(1) + self.weight * ((inside - self.want_in) ** 2).sum((1, 2))
        chosen = np.unravel_index(int(cost.argmin()), ways)
        self.given = np.array([part[c] for part, c in zip(parts, chosen)])
        return True


def flow_quotas(bundles: list[tuple[int, str, int]], shares: list[float], profile_weight: float = 0.5) -> dict[tuple[int, str], list[int]]:
    """Integral components of each bundle (size, profile, count) for each split, by a flow of least deviation cost.

    The flow that may divide components gives every split its share of every
    bundle; its whole part is kept. What is left is sent unit by unit along the
    cheapest arcs, and cycles of negative cost are cancelled until there is
    none of one or two bundles. Small networks are solved by trying all ways.
    """
    if not bundles:
        return {}
    net = _Network(bundles, shares, profile_weight)
    if not net.all_ways():
        net.augment()
        net.cancel()
    return {(s, p): net.given[b].tolist() for b, (s, p, _) in enumerate(bundles)}


def split_components(records_df: DataFrame, key_cols: list[str], profile_col: str, shares: list[tuple[str, float]], seed: str = "0") -> DataFrame:
    """key_cols and split: one row per component, near the shares.

    Components are counted (one shuffle on pre-aggregated keys) and bundled by
    size and profile; the driver sees one row per bundle, at most as many as
    there are distinct sizes times profiles (their number grows with the square
    root of the records at most); a component's profile is its first label. Within a bundle components are ranked by hash
    in hash ranges, never in one task, and the first ones go to the first
    split. Null keys are keys like others.
    """
    names = [n for n, _ in shares]
    whole = sum(s for _, s in shares) or 1.0
    components = records_df.groupBy(*key_cols).agg(F.count("*").alias("size"), F.min(F.col(profile_col).cast("string")).alias("profile"))
    digest = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in key_cols])
    components = components.withColumns({"profile": F.coalesce("profile", F.lit("\0null")), "digest": digest, "part": F.shiftrightunsigned(digest, 52)})
    components = stored(components)
    counts = components.groupBy("size", "profile", "part").agg(F.count("*").alias("n"))
    bundles = [(r["size"], r["profile"], r["n"]) for r in counts.groupBy("size", "profile").agg(F.sum("n").alias("n")).orderBy("size", "profile").collect()]
    quotas = flow_quotas(bundles, [s / whole for _, s in shares])
    spark = records_df.sparkSession
    rows = []
    for (size, profile), given in quotas.items():
        low = 0
        for name, n in zip(names, given):
            if n:
                rows.append((size, profile, low, low + n, name))
            low += n
    ranges = spark.createDataFrame(rows, "size long, profile string, low long, high long, split string")
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size", "profile").orderBy("part")) - F.col("n")).drop("n")
    ranked = components.withColumn("rank_in_part", F.row_number().over(Window.partitionBy("size", "profile", "part").orderBy("digest", *key_cols)) - 1).join(offsets, ["size", "profile", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank_in_part"))
    return ranked.join(ranges, ["size", "profile"]).where("rank >= low and rank < high").select(*key_cols, "size", "split")


def keep_cells_together(df: DataFrame, techniques: list[tuple[str, str | None]], shares: list[tuple[str, float]]) -> DataFrame:
    """line_no, technique, style, language, relabelled, split for every technique-arm record."""
    cells = stored(design_cells(df, techniques))
    keys = ["technique", "style", "language"]
    parts = split_components(cells, keys, "language", shares)
    theirs = parts.select(*[F.col(c).alias(f"{c}_") for c in keys], "split")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys]
    return cells.join(theirs, same[0] & same[1] & same[2]).select("line_no", *keys, "relabelled", "split")


def small_rows(df: DataFrame, *cols: str, most: int = 100_000) -> list[tuple]:
    """The rows of a dimension table, refused above a bound."""
    rows = df.select(*cols).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dimension table of more than {most} rows")
    return [tuple(r) for r in rows]


def read_dimensions(spark: SparkSession, sf_dir: str) -> tuple[list[tuple], list[tuple]]:
    """Techniques with their summaries, and the wanted shares."""
    techniques = small_rows(spark.read.parquet(f"{sf_dir}/techniques.parquet"), "technique", "summary")
    shares = small_rows(spark.read.parquet(f"{sf_dir}/split_shares.parquet"), "split", "share")
    return techniques, sorted(shares, key=lambda x: (-x[1], x[0]))
