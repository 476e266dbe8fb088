"""Evaluation passages inside training documents.

Both sides are folded to letters and digits. Every sentence of an item is a
pattern; its q-grams that are rare among the items are indexed with their
offsets. A document's q-grams are looked up in one vectorised pass; hits of a
pattern are counted in overlapping diagonal bands, and by the q-gram lemma a
pattern of r indexed q-grams within its edit budget e keeps at least r - q*e of
them in one band. With this budget that bound says nothing, so the bands only
show where to align first and exclude no pattern. The numbers of a sentence
must recur, since they tell sentences of one wording apart; an item of which the
sentences whose numbers a document has make up half is verified, each sentence
with a banded alignment or else with one of all places that have its numbers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import fold, segment
from corpusloom.llm.records import lcs_length

Q = 6
#: Share of a pattern's characters that edits may touch.
EDITS = 0.3
#: Folded characters of items indexed at a time; larger item sets are searched block by block.
BLOCK_CHARS = 4_000_000
_SLOT_BITS = 20


def _gram_hashes(cp: np.ndarray, q: int = Q) -> np.ndarray:
    """Polynomial hash of each q-gram of a code point array."""
    n = len(cp) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x100000001B3) + cp[k : k + n].astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ends(pattern: str, text: str, budget: int) -> Iterator[int]:
    """Ends (just behind) of the substrings of text within `budget` edits of pattern (bit-parallel columns)."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << m) - 1
    last = 1 << (m - 1)
    pv, mv, score = full, 0, m
    for at, ch in enumerate(text, 1):
        eq = where.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= budget:
            yield at


def within(pattern: str, text: str, budget: int) -> bool:
    """Whether some substring of text is within `budget` edits of pattern."""
    return not pattern or next(ends(pattern, text, budget), None) is not None


@dataclass
class ItemIndex:
    """Patterns of a block of items and their indexed q-grams."""

    item_ids: list
    pattern_item: np.ndarray
    patterns: list[str]
    numbers: list[list[str]]
    length: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    total: np.ndarray
    slots: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    gram_pattern: np.ndarray
    gram_offset: np.ndarray
    need: np.ndarray
    having: dict[str, tuple[np.ndarray, np.ndarray]]


def build_index(items: list[tuple], rare: int = 3, least_grams: int = 10) -> ItemIndex:
    """Index (item id, text) rows. Items without a letter or digit hold no pattern."""
    ids, owner, patterns = [], [], []
    total = []
    for item_id, text in items:
        k = len(ids)
        ids.append(item_id)
        size = 0
        for a, b in segment.units(text):
            p = fold.letters(text[a:b])
            if p:
                owner.append(k)
                patterns.append(p)
                size += len(p)
        total.append(size)
    per = [_gram_hashes(_points(p)) for p in patterns]
    flat = np.concatenate(per) if per else np.zeros(0, np.uint64)
    uniq, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    at = 0
    keep_gram, keep_pattern, keep_offset, least, budgets = [], [], [], [], []
    for k, h in enumerate(per):
        n = counts[inverse[at : at + len(h)]]
        at += len(h)
        order = np.argsort(n, kind="stable")
        chosen = np.sort(np.union1d(np.flatnonzero(n <= rare), order[:least_grams]))
        budget = max(1, int(EDITS * len(patterns[k])))
        budgets.append(budget)
        keep_gram.append(h[chosen])
        keep_pattern.append(np.full(len(chosen), k))
        keep_offset.append(chosen)
        least.append(min(max(3, len(chosen) - Q * budget), max(1, len(chosen))))
    grams = np.concatenate(keep_gram) if keep_gram else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    slots = np.zeros(1 << _SLOT_BITS, bool)
    slots[(grams & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)] = True
    values, first = np.unique(grams, return_index=True)
    gp = np.concatenate(keep_pattern)[order] if keep_pattern else np.zeros(0, np.int64)
    go = np.concatenate(keep_offset)[order] if keep_offset else np.zeros(0, np.int64)
    numbers = [fold.numbers(p) for p in patterns]
    having: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, wanted in enumerate(numbers):
        for value, times in Counter(wanted).items():
            having[value].append((k, times))
    need = np.asarray([_needed(wanted) for wanted in numbers], np.int64)
    return ItemIndex(ids, np.asarray(owner, np.int64), patterns, numbers, np.asarray([len(p) for p in patterns], np.int64), np.asarray(budgets, np.int64), np.asarray(least, np.int64), np.asarray(total, np.int64), slots, values, np.append(first, len(grams)), gp, go, need, {v: tuple(np.asarray(x).T) for v, x in having.items()})


def _needed(wanted: list[str]) -> int:
    """How many of a sentence's numbers must recur."""
    return len(wanted) - (1 if len(wanted) >= 3 else 0)


def _in_order(wanted: list[str], found: list[str]) -> int:
    at = got = 0
    for w in wanted:
        try:
            at = found.index(w, at) + 1
            got += 1
        except ValueError:
            pass
    return got


def matches(index: ItemIndex, pattern: int, text: str, diagonal: int) -> bool:
    """Banded alignment of a pattern around a diagonal of the folded text."""
    m, e = int(index.length[pattern]), int(index.budget[pattern])
    a, b = max(0, diagonal - 2 * e - 8), min(len(text), diagonal + m + 2 * e + 8)
    window = text[a:b]
    wanted = index.numbers[pattern]
    if wanted and _in_order(wanted, fold.numbers(window)) < _needed(wanted):
        return False
    return within(index.patterns[pattern], window, e)


def places(index: ItemIndex, pattern: int, size: int, hits: list[tuple[int, str]]) -> list[list[int]]:
    """Spans of a folded text of this size around which enough of the pattern's numbers (`hits`: start, digits) lie together, in order."""
    reach = int(index.length[pattern] + 4 * index.budget[pattern]) + 16  # the span that matches() aligns
    wanted, need = index.numbers[pattern], int(index.need[pattern])
    if not wanted:
        return [[0, size]]
    out: list[list[int]] = []
    if len(hits) < need:
        return out
    starts = [s for s, _ in hits]
    times = Counter(wanted)
    single = len(times) == len(wanted)
    for k in range(len(starts) - need + 1):
        at = starts[k]
        if starts[k + need - 1] >= at + reach:
            continue
        near = [v for _, v in hits[k : bisect_left(starts, at + reach)]]
        if (len(set(near)) if single else (times & Counter(near)).total()) >= need and (need < 2 or lcs_length(wanted, near) >= need):
            # the span that begins with this number holds the others behind it
            a, b = max(0, hits[k + need - 1][0] - reach), min(size, at + reach)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return out


def found_anywhere(index: ItemIndex, pattern: int, text: str, spans: list[list[int]], hits: list[tuple[int, str]]) -> bool:
    """Whether the pattern is held in one of the spans of the folded text with its numbers in order."""
    m, e = int(index.length[pattern]), int(index.budget[pattern])
    wanted, need = index.numbers[pattern], int(index.need[pattern])
    for a, b in spans:
        for end in ends(index.patterns[pattern], text[a:b], e):
            if not wanted:
                return True
            lo, hi = a + end - m - 2 * e - 8, a + end + 2 * e + 8
            near = [v for s, v in hits[bisect_left(hits, (lo, "")) : bisect_left(hits, (hi, ""))] if s + len(v) <= hi]
            if _in_order(wanted, near) >= need:
                return True
    return False


def search(index: ItemIndex, texts: list[str | None], share: float = 0.5) -> list[tuple[int, int, float]]:
    """(text number, item number, share held) for a batch of documents."""
    out: list[tuple[int, int, float]] = []
    if not index.patterns:
        return out
    folded = [fold.letters(t) if t else "" for t in texts]
    group: list[int] = []
    size = 0
    for i, t in enumerate(folded):
        group.append(i)
        size += len(t)
        if size >= 400_000:
            _search_group(index, folded, group, share, out)
            group, size = [], 0
    _search_group(index, folded, group, share, out)
    return out


def _bands(index: ItemIndex, folded: list[str], group: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Per number in the group * patterns + pattern: q-gram hits and diagonal of each band with many hits."""
    joined = ("\n" * Q).join(folded[i] for i in group)
    starts = np.cumsum([0] + [len(folded[i]) + Q for i in group])[:-1]
    h = _gram_hashes(_points(joined))
    if not len(h):
        return {}
    pos = np.flatnonzero(index.slots[(h & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)])
    if not len(pos):
        return {}
    at = np.searchsorted(index.grams, h[pos])
    at[at == len(index.grams)] = 0
    hit = index.grams[at] == h[pos]
    pos, at = pos[hit], at[hit]
    if not len(pos):
        return {}
    lo, hi = index.first[at], index.first[at + 1]
    n = hi - lo
    rep = np.repeat(np.arange(len(pos)), n)
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    doc = np.searchsorted(starts, pos[rep], side="right") - 1
    pattern = index.gram_pattern[entry]
    diagonal = pos[rep] - starts[doc] - index.gram_offset[entry]
    width = np.maximum(2 * index.budget[pattern], 8)
    base = doc * np.int64(len(index.patterns)) + pattern
    bands: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for shift in (0, 1):  # overlapping bands
        band = (diagonal + (width // 2) * shift) // width
        key = base * np.int64(1 << 24) + (band + (1 << 23))
        values, firsts, counts = np.unique(key, return_index=True, return_counts=True)
        enough = counts >= index.least[pattern[firsts]]
        for f, c in zip(firsts[enough].tolist(), counts[enough].tolist()):
            bands[int(base[f])].append((c, int(diagonal[f])))
    return bands


def _search_group(index: ItemIndex, folded: list[str], group: list[int], share: float, out: list) -> None:
    if not group:
        return
    patterns, items = len(index.patterns), len(index.item_ids)
    own = np.argsort(index.pattern_item, kind="stable")
    bounds = np.searchsorted(index.pattern_item[own], np.arange(items + 1))
    # items of which the sentences that have their numbers together in the document make up enough
    open_items: dict[int, list[tuple[int, int, dict]]] = {}
    for row in group:
        text = folded[row]
        if not text:
            continue
        runs: dict[str, list[int]] = defaultdict(list)
        for m in fold._NUMBER.finditer(text):
            if m.group() in index.having:
                runs[m.group()].append(m.start())
        seen = [(*index.having[v], len(at)) for v, at in runs.items()]
        got = np.zeros(patterns)
        if seen:
            got = np.bincount(np.concatenate([p for p, _, _ in seen]), np.concatenate([np.minimum(t, n) for _, t, n in seen]), patterns)
        may = got >= index.need
        most = np.bincount(index.pattern_item, index.length * may, items)
        for k in np.flatnonzero((most >= share * index.total) & (index.total > 0)).tolist():
            total, left = int(index.total[k]), int(most[k])
            spots = {}
            for p in own[bounds[k] : bounds[k + 1]].tolist():
                if may[p]:
                    hits = sorted((at, v) for v in set(index.numbers[p]) for at in runs.get(v, ()))
                    if spans := places(index, p, len(text), hits):
                        spots[p] = spans, hits
                    else:
                        left -= int(index.length[p])
                        if left < share * total:
                            break
            if left >= share * total:
                open_items.setdefault(row, []).append((k, left, spots))
    rows = list(open_items)
    bands = _bands(index, folded, rows) if rows else {}
    for g, row in enumerate(rows):
        text = folded[row]
        for k, left, spots in open_items[row]:
            total, held = int(index.total[k]), 0
            # sentences with the most numbers first: they exclude soonest
            for p in sorted(spots, key=lambda p: -index.need[p]):
                size = int(index.length[p])
                at = max(bands.get(g * patterns + p, ()), default=None)
                if at and matches(index, p, text, at[1]) or found_anywhere(index, p, text, *spots[p]):
                    held += size
                else:
                    left -= size
                if left < share * total:
                    break
            else:
                out.append((row, k, round(held / total, 6)))


def leaked_items(docs: DataFrame, items: Iterable[tuple], id_col: str = "doc_id", text_col: str = "text", item_name: str = "item_id", share: float = 0.5) -> DataFrame:
    """One row per document and item held to at least `share`: id, item_id, held.

    `items` are (id, text) rows of the stated query set; all documents are
    scanned against them, block by block of BLOCK_CHARS folded characters, so
    what is sent to the workers at once is bounded and no number of items is refused. Null or empty documents and items
    hold nothing; repeated documents give a row each. A narrow map per block.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_name, T.LongType()), T.StructField("held", T.DoubleType())])
    blocks: list[list[tuple]] = [[]]
    size = 0
    for item in items:
        n = len(item[1] or "")
        if blocks[-1] and size + n > BLOCK_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append(item)
        size += n
    result = None
    for block in blocks:
        index = build_index(block)

        def run(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = search(index, batch.column(1).to_pylist(), share)
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([index.item_ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=schema.names)

        part = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result
