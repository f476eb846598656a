"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted similarity.

Documents are compared with the benchmark's items, a stated query set that is taken
in blocks of bounded size. A window has as many words as an item. It gets a
fingerprint wherever it starts, unless the shingles that it shares with items of its
size weigh too little for the threshold even if one item held them all. Fingerprints
have ``BITS`` bits of the window's words.
They are cut into ``RADIUS + 1`` blocks: two that differ in at most ``RADIUS`` bits
agree in a block, so looking up every block finds all items within the radius.
Each candidate is then judged by the weighted Jaccard similarity of the two
shingle multisets; a shingle that fewer items of the whole benchmark hold weighs more.

Documents never move: the items' index goes to the tasks, and each row is judged
where it is.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .shared_files import ready
from .text_arrays import combine, mix, shingle_sets, slices, utf8, words

SHINGLE = 5
THRESHOLD = 0.75
BITS = 64
#: At similarity 0.75 at most some 13 % of the words differ: 10.5 bits of 64 on average, 3 of deviation.
RADIUS = 24
#: Items of one pass over the documents, in bytes of text.
ITEM_BYTES = 8 << 20
HITS = "array<struct<item_id:long,similarity:double,first_word:long,last_word:long,begin:long,end:long>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), *[(n, pa.int64()) for n in ("first_word", "last_word", "begin", "end")]]))
_FILTER_BITS = 22
#: More than the rounding of a sum of weights.
SLACK = 1e-6


def fingerprints(windows: np.ndarray) -> np.ndarray:
    """SimHash of rows of word hashes."""
    out = np.empty(len(windows), np.uint64)
    places = np.arange(BITS, dtype=np.uint64)
    step = max(1, (1 << 22) // (BITS * max(1, windows.shape[1])))
    for a in range(0, len(windows), step):
        bits = (mix(windows[a : a + step])[:, :, None] >> places) & np.uint64(1)
        most = 2 * bits.sum(axis=1, dtype=np.int64) > windows.shape[1]
        out[a : a + step] = (most.astype(np.uint64) << places).sum(axis=1, dtype=np.uint64)
    return out


def sliding_fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """SimHash of every run of ``length`` words."""
    mixed, n = mix(hashes), len(hashes) - length + 1
    out = np.zeros(n, np.uint64)
    for place in np.arange(BITS, dtype=np.uint64):
        sums = np.concatenate(([0], np.cumsum((mixed >> place) & np.uint64(1), dtype=np.int64)))
        out |= (2 * (sums[length:] - sums[:n]) > length).astype(np.uint64) << place
    return out


def _window_sums(values: np.ndarray, span: int) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[span:] - sums[:-span]


def _heavy(begin: np.ndarray, end: np.ndarray, weight: np.ndarray, need: float) -> Iterator[tuple[int, int]]:
    """Maximal ranges of places where the weights of the intervals ``[begin, end)`` that cover them sum up to ``need``."""
    at = np.concatenate((begin, end))
    order = np.argsort(at, kind="stable")
    at, total = at[order], np.cumsum(np.concatenate((weight, -weight))[order])
    last = np.flatnonzero(np.concatenate((at[1:] != at[:-1], [True]))) if len(at) else order
    at, enough = at[last], total[last] >= need
    edges = np.flatnonzero(np.diff(np.concatenate(([False], enough, [False])).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield int(at[a]), int(at[b])


class Items:
    """Index of a block of items; ``n`` and ``shared`` (shingle -> items that hold it, if several) count the whole benchmark."""

    def __init__(self, ids: list[int], texts: list[str], n: int | None = None, shared: dict[int, int] | None = None):
        hashes, _, _, first = words(*utf8(pa.array(texts, pa.string())))
        self.ids, self.size, self.shingles, anchors = [], [], [], defaultdict(set)
        by_length: dict[int, list[int]] = defaultdict(list)
        own_words = []
        for item, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
            if a == b:
                continue  # an item without words is in no document
            size = min(SHINGLE, b - a)
            grams = combine(hashes[a:b], size)
            number = len(self.ids)
            self.ids.append(item)
            self.size.append(size)
            self.shingles.append(Counter(grams.tolist()))
            own_words.append(hashes[a:b])
            by_length[b - a].append(number)
            for g in grams.tolist():
                anchors[size, g].add(b - a)
        held = Counter(g for s in self.shingles for g in s)
        if shared is not None:
            held = {g: shared.get(g, 1) for g in held}
        n = len(self.ids) if n is None else n
        self.weight = {g: float(np.log2(1 + n / k)) for g, k in held.items()}
        self.rare = float(np.log2(1 + n))
        self.whole = [sum(self.weight[g] * k for g, k in s.items()) for s in self.shingles]
        self.least = {length: min(self.whole[i] for i in numbers) for length, numbers in by_length.items()}
        self.sizes = sorted({size for size, _ in anchors})
        self.anchors = {k: sorted(v) for k, v in anchors.items()}
        self.known = {s: np.array(sorted(g for size, g in anchors if size == s), np.uint64) for s in self.sizes}
        self.weights = {s: np.array([self.weight[g] for g in self.known[s].tolist()]) for s in self.sizes}
        self.filter = {}
        for s in self.sizes:
            self.filter[s] = np.zeros(1 << _FILTER_BITS, bool)
            self.filter[s][self.known[s] >> np.uint64(64 - _FILTER_BITS)] = True
        # Blocks of the fingerprints of the items of one length: block value -> items.
        edges = np.linspace(0, BITS, RADIUS + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.prints, self.index = {}, {}
        for length, numbers in by_length.items():
            marks = fingerprints(np.stack([own_words[i] for i in numbers]))
            self.prints[length] = (np.array(numbers), marks)
            table = []
            for shift, mask in self.blocks:
                rows: dict[int, list[int]] = defaultdict(list)
                for row, value in enumerate(((marks >> shift) & mask).tolist()):
                    rows[value].append(row)
                table.append({v: np.array(r) for v, r in rows.items()})
            self.index[length] = table

    def near(self, length: int, mark: np.uint64) -> np.ndarray:
        """Items of a length whose fingerprint is within the radius."""
        found = [t.get(int((mark >> shift) & mask)) for t, (shift, mask) in zip(self.index[length], self.blocks, strict=True)]
        found = [f for f in found if f is not None]
        if not found:
            return np.zeros(0, np.int64)
        numbers, marks = self.prints[length]
        rows = np.unique(np.concatenate(found))
        return numbers[rows[np.bitwise_count(marks[rows] ^ mark) <= RADIUS]]

    def similarity(self, grams: Counter, number: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        item = self.shingles[number]
        both = whole = 0.0
        for g in grams.keys() | item.keys():
            weight = self.weight.get(g, self.rare)
            both += weight * min(grams[g], item[g])
            whole += weight * max(grams[g], item[g])
        return both / whole if whole else 0.0

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, last word + 1) of windows near an item, the best of every row and item among them."""
        held: dict[int, list[int]] = defaultdict(list)
        weight: dict[int, list[float]] = defaultdict(list)
        for size in self.sizes:
            grams = combine(hashes, size)
            some = np.flatnonzero(self.filter[size][grams >> np.uint64(64 - _FILTER_BITS)])
            if not len(some):
                continue
            at = np.searchsorted(self.known[size], grams[some])
            some = some[self.known[size][np.minimum(at, len(self.known[size]) - 1)] == grams[some]]
            rows = np.searchsorted(first, some, side="right") - 1
            some = some[some + size <= first[rows + 1]]
            for p, g in zip(some.tolist(), grams[some].tolist(), strict=True):
                for length in self.anchors[size, g]:
                    held[length].append(p)
                    weight[length].append(self.weight[g])
        for length, places in held.items():
            at, w = np.array(places, np.int64), np.array(weight[length])
            rows = np.searchsorted(first, at, side="right") - 1
            need = THRESHOLD * self.least[length] - SLACK
            fits = first[rows + 1] - first[rows] >= length
            begin = np.maximum(at + min(SHINGLE, length) - length, first[rows])[fits]
            end = np.minimum(at, first[rows + 1] - length)[fits] + 1
            for a, b in _heavy(begin, end, w[fits], need):
                # Rows' starts may adjoin, if items have one word.
                cuts = first[np.searchsorted(first, a, side="right") : np.searchsorted(first, b)]
                for s, e in zip([a, *cuts.tolist()], [*cuts.tolist(), b], strict=True):
                    if s < e:
                        yield from self._slid(int(np.searchsorted(first, s, side="right")) - 1, s, e, length, hashes)
            # A document of fewer words than the item is one window, too short for a print of that size.
            short, place = np.unique(rows[~fits], return_inverse=True)
            for row, total in zip(short.tolist(), np.bincount(place, w[~fits], len(short)).tolist(), strict=True):
                if total >= need:
                    yield from self._judged(row, int(first[row]), int(first[row + 1]), hashes, self.prints[length][0])

    def _slid(self, row: int, a: int, b: int, length: int, hashes: np.ndarray) -> Iterator[tuple]:
        """The windows of a length that start in ``[a, b)``, all in one row: of every item near one, the best."""
        step = max(1, (1 << 22) // BITS)
        starts: dict[int, list[int]] = defaultdict(list)
        for s in range(a, b, step):
            e = min(b, s + step)
            marks, where = np.unique(sliding_fingerprints(hashes[s : e + length - 1], length), return_inverse=True)
            near = [self.near(length, mark).tolist() for mark in marks]
            for k, mark in enumerate(where.tolist()):
                for number in near[mark]:
                    starts[number].append(s + k)
        if not starts:
            return
        size = min(SHINGLE, length)
        grams = combine(hashes[a : b + length - 1], size)
        known, weights = self.known[size], self.weights[size]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        weight = np.where(known[at] == grams, weights[at], self.rare)
        span = length - size + 1
        total = _window_sums(weight, span)
        for number, places in sorted(starts.items()):
            own = np.isin(grams, np.array(list(self.shingles[number]), np.uint64))
            own = _window_sums(np.where(own, weight, 0.0), span)
            places = np.array(places, np.int64)
            # At most so much weight is in both: repeats within the window are not bounded by the item's.
            both = np.minimum(own[places - a], self.whole[number])
            most = both / (total[places - a] + self.whole[number] - both) + SLACK
            best, best_at = 0.0, -1
            for k in np.lexsort((places, -most)).tolist():
                if most[k] < max(THRESHOLD, best):
                    break
                s = int(places[k])
                if best >= 1.0 and s > best_at:
                    continue
                for found in self._judged(row, s, s + length, hashes, np.array([number])):
                    if (found[2], -s) > (best, -best_at):
                        best, best_at = found[2], s
            if best_at >= 0:
                yield row, number, best, best_at, best_at + length

    def _judged(self, row: int, a: int, b: int, hashes: np.ndarray, numbers: np.ndarray) -> Iterator[tuple]:
        grams: dict[int, Counter] = {}
        for number in numbers.tolist():
            size = min(self.size[number], b - a)
            if size not in grams:
                grams[size] = Counter(combine(hashes[a:b], size).tolist())
            score = self.similarity(grams[size], number)
            if score >= THRESHOLD:
                yield row, number, score, a, b


def _best_hits(index: Items, column: pa.Array) -> Iterator[list[dict]]:
    """Of each text, the best window of every item that it holds."""
    data, offsets = utf8(column)
    hashes, starts, ends, first = words(data, offsets)
    best: dict[int, dict[int, tuple]] = defaultdict(dict)
    for row, number, score, a, b in index.hits(hashes, first):
        kept = best[row].get(number)
        if kept is None or (score, -a) > (kept[0], -kept[1]):
            best[row][number] = (score, a, b)
    for row in range(len(column)):
        yield [
            {
                "item_id": index.ids[number], "similarity": score,
                "first_word": a - int(first[row]), "last_word": b - 1 - int(first[row]),
                "begin": int(starts[a] - offsets[row]), "end": int(ends[b - 1] - offsets[row]),
            }
            for number, (score, a, b) in sorted(best.get(row, {}).items())
        ]


def benchmark_hits(benchmark: DataFrame, text: Column, item_id: str = "item_id", item_text: str = "text") -> Column:
    """Array of the hits of a text column, computed where the row is; see ``decontaminate``."""
    spark = benchmark.sparkSession
    ready(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("long"), F.lit(-1)).alias("id"), F.col(item_text).alias("text")).filter("text != ''")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-n_bytes // ITEM_BYTES)

    def against(held) -> Column:
        def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = Items(*held.value)
            for column in columns:
                hits: list[list[dict]] = []
                for batch in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text"):
                    hits += _best_hits(index, batch.column("text"))
                yield pa.array(hits, _HITS)

        return F.arrow_udf(judge, HITS)(text)

    items = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks))).cast("long"))
    n, shared = _shared(items) if blocks > 1 else (None, None)
    found = []
    for k in range(blocks):
        block = items.filter(F.col("block") == k).orderBy("id", "text").collect()
        own = None
        if shared is not None:
            counts = shared.filter(F.array_contains("blocks", F.lit(k).cast("long"))).select("gram", "k").toArrow()
            own = dict(zip(counts["gram"].to_numpy().view(np.uint64).tolist(), counts["k"].to_pylist(), strict=True))
        found.append(against(spark.sparkContext.broadcast(([r["id"] for r in block], [r["text"] for r in block], n, own))))
    return F.array_sort(F.concat(*found)) if found else F.array().cast(HITS)


def _shared(items: DataFrame) -> tuple[int, DataFrame]:
    """Of the whole benchmark: items that have words, and ``(gram, k, blocks)`` of the shingles that ``k`` > 1 items hold."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*utf8(batch.column("text")), SHINGLE)
            block = np.repeat(batch.column("block").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.concatenate(sets).view(np.int64))], names=["block", "gram"])

    n = items.filter(F.col("text").rlike(r"[^\x20\x09-\x0d]")).count()
    held = items.select("block", "text").mapInArrow(grams, "block long, gram long")
    return n, kept(held.groupBy("gram").agg(F.count("*").alias("k"), F.collect_set("block").alias("blocks")).filter("k > 1"), "item-shingles")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per input row: ``(id_col, contaminated, n_items, item_ids, best_similarity, hits)``.

    A document is contaminated if a window of it has a similarity of 0.75 or more to
    an item. Of each item the best window is reported (the first of equals) with its
    words and its bytes in the UTF-8 text. Words are runs without ASCII white space,
    A-Z lowered. Null, empty and blank texts and items match nothing; an item of fewer
    than five words is one shingle and matches its exact words. Equal items are
    reported each; a null item id is reported as -1. An empty benchmark leaves all
    clean; an empty table gives no rows; other columns are not read.
    """
    hits = benchmark_hits(benchmark, F.col(text_col), item_id, item_text)
    rows = docs.select(F.col(id_col).alias("id"), hits.alias("hits"))
    ids = F.array_sort(F.transform("hits", lambda h: h["item_id"]))
    return rows.select(
        F.col("id").alias(id_col),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.array_max(F.transform("hits", lambda h: h["similarity"])).alias("best_similarity"),
        "hits",
    )
