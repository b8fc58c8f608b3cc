"""Repeated byte strings by a run-length index (run-compressed Burrows-Wheeler transform).

A byte goes if some string of ``WIDTH`` bytes that covers it also starts earlier: in a document of
smaller key, or in the same document further left. Strings never cross documents and are judged on
the input.

Dealing: every string of WIDTH bytes has a seed, its SEED-byte piece of least hash (the leftmost of
equal ones); equal strings have equal seeds at equal places. A document is cut into pieces, the
maximal runs of strings that have their seed in one place. Seeds that occur once in the corpus hold
no repeated string, so only pieces of repeated seeds go on. Equal pieces are one class, whose first
member stands for it (partial aggregation, so thousands of copies cost one row a task); every other
member is a repeat as a whole. The first members, with their bytes, are dealt by seed to buckets of
bounded size, so that all strings that could be equal meet in one bucket.

Index: a bucket's pieces are sorted by suffix; the transform is kept as its runs, with the text
positions at the run ends and the common length of the two suffixes that meet there. Matching
statistics are streamed in text order from these samples alone: from one sample to the next the
match moves along with the text and its length falls by one a byte. Matches of WIDTH or more chain
equal strings together; all but the earliest of a chain are marked.

A seed with more than ``HOT`` classes (a passage that a great many documents share, each with its own
neighbouring bytes) would not fit a bucket. Its strings are told apart one by one: each goes with its own
WIDTH bytes to the aggregation that finds its first place, so no bucket and no group is unbounded.

Defined cases: null or empty text keeps nothing and has no spans; documents of one key are one
document for the order (the smaller start is earlier, equal starts are not), so repeated rows get the
same result; a null key comes before all others; texts of any length are read in slices; an empty
table gives an empty result; input columns called like an added one are replaced. Pieces of a class are
told apart by 104 hash bits, documents of one key by 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.common import cut, drop, packed, unpacked

# Production parameters of op11.
WIDTH = 100               # bytes of a repeated string
SEED = 32                 # bytes of a seed
BUCKET = 1 << 18          # bytes of a bucket
HOT = 8192                # most classes of a seed that go to one bucket
SHARE = 4096              # seeds with more than 1/SHARE of all repeated pieces, so at most SHARE, are split
SALTS = 64                # parts of such a seed in joins
SLICE = 1 << 19           # bytes hashed at once
PLACE_BITS = np.uint64(24)

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _rng.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED (a power of two) bytes from each position on."""
    h, n = _BYTE[data], 1
    while n < SEED:
        h = h[:-n] * _STEP[n.bit_length()] + h[n:]
        n *= 2
    return _mixed(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each position on."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[:len(values) - (width - n)], values[width - n:]) if width > n else values


def pieces(data: np.ndarray, limits: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(document, start in the slice, length, seed, class) of all pieces of a slice of documents."""
    empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    n = len(data)
    if n < width:
        return empty
    with np.errstate(over="ignore"):
        hashes = seed_hashes(data)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = _least((hashes >> PLACE_BITS << PLACE_BITS) | places, width - SEED + 1)
        inside = np.zeros(n + 1, dtype=np.int32)
        long = np.diff(limits) >= width
        np.add.at(inside, limits[:-1][long], 1)
        np.add.at(inside, limits[1:][long] - width + 1, -1)
        at = np.flatnonzero(np.cumsum(inside)[:len(least)] > 0)
        if not len(at):
            return empty
        best = least[at]
        first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        start = at[first]
        length = np.diff(np.append(first, len(at))) + width - 1
        same = length.astype(np.uint64)
        for k in range(math.ceil((2 * width - SEED) / SEED)):
            same = _mixed(same * _STEP[-1] + hashes[start + np.minimum(k * SEED, length - SEED)])
    doc = np.searchsorted(limits, start, "right") - 1
    return doc, start, length, (best[first] >> PLACE_BITS).astype(np.int64), same.view(np.int64)


def text_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, limits, rows, offsets in their rows) of bounded slices; a long text is cut with an
    overlap of WIDTH - 1 bytes, so each string lies whole in exactly one slice."""
    bounds, data = _utf8(texts)
    parts: list[tuple[int, int, int, int]] = []
    held = 0
    for row in range(len(texts)):
        a, b = int(bounds[row]), int(bounds[row + 1])
        base = a
        while b - a >= WIDTH:
            end = min(b, a + SLICE)
            parts.append((a, end, row, a - base))
            held += end - a
            a = b if end == b else end - WIDTH + 1
            if held >= SLICE:
                yield _joined(data, parts)
                parts, held = [], 0
    if parts:
        yield _joined(data, parts)


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return bounds, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def _joined(data, parts):
    p = np.array(parts, dtype=np.int64)
    return (np.concatenate([data[a:b] for a, b in p[:, :2]]), np.concatenate(([0], np.cumsum(p[:, 1] - p[:, 0]))),
            p[:, 2], p[:, 3])


class RunIndex:
    """The run-compressed transform of a set of strings, each closed by a mark of its own.

    ``place``/``before``/``common``: for each run, the text position at its start, the position at
    the end of the run before, and how many bytes those two suffixes have in common.
    """

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        count, lengths = len(limits) - 1, np.diff(limits)
        self.starts = limits[:-1] + np.arange(count)         # with one closing mark after each string
        n = int(limits[-1]) + count
        self.size = n
        symbol = np.zeros(n, dtype=np.int32)
        marks = self.starts + lengths
        body = np.ones(n, dtype=bool)
        body[marks] = False
        symbol[body] = data.astype(np.int32) + 1
        self.last = np.repeat(marks, lengths + 1)
        order, steps = self._suffix_order(symbol, marks)
        runs = np.empty(n, dtype=bool)
        preceding = symbol[order - 1]                        # order - 1 = -1 is a closing mark too
        runs[0] = True
        runs[1:] = (preceding[1:] != preceding[:-1]) | (preceding[1:] == 0)
        at = np.flatnonzero(runs)
        self.place, self.before = order[at], order[np.maximum(at - 1, 0)]
        self.common = self._common(steps, self.place, self.before, symbol)
        self.common[0] = 0
        by_place = np.argsort(self.place)
        self.place, self.before, self.common = self.place[by_place], self.before[by_place], self.common[by_place]

    def _suffix_order(self, symbol, marks):
        """Prefix doubling; closing marks are the least symbols, in text order."""
        n, last = len(symbol), self.last
        here = np.arange(n)
        key = np.zeros(n, dtype=np.int64)
        count = len(marks) + 1                               # the first sort key: packed symbols, then the closing mark
        pack = next(k for k in range(6, 0, -1) if 257 ** k * count < 1 << 63)
        for k in range(pack):
            key = key * 257 + symbol[np.minimum(here + k, last)]
        near = last - here < pack
        key = key * count
        key[near] += np.repeat(np.arange(1, count), np.diff(np.append(self.starts, n)))[near]
        steps, length = [], pack
        while True:
            order = np.argsort(key)
            sorted_key = key[order]
            fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.maximum.accumulate(np.where(fresh, here, 0))
            rank[marks] = np.arange(len(marks))
            steps.append((length, rank.astype(np.int32)))
            if fresh.all():
                return order, steps
            key = rank * n + rank[np.minimum(here + length, last)]
            length *= 2

    def _common(self, steps, a, b, symbol):
        """Bytes that the suffixes at ``a`` and ``b`` have in common, by the ranks of the doubling."""
        a, b, common = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        same = a == b                                        # the first suffix has none before it
        for length, rank in reversed(steps):
            jump = np.where((rank[a] == rank[b]) & ~same, length, 0)
            a, b, common = a + jump, b + jump, common + jump
        alike = ~same
        for _ in range(steps[0][0]):
            alike &= symbol[a] == symbol[b]
            alike &= symbol[a] > 0
            a, b, common = a + alike, b + alike, common + alike
        return common

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position its lexicographic neighbour and the length of their match, from the samples."""
        sampled = np.zeros(self.size, dtype=np.int64)
        sampled[self.place] = 1
        k = np.cumsum(sampled) - 1                           # every string's start is a sample
        gone = np.arange(self.size) - self.place[k]
        return self.before[k] + gone, self.common[k] - gone

    def repeated(self, order: np.ndarray, width: int) -> np.ndarray:
        """Positions whose ``width`` bytes also stand at a place of smaller order. ``order``: of each
        string's start; places further right in a string count up from it."""
        neighbour, length = self.matching_statistics()
        out = np.zeros(self.size, dtype=bool)
        linked = np.flatnonzero(length >= width)
        if not len(linked):
            return out
        root = np.arange(self.size)
        root[linked] = neighbour[linked]
        todo = linked
        while len(todo):                                     # halve the way to the start of each chain
            further = root[root[todo]]
            moved = further != root[todo]
            root[todo] = further
            todo = todo[moved]
        at = np.unique(np.concatenate([linked, root[linked]]))
        string = np.searchsorted(self.starts, at, "right") - 1
        place = order[string] + (at - self.starts[string])
        of, chain = np.unique(root[at], return_inverse=True)
        earliest = np.full(len(of), np.iinfo(np.int64).max)
        np.minimum.at(earliest, chain, place)
        out[at] = place > earliest[chain]
        return out


def repeated_spans(strings: list[bytes], order: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(string, start, end) of the bytes to mark in each string."""
    limits = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    index = RunIndex(np.frombuffer(b"".join(strings), dtype=np.uint8), limits)
    marked = np.concatenate(([0], index.repeated(order, width).astype(np.int8), [0]))
    turns = np.flatnonzero(np.diff(marked))
    start, end = turns[::2], turns[1::2] - 1 + width         # a closing mark ends every string's spans
    string = np.searchsorted(index.starts, start, "right") - 1
    return list(zip(string.tolist(), (start - index.starts[string]).tolist(), (end - index.starts[string]).tolist()))


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def find_spans(docs: DataFrame, width: int = WIDTH, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(key, text) -> (key, th, spans): the spans to remove of each document that has some; th = xxhash64(text)."""
    if width < 2 * SEED:
        raise ValueError(f"width must be at least {2 * SEED} bytes")
    docs = docs.select("key", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = docs.schema["key"].dataType
    place = [_field("key", kind), _field("th", T.LongType())]
    long_, int_ = T.LongType(), T.IntegerType()

    def seeds_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, limits, _, _ in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(pieces(data, limits, width)[3])], ["seed"])

    def all_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, limits, rows, offsets in text_slices(batch.column("text")):
                doc, start, length, seed, same = pieces(data, limits, width)
                of = pa.array(rows[doc])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(of), batch.column("th").take(of), pa.array(seed), pa.array(same),
                     pa.array((start - limits[doc] + offsets[doc]).astype(np.int32)), pa.array(length.astype(np.int32)),
                     pa.array(np.where(np.isin(seed, crowds_of), np.arange(len(seed)) % SALTS, 0).astype(np.int32))],
                    ["key", "th", "seed", "class", "start", "length", "salt"])

    seeds = cut(docs.select("text").mapInArrow(seeds_only, "seed long").groupBy("seed").count().where("count > 1"), "seeds")
    repeated = seeds.agg(F.sum("count")).first()[0] or 0
    crowds_of = np.array([r[0] for r in seeds.where(F.col("count") > repeated / SHARE).select("seed").collect()], dtype=np.int64)

    def salted(table: DataFrame) -> DataFrame:
        """A copy for each salt of the seeds that are split."""
        salts = F.when(F.col("seed").isin(crowds_of.tolist()), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return table.withColumn("salt", F.explode(salts))

    found = T.StructType([*place, _field("seed", long_), _field("class", long_), _field("start", int_), _field("length", int_),
                          _field("salt", int_)])
    # Both sides grow with the corpus: joined by key at every size, never broadcast.
    held = cut(docs.mapInArrow(all_pieces, found).join(salted(seeds.select("seed")).hint("merge"), ["seed", "salt"]), "pieces")
    drop(seeds)
    classes = cut(held.groupBy("seed", "class").agg(F.min(F.struct("key", "start", "th", "length")).alias("first"), F.count(F.lit(1)).alias("n")), "classes")

    size = classes.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.sum("first.length").alias("bytes"))
    total = size.where(F.col("n") <= hot).agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket))
    crowded = size.where(F.col("n") > hot).select("seed", F.lit(True).alias("crowded"))
    wanted = (classes.join(crowded.hint("merge"), "seed", "left")
              .groupBy(F.col("first.key").alias("key"), F.col("first.th").alias("th"))
              .agg(F.collect_list(F.struct("seed", F.col("first.start").alias("start"), F.col("first.length").alias("length"),
                                           F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("wanted")))

    def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = _utf8(batch.column("text"))
            lists = batch.column("wanted")
            flat = lists.flatten()
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            seed, hot_one = flat.field("seed").to_numpy(), flat.field("crowded").to_numpy(zero_copy_only=False)
            for lo in range(0, len(rows), 10_000):
                out: list[tuple[int, int, int, bytes]] = []
                for r, s, n, g, h in zip(*(x[lo:lo + 10_000].tolist() for x in (rows, start, length, seed, hot_one))):
                    a = int(bounds[r]) + s
                    whole = data[a:a + n].tobytes()
                    if h:
                        out += [(r, s + k, -1, whole[k:k + width]) for k in range(n - width + 1)]
                    else:
                        out.append((r, s, g % buckets, whole))
                r, s, b, text = zip(*out)
                of = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(of), batch.column("th").take(of), pa.array(s, pa.int32()),
                     pa.array(b, pa.int64()), pa.array(text, pa.binary())], ["key", "th", "start", "bucket", "bytes"])

    fetched = T.StructType([*place, _field("start", int_), _field("bucket", long_), _field("bytes", T.BinaryType())])
    same_doc = (docs["key"].eqNullSafe(wanted["key"])) & (docs["th"] == wanted["th"])
    firsts = cut(docs.join(wanted.hint("merge"), same_doc).select(docs["key"], docs["th"], "text", "wanted")
                 .mapInArrow(with_bytes, fetched), "firsts")

    def mark(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rank = pc.rank(group.column("key"), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        start = group.column("start").to_numpy().astype(np.int64)
        order = (rank << 32) + start
        keep = np.lexsort((start, rank))                     # in document order
        strings = group.column("bytes").to_pylist()
        spans = repeated_spans([strings[i] for i in keep], order[keep], width)
        of = np.array([keep[s] for s, _, _ in spans], dtype=np.int64)
        at = start[of] if len(of) else np.zeros(0, dtype=np.int64)
        return pa.table({"key": group.column("key").take(pa.array(of)), "th": group.column("th").take(pa.array(of)),
                         "start": pa.array((at + np.array([a for _, a, _ in spans], dtype=np.int64)).astype(np.int32)),
                         "end": pa.array((at + np.array([b for _, _, b in spans], dtype=np.int64)).astype(np.int32))})

    span = T.StructType([*place, _field("start", int_), _field("end", int_)])
    # A document given several times sends its pieces several times: equal rows count once.
    indexed = firsts.where("bucket >= 0").dropDuplicates().groupBy("bucket").applyInArrow(mark, span)
    single = firsts.where("bucket < 0").select("key", "th", "start", F.col("bytes"))
    earliest = single.groupBy("bytes").agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowds = (single.join(earliest.hint("merge"), "bytes").where(F.struct("key", "start") > F.col("first"))
              .select("key", "th", "start", (F.col("start") + width).alias("end")))
    # A class of one piece has no further members.
    members = (held.join(salted(classes.where("n > 1").drop("n")).hint("merge"), ["seed", "class", "salt"])
               .where(F.struct("key", "start") > F.struct("first.key", "first.start"))
               .select("key", "th", "start", (F.col("start") + F.col("length")).alias("end")))
    spans = (members.unionByName(indexed).unionByName(crowds)
             .groupBy("key", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    out = cut(spans, "spans")
    drop(held, classes, firsts)
    return out


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, bucket: int = BUCKET,
                   hot: int = HOT) -> DataFrame:
    """Input rows with ``removed``, the maximal removed runs of bytes, and ``kept``, the remaining bytes."""
    rows = packed(df)
    docs = rows.select("row", F.col("row").getField(key).alias("key"),
                       F.coalesce(F.col("row").getField(text), F.lit("")).alias("text"))
    spans = find_spans(docs.select("key", "text"), width, bucket, hot)
    docs = docs.withColumn("th", F.xxhash64("text"))

    @F.pandas_udf("struct<removed:array<struct<start:int,end:int>>,kept:binary>")
    def apart(texts, found):
        import pandas as pd

        removed, kept = [], []
        for text, spans in zip(texts, found):
            raw = text.encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for a, b in sorted((int(s["start"]), int(s["end"])) for s in spans) if spans is not None else ():
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            ends = [0] + [b for _, b in runs]
            removed.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(raw[a:b] for a, b in zip(ends, [a for a, _ in runs] + [len(raw)])))
        return pd.DataFrame({"removed": removed, "kept": kept})

    same_doc = docs["key"].eqNullSafe(spans["key"]) & (docs["th"] == spans["th"])
    out = docs.join(spans.hint("merge"), same_doc, "left").select("row", docs["text"], "spans")
    out = out.withColumn("x", apart("text", "spans"))
    return unpacked(out.select("row", F.col("x.removed").alias("removed"), F.col("x.kept").alias("kept")), "removed", "kept")
