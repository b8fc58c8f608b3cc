"""Alignment of two tokenizers on the same bytes by lockstep merging.

Both tokenizers read the same bytes (a blank, then the text). Where a token of A and one of B end
together is a cut; the tokens between two cuts are a group, and every A token of a group is linked
with every B token of it.

Merging: the documents of a unit (a few megabytes) are merged at once. One NumPy state vector holds, for
every lane, the next A and B token and where its group began. A step moves on the side whose token ends
first, or both at a cut, which emits the group and its links; finished lanes are compacted away. A
long document has a lane every ``LANE`` bytes: a lane looks for the first cut after its start and
emits from there to the first cut after its end, where the next lane begins.

Corpus counts: a unit sends each distinct pair of ids once with its number of documents, so a pair
that stands in every document costs one row a unit. The counts come back by unit in the same way.

Between the stages a unit is many rows (``slices``) in row groups of a few megabytes: readers and writers
of Parquet hold a row group at a time, and a writer looks at the size of one only every so many rows.

Defined cases: a null or empty text, and one whose joined tokens differ from its bytes under either
tokenizer, has no tokens: zeros, and empty ``groups``; repeated rows count as documents of their
own and are all returned; null keys and texts of any length are taken; an empty table gives an empty
result; other columns of the input are left out, so none can clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barspark.llm.common import cut

# Production parameters of op13.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
UNIT = 2 << 20            # bytes of text of a unit
LANE = 512                # bytes of a lane
LARGE = 1024              # pairs from which a group's ids are made distinct before pairing
SLICE = 8192              # documents, pairs or links in a row of the table between the stages
ROW_GROUP = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
KINDS = (("key", "n_a", "n_b", "n_groups", "n_links", "sha", "groups"), ("pairs", "held"), ("docs", "slots", "times"))
DIGESTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level pieces: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """The bytes of all ids, joined."""

    def __init__(self, pieces: list[bytes]):
        self.bytes = pieces
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a token sequence."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.joined[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel(Vocabulary):
    """Tokenizer A. The merges of its file are listed in the order of their ids, so the vocabulary serves as ranks."""

    # Fixed value: how this tokenizer splits a text before merging.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        pieces = {i: bytes(alphabet[c] for c in p) for p, i in model["vocab"].items() if all(c in alphabet for c in p)}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"][m.replace(" ", "")] for m in merges]
        if ids != sorted(ids):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        last = max(ids)                                      # later ids come from no merge: never found in a text
        ranks = {b: i for i, b in pieces.items() if i <= last}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        super().__init__([pieces.get(i, b"") for i in range(last + 1)])

    def encode(self, texts: list[str]) -> list:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces(Vocabulary):
    """Tokenizer B, which puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        p = self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                pieces.append(bytes([int(piece[3:5], 16)]))
            else:
                pieces.append(b"" if p.is_control(i) or p.is_unknown(i) else piece.replace("\u2581", " ").encode())
        super().__init__(pieces)

    def encode(self, texts: list[str]) -> list:
        return self.processor.encode(texts, out_type=int, num_threads=1)


class _Loaded(dict):
    """Tokenizers of this process; travels to tasks empty, since they load their own."""

    def __reduce__(self):
        return _Loaded, ()


_loaded = _Loaded()


def _tokenizer(kind, folder: str, name: str):
    if (kind.__name__, folder, name) not in _loaded:
        _loaded[kind.__name__, folder, name] = kind(os.path.join(folder, name))
    return _loaded[kind.__name__, folder, name]


def merge(a_ends: np.ndarray, b_ends: np.ndarray, limits: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Groups as rows (first A, end A, first B, end B), in order.

    ``a_ends``, ``b_ends``: byte ends of all tokens in the joined bytes of the documents, rising;
    ``limits``: byte limits of the documents. Documents without tokens have no bytes here.
    """
    lengths = np.diff(limits)
    lanes = -(-lengths // lane)
    doc = np.repeat(np.arange(len(lengths)), lanes)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = limits[doc] + within * lane
    stop = np.minimum(start + lane, limits[doc + 1])
    i = np.searchsorted(a_ends, start, "right")              # a document's first lane begins at its first tokens,
    j = np.searchsorted(b_ends, start, "right")              # the others at the tokens that end from ``start`` on
    inner = within > 0
    i[inner], j[inner] = np.searchsorted(a_ends, start[inner]), np.searchsorted(b_ends, start[inner])
    group_a, group_b, emits = i.copy(), j.copy(), ~inner
    found = []
    while len(i):
        a, b = a_ends[i], b_ends[j]
        next_a, next_b = i + (a <= b), j + (b <= a)
        cuts = np.flatnonzero(a == b)
        if len(cuts):
            out = cuts[emits[cuts]]
            found.append(np.stack([group_a[out], next_a[out], group_b[out], next_b[out]], axis=1))
            group_a[cuts], group_b[cuts], emits[cuts] = next_a[cuts], next_b[cuts], True
            alive = np.ones(len(i), dtype=bool)
            alive[cuts[a[cuts] >= stop[cuts]]] = False
            if not alive.all():
                next_a, next_b, stop = next_a[alive], next_b[alive], stop[alive]
                group_a, group_b, emits = group_a[alive], group_b[alive], emits[alive]
        i, j = next_a, next_b
    groups = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    return groups[np.argsort(groups[:, 0], kind="stable")]


def links(groups: np.ndarray, group_doc: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, width: int,
          size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document * size + A id * width + B id) and how often each is linked."""
    na, nb = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    small = na * nb < LARGE
    g, ca, cb = groups[small], na[small], nb[small]
    per = ca * cb
    row = np.repeat(np.arange(len(g)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    a = a_ids[g[row, 0] + k // cb[row]]
    b = b_ids[g[row, 2] + k % cb[row]]
    keys, times = [group_doc[small][row] * size + a * width + b], [np.ones(len(row), dtype=np.int64)]
    for (a0, a1, b0, b1), d in zip(groups[~small].tolist(), group_doc[~small].tolist()):
        ua, xa = np.unique(a_ids[a0:a1], return_counts=True)
        ub, xb = np.unique(b_ids[b0:b1], return_counts=True)
        keys.append((d * size + ua[:, None] * width + ub[None, :]).ravel())
        times.append((xa[:, None] * xb[None, :]).ravel())
    if len(keys) == 1:
        found, times = np.unique(keys[0], return_counts=True)
        return found, times
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, weights=np.concatenate(times), minlength=len(found)).astype(np.int64)


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    limits = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    return np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64, count=int(limits[-1])), limits


def _parts(values: np.ndarray, limits: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the chosen documents, and their limits."""
    if chosen.all():
        return values, limits
    lengths = np.diff(limits)
    return values[np.repeat(chosen, lengths)], np.concatenate(([0], np.cumsum(lengths[chosen])))


def written_groups(groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2;`` for all groups, and where each token's bytes begin."""
    n = len(a_ids) + len(b_ids)
    group_of_a = np.repeat(np.arange(len(groups)), groups[:, 1] - groups[:, 0])
    group_of_b = np.repeat(np.arange(len(groups)), groups[:, 3] - groups[:, 2])
    ids, follow = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
    ids[np.arange(len(a_ids)) + groups[group_of_a, 2]] = a_ids
    ids[np.arange(len(b_ids)) + groups[group_of_b, 1]] = b_ids
    follow[groups[:, 1] + groups[:, 2] - 1] = ord("|")
    follow[groups[:, 1] + groups[:, 3] - 1] = ord(";")
    size = int(ids.max(initial=0)) + 1
    digits = np.arange(size).astype("S").view(np.uint8).reshape(size, -1)
    width = digits.shape[1]
    length = (digits != 0).sum(axis=1)
    cells = np.zeros((n, width + 1), dtype=np.uint8)
    cells[:, :width] = digits[ids]
    cells[np.arange(n), length[ids]] = follow
    return cells[cells != 0].tobytes(), np.concatenate(([0], np.cumsum(length[ids] + 1)))


def align(texts: list[str | None], tokenizer_a, tokenizer_b, keep_groups: bool = True) -> dict:
    """The merged unit: counts and group digest per document, distinct pairs and links per document."""
    size_a, size_b = len(tokenizer_a.bytes), len(tokenizer_b.bytes)
    some = [d for d, t in enumerate(texts) if t]
    raw = [(" " + texts[d]).encode("utf-8", "surrogatepass") for d in some]
    limits = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
    sides = [_joined(tok.encode([texts[d] for d in some])) for tok in (tokenizer_a, tokenizer_b)]
    valid = np.ones(len(some), dtype=bool)
    for tok, (ids, bounds) in zip((tokenizer_a, tokenizer_b), sides):
        read = np.concatenate(([0], np.cumsum(tok.lengths[ids])))[bounds]
        valid &= np.diff(read) == np.diff(limits)
    whole = np.frombuffer(b"".join(raw), dtype=np.uint8)
    for tok, (ids, bounds) in zip((tokenizer_a, tokenizer_b), sides):
        right = valid.copy()
        chosen, _ = _parts(ids, bounds, right)
        text, text_limits = _parts(whole, limits, right)
        wrong = np.flatnonzero(tok.spell(chosen) != text)
        valid[np.flatnonzero(right)[np.unique(np.searchsorted(text_limits, wrong, "right") - 1)]] = False
    (a_ids, a_limits), (b_ids, b_limits) = (_parts(*side, valid) for side in sides)
    limits = np.concatenate(([0], np.cumsum(np.diff(limits)[valid])))
    groups = merge(np.cumsum(tokenizer_a.lengths[a_ids]), np.cumsum(tokenizer_b.lengths[b_ids]), limits)
    n_docs = int(valid.sum())
    group_doc = np.searchsorted(a_limits, groups[:, 0], "right") - 1
    sizes = (groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2])
    total = np.concatenate(([0], np.cumsum(sizes)))
    group_limits = np.searchsorted(group_doc, np.arange(n_docs + 1))
    width, size = size_b, size_a * size_b
    keys, times = links(groups, group_doc, a_ids, b_ids, width, size)
    pairs, slot, held = np.unique(keys % size, return_inverse=True, return_counts=True)
    where = np.array(some, dtype=np.int64)[valid]
    out = {name: np.zeros(len(texts), dtype=np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    out["n_a"][where], out["n_b"][where] = np.diff(a_limits), np.diff(b_limits)
    out["n_groups"][where], out["n_links"][where] = np.diff(group_limits), np.diff(total[group_limits])
    written, at = written_groups(groups, a_ids, b_ids)
    digest, spelled = [""] * len(texts), [""] * len(texts) if keep_groups else [None] * len(texts)
    bounds = at[a_limits + b_limits].tolist()
    for d, lo, hi in zip(where.tolist(), bounds[:-1], bounds[1:]):
        digest[d] = hashlib.sha256(written[lo:hi - 1]).hexdigest()
        if keep_groups:
            spelled[d] = written[lo:hi - 1].decode()
    return out | {"sha": digest, "groups": spelled, "pairs": pairs, "held": held, "slots": slot.astype(np.int32),
                  "times": times, "docs": where[keys // size].astype(np.int32)}


def unit_rows(lengths: list[int], bound: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``bound`` bytes together, or one row."""
    lo = size = 0
    for k, n in enumerate(lengths):
        if k > lo and size + n > bound:
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(lengths):
        yield lo, len(lengths)


def slices(found: dict) -> Iterator[dict]:
    """A unit as rows of one kind: ``SLICE`` documents, pairs or links, from the ``first`` one on; links as bytes."""
    for kind, names in enumerate(KINDS):
        for lo in range(0, len(found[names[0]]), SLICE):
            part = {c: found[c][lo:lo + SLICE] for c in names}
            yield {"kind": kind, "first": lo} | ({c: v.tobytes() for c, v in part.items()} if kind == 2 else part)


def align_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, a_file: str = A_FILE,
                 b_file: str = B_FILE, unit: int = UNIT, keep_groups: bool = False) -> DataFrame:
    """One row per input row: its key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256`` and, with ``keep_groups``, the ``groups`` themselves (``a1,a2|b1;a3|b2``)."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    per_doc = [T.StructField("key", T.ArrayType(rows.schema["key"].dataType)),
               *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("n_a", "n_b", "n_groups", "n_links")],
               *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("sha", "groups")]]
    pair_lists = [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.LongType()))]
    link_lists = [T.StructField(c, T.BinaryType()) for c in ("docs", "slots", "times")]
    place = [T.StructField("unit", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("first", T.LongType())]
    schema = T.StructType([*place, *per_doc, *pair_lists, *link_lists])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizer(ByteLevel, folder, a_file), _tokenizer(Pieces, folder, b_file)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for lo, hi in unit_rows(lengths, unit):
                found = align(batch.column("text").slice(lo, hi - lo).to_pylist(), a, b, keep_groups)
                found["key"] = batch.column("key").slice(lo, hi - lo).to_pylist()
                for row in slices(found):
                    row["unit"] = number
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], to_arrow_type(f.dataType)) for f in schema.fields],
                                                     schema.names)
                number += 1

    units = cut(rows.mapInArrow(merged, schema), "units", **ROW_GROUP)
    pairs_of = units.where("kind = 1")
    width = len(_tokenizer(Pieces, folder, b_file).bytes)
    counts = (pairs_of.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(F.col("p.pairs").alias("pair"))
              .agg(F.sum("p.held").alias("count")))
    # At most as many rows for one A id as B has ids.
    of_a = Window.partitionBy(F.expr(f"pair div {width}"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    known = (pairs_of.select(F.col("unit").alias("of_unit"), "first", F.posexplode("pairs").alias("place", "pair"))
             .select("of_unit", (F.col("first") + F.col("place")).alias("slot"), "pair")
             .join(counts.hint("merge"), "pair").select("of_unit", "slot", "count", "best"))

    def counted(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, dtype=np.int64), np.zeros(pairs.num_rows, dtype=np.int64)
        slot = pairs.column("slot").to_numpy()
        count[slot] = pairs.column("count").to_numpy()
        best[slot] = pairs.column("best").to_numpy()
        documents = rows.filter(pc.equal(rows.column("kind"), 0))
        sizes, first = pc.list_value_length(documents.column("n_a")).to_numpy(), documents.column("first").to_numpy()
        total = {c: np.zeros(sizes.sum(), dtype=np.int64) for c in ("n_best", "count_sum")}
        for cells in zip(*(rows.column(c) for c in KINDS[2])):
            if cells[0].is_valid:
                docs, slots, times = (np.frombuffer(v.as_buffer(), dtype=t) for v, t in zip(cells, (np.int32, np.int32, np.int64)))
                start = np.flatnonzero(np.diff(docs, prepend=-1))  # links lie in document order
                for c, of_pair in (("n_best", best), ("count_sum", count)):
                    total[c][docs[start]] += np.add.reduceat(times * of_pair[slots], start)
        each = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(first, sizes)])
        out = {c: pc.list_flatten(documents.column(c)) for c in KINDS[0]} | {c: pa.array(v[each], pa.int64()) for c, v in total.items()}
        return pa.table({f.name: out["sha" if f.name == "groups_sha256" else f.name] for f in result.fields})

    result = T.StructType([T.StructField("key", rows.schema["key"].dataType), *[T.StructField(c, T.LongType()) for c in DIGESTS],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType())])
    out = (units.where("kind <> 1").drop("pairs", "held").groupBy("unit").cogroup(known.groupBy("of_unit")).applyInArrow(counted, result)
           .withColumnRenamed("key", key))
    return out if keep_groups else out.drop("groups")
