"""N-gram Jaccard self-join by a token-group matrix.

Documents of equal shingle sets are one class. Classes that may have a partner are put into groups
of similar ones (same minhash, or same component once known), at most ``GROUP`` in each. The
token-group matrix holds, for each shingle, the groups whose members have it. Two groups meet only
if they have enough shingles in common; then each member's overlap with the other group's union
bounds its similarity to every member there, and only members that qualify are compared exactly.

Everything is exact: a class is dropped only by a bound. With required overlap o(n) = ceil(0.85 n)
and any global order of shingles, the first l shingles shared by two linked sets are among the first
n - o(n) + l of each. So a class whose first shingles are hardly shared by other classes has no
partner, which is decided without moving its whole set. The second time the order is rarest first,
so passages that many documents share come last and bring nobody together.

Pairs of classes already known to be in one component are not compared: links inside small groups
are found first, which turns a large group of near copies into one component of many groups.

Defined cases: null, empty or word-less texts have an empty set, link with nothing and are their own
component; texts of fewer words than a shingle are one shingle; repeated rows and ids are all
returned; a component without any id has id null; an empty table gives an empty result.
Identities of shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import cut, drop, packed, unpacked
from barspark.llm.components import components

# Production parameters of op6.
WORDS = 4                 # words of a shingle
PERCENT = 85              # 100 * intersection >= PERCENT * union
SHARE = 0.05              # l: prefix shingles two linked sets must share, as a part of the set
GROUP = 256               # most classes of a group
TOGETHER = 1024           # classes handled by one call, small groups put together
ROUNDS = 2                # minhash groupings before the matrix
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)  # fixed odd values


def overlap_needed(n: Column, percent: int) -> Column:
    """Least intersection with any linked set: ceil(percent/100 * n)."""
    return F.floor((n * percent + 99) / 100)


def common_needed(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(SHARE)))


def shingles(text: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text; words split at ASCII white space, A-Z lower-cased."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.int64)
    if len(known) > 2_000_000:
        known.clear()
    hashes = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    if len(h) < words:  # the whole sequence as one; its length keeps it apart from longer ones
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], dtype=np.uint64).view(np.int64)
    n = len(h) - words + 1
    with np.errstate(over="ignore"):
        key = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            key = (key ^ (h[k:k + n] * MIX[k % len(MIX)])) * MIX[-1]
            key ^= key >> np.uint64(32)
    return np.unique(key.view(np.int64))


def marks(df: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Per row: text key, class, set size and (once per class and task) the set's first shingles."""
    rows = df.select(F.xxhash64(text).alias("tk"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        done: set[int] = set()
        for pdf in batches:
            out = []
            for tk, t in zip(pdf["tk"], pdf["t"]):
                s = shingles(t, words, known)
                c = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
                first = None
                if len(s) and c not in done:
                    done.add(c)
                    n = len(s)
                    first = s[:n - (n * percent + 99) // 100 + max(1, int(n * SHARE))]
                out.append((tk, c, len(s), first))
            yield pd.DataFrame(out, columns=["tk", "c", "n", "first"])

    return cut(rows.mapInPandas(run, "tk long, c long, n int, first array<long>"), "marks")


def with_partners(first: DataFrame, percent: int) -> DataFrame:
    """(c, n, first) -> classes (c, n) with enough first shingles that another class has too."""
    tokens = first.select("c", "n", F.explode("first").alias("token"))
    every = Window.partitionBy("token")
    shared = tokens.withColumns({"lo": F.min("c").over(every), "hi": F.max("c").over(every)}).where("lo <> hi")
    return (shared.groupBy("c", "n").agg(F.count_distinct("token").alias("common"))
            .where(F.col("common") >= common_needed(overlap_needed(F.col("n"), percent))).select("c", "n"))


def shared_sets(df: DataFrame, text: str, words: int, percent: int, wanted: DataFrame) -> DataFrame:
    """Classes that pass the bound on their whole set: (c, n, shared, key0, key1, ...).

    ``wanted``: text keys, one per class. ``shared``: the shingles other wanted classes have too,
    rarest first; ``key``: minhashes.
    """
    # ``wanted`` grows with the table, so it is never broadcast: the plan is the same at every size,
    # and texts are told apart by the key the join dealt them out by.
    texts = (df.select(F.xxhash64(text).alias("tk"), F.col(text).alias("t")).join(wanted.hint("merge"), "tk", "left_semi")
             .dropDuplicates(["tk"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for pdf in batches:
            sets = [shingles(t, words, known) for t in pdf["t"]]
            yield pd.DataFrame({"c": [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets],
                                "n": [len(s) for s in sets], "tokens": sets})

    tokens = texts.select("t").mapInPandas(run, "c long, n int, tokens array<long>").select("c", "n", F.explode("tokens").alias("token"))
    held = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    per_class = held.groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x"))
    fit = per_class.where(F.size("x") >= overlap_needed(F.col("n"), percent))
    keys = [F.array_min(F.transform("x", lambda t, k=k: _minhash(t, k))).alias(f"key{k}") for k in range(ROUNDS)]
    return cut(fit.select("c", F.col("n").cast("long").alias("n"), F.col("x.token").alias("shared"), *keys), "shared")


def _minhash(t: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), t["token"])


def grouped(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``g``: groups of equal ``key``, larger ones split by hash into groups of about GROUP."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    part = F.pmod(F.xxhash64(F.lit(seed), "c"), F.ceil(F.col("members") / (GROUP // 2)))
    return rows.join(sizes, key).withColumn("g", F.xxhash64(F.lit(seed), key, part))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every set of a with every set of b."""
    if len(a) == 1 and len(b) == 1:
        return np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]])
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    if not len(both):
        return out
    rows = [[np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in side] for side in (a, b)]
    step = 4096
    for lo in range(0, len(both), step):
        x, y = (np.zeros((len(side), min(step, len(both) - lo)), dtype=np.float32) for side in rows)
        for m, side in ((x, rows[0]), (y, rows[1])):
            for i, at in enumerate(side):
                at = at[(at >= lo) & (at < lo + step)] - lo
                m[i, at] = 1
        out += (x @ y.T).astype(np.int64)  # at most ``step`` a cell: exact
    return out


def links_between(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of the classes of two groups (c, n, shared, comp), but for pairs of one component."""
    sa, sb = ([np.asarray(s, dtype=np.int64) for s in x["shared"]] for x in (a, b))
    # Bound: a member's overlap with the other group's union of shingles.
    keep = []
    for own, own_n, other in ((sa, a["n"], sb), (sb, b["n"], sa)):
        union = np.unique(np.concatenate(other))
        inside = np.array([int(np.isin(s, union, assume_unique=True).sum()) for s in own])
        keep.append(np.flatnonzero(100 * inside >= percent * own_n.to_numpy()))
    if not len(keep[0]) or not len(keep[1]):
        return []
    a, b = a.iloc[keep[0]], b.iloc[keep[1]]
    both = overlaps([sa[i] for i in keep[0]], [sb[i] for i in keep[1]])
    union = a["n"].to_numpy()[:, None] + b["n"].to_numpy()[None, :] - both
    linked = (100 * both >= percent * union) & (a["comp"].to_numpy()[:, None] != b["comp"].to_numpy()[None, :])
    i, j = np.nonzero(linked)
    return list(zip(a["c"].to_numpy()[i].tolist(), b["c"].to_numpy()[j].tolist()))


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of linked pairs, those that join something new: a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in pairs:
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


LINKS = "a long, b long"


def links_in_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Links inside groups: (g, c, n, shared) -> (a, b), a spanning forest of each group."""
    some = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    put = F.pmod(F.xxhash64("g"), F.lit(max(1, rows.count() // TOGETHER + 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, members in pdf.groupby("g"):
            members = members.sort_values("c").assign(comp=members["c"])
            out += spanning(links_between(members, members, percent))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return rows.join(some.select("g"), "g", "left_semi").select("g", "c", "n", "shared", put.alias("put")).groupBy("put").applyInPandas(
        run, LINKS)


def links_across(rows: DataFrame, percent: int) -> DataFrame:
    """Links between groups found through the token-group matrix: (g, comp, c, n, shared) -> (a, b)."""
    n = F.col("n")
    unshared = n - F.size("shared")  # these come first in the rarest-first order, and match nothing
    length = n - overlap_needed(n, percent) + common_needed(n) - unshared
    prefix = rows.select("g", "comp", "n", F.explode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), length).cast("int"))).alias("token"))
    matrix = cut(prefix.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "matrix")
    other = matrix.select("token", *[F.col(c).alias(f"{c}2") for c in ("g", "least", "most", "lo", "hi")])
    same = (F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))
    near = (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least"))
    met = (matrix.join(other, "token").where((F.col("g") < F.col("g2")) & near & ~same)
           .groupBy("g", "g2").agg(F.count(F.lit(1)).alias("common"), F.min(F.least("least", "least2")).alias("least")))
    pairs = cut(met.where(F.col("common") >= common_needed(F.col("least"))).select("g", "g2"), "pairs")
    drop(matrix)
    # Groups known to be of one component as a whole need no comparison. Of the others the larger
    # group of a pair is the host: its members are sent once and meet the members of all its guests.
    whole = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    ends = whole.select("g", "size", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("one"))
    other_end = ends.select(F.col("g").alias("g2"), F.col("size").alias("size2"), F.col("one").alias("one2"))
    larger = F.col("size") >= F.col("size2")
    meets = (pairs.join(ends, "g").join(other_end, "g2").where("one is null or one2 is null or one <> one2")
             .select(F.when(larger, F.col("g")).otherwise(F.col("g2")).alias("host"),
                     F.when(larger, F.col("g2")).otherwise(F.col("g")).alias("guest"), F.least("size", "size2").alias("members")))
    rooms = F.ceil(F.col("come") / TOGETHER).cast("int")
    come = meets.groupBy("host").agg(F.sum("members").alias("come"))
    room = F.xxhash64("host", F.pmod(F.xxhash64("guest"), rooms))
    meets = cut(meets.join(come, "host").select("host", "guest", room.alias("room")), "meets")
    drop(pairs)
    sides = (meets.select("room", F.col("host").alias("g")).distinct().withColumn("side", F.lit(0))
             .unionByName(meets.select("room", F.col("guest").alias("g"), F.lit(1).alias("side"))))
    put = F.pmod(F.xxhash64("room"), F.lit(max(1, meets.count() // 32 + 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, both in pdf.groupby("room"):
            a, b = (both[both["side"] == k].sort_values("c") for k in (0, 1))
            if len(a) and len(b):
                out += spanning(links_between(a, b, percent))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return sides.join(rows, "g").select("room", "side", "comp", "c", "n", "shared", put.alias("put")).groupBy("put").applyInPandas(run, LINKS)


def class_components(df: DataFrame, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((tk, c, n) of all texts with words, (node, root) of linked classes)."""
    mark = marks(df, text, words, percent)
    seen = mark.where("first is not null")
    picked = with_partners(seen.select("c", "n", "first"), percent)
    wanted = cut(seen.select("c", "tk").join(picked.select("c"), "c", "left_semi").groupBy("c").agg(F.min("tk").alias("tk")).select("tk").distinct(), "wanted")
    classes = cut(mark.where("n > 0").select("tk", "c", "n").distinct(), "classes")
    drop(mark)  # the first shingles are not needed any more
    sets = shared_sets(df, text, words, percent, wanted)
    found = [cut(links_in_groups(grouped(sets, f"key{k}", k), percent), "links") for k in range(ROUNDS)]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    known = cut(components(links), "known")
    rows = sets.join(known.withColumnRenamed("node", "c"), "c", "left")
    # Linked classes are grouped by component; the others keep the groups of round 0, in which they were compared.
    in_comp = rows.where("root is not null").withColumnRenamed("root", "comp")
    alone = grouped(sets, "key0", 0).join(known.select(F.col("node").alias("c")), "c", "left_anti")
    columns = ["g", "comp", "c", "n", "shared"]
    placed = cut(grouped(in_comp, "comp", ROUNDS).select(columns).unionByName(
        alone.withColumn("comp", F.col("c")).select(columns)), "placed")
    across = cut(links_across(placed, percent), "links")
    roots = cut(components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across)), "roots")
    drop(wanted, sets, known, placed, across, *found)
    return classes, roots


def _joined(df: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """Packed input rows with id, n_shingles, component_id and root (the component; null without words)."""
    classes, roots = class_components(df, text, words, percent)
    by_text = cut(classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select("tk", "n", F.coalesce("root", "c").alias("root")), "roots_by_text")
    drop(classes, roots)
    row = F.col("row")
    rows = packed(df).withColumns({"tk": F.xxhash64(row.getField(text)), "id": row.getField(key)})
    least = rows.select("tk", "id").join(by_text, "tk").groupBy("root").agg(F.min("id").alias("component_id"))
    named = cut(by_text.join(least, "root").select("tk", "n", "root", "component_id"), "named")
    return rows.join(named, "tk", "left").withColumns({
        "n_shingles": F.coalesce("n", F.lit(0)).cast("long"),
        "component_id": F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component_id"))})


def join(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Input rows with n_shingles and component_id (smallest key reachable by links)."""
    return unpacked(_joined(df, text, key, words, percent), "n_shingles", "component_id")


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The input rows to keep: of each component the row with the smallest key (ties: smallest text
    hash; a null key comes last), and every row without words."""
    rows = _joined(df, text, key, words, percent)
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "tk"))
    linked = rows.where("root is not null").withColumn("place", first).where("place = 1").select("row")
    return unpacked(rows.where("root is null").select("row").unionByName(linked))
