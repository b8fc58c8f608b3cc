"""Benchmark decontamination: n-gram seeds propose passages, local alignment scores them.

1. All n-grams of the test items are seeds.
2. Every document is searched for seeds; around each hit the passage that would align with the
   item is cut out and scored by Smith-Waterman on words. A passage leaks an item if the score is
   at least half of the item's own, or if 20 aligned words agree.

Not found: an edited copy that shares no run of ``N`` words with the item. Every third word replaced,
or a word put in after each one or two, leaves none and can still reach half of the item's score.

Items go to the tasks in blocks of bounded size, as a query set; documents are not shuffled.

Defined cases: null or empty texts hold nothing; items of fewer than ``N`` words are not searched;
repeated documents are each reported; items of equal text each count; items with a null id are searched
too and reported with a null id; empty tables give no leaks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import packed, unpacked

# Production parameters of op10.
N = 3                    # words of a seed
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5        # of the item's score with itself
LEAST_WORDS = 20         # or so many agreeing words
BLOCK_WORDS = 1_000_000  # words of test items that are searched in one pass
WORDS = re.compile(r"[^\W_]+")
LEAKS = "array<struct<item_id:{},score:double,n_words:int,start_word:int,end_word:int>>"  # {}: the ids' type


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.casefold()) if text else []


@dataclass
class Items:
    """A block of test items as word numbers, and its n-grams as sorted keys."""

    ids: list[int | None]
    items: list[np.ndarray]
    vocab: dict[str, int]
    grams: np.ndarray  # sorted distinct keys

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        vocab: dict[str, int] = {}
        ids, items = [], []
        for i, text in rows:
            w = words_of(text)
            if len(w) >= N:
                ids.append(i)
                items.append(np.array([vocab.setdefault(x, len(vocab)) for x in w], dtype=np.int64))
        block = cls(ids, items, vocab, np.zeros(0, dtype=np.int64))
        if items:
            block.grams = np.unique(np.concatenate([block.keys(w) for w in items]))
        return block

    def keys(self, w: np.ndarray) -> np.ndarray:
        """Key of the n-gram at each position; -1 where a word is not in any item."""
        if len(w) < N:
            return np.zeros(0, dtype=np.int64)
        parts = [w[k:len(w) - N + 1 + k] for k in range(N)]
        key = parts[0]
        known = parts[0] >= 0
        for p in parts[1:]:
            key = key * len(self.vocab) + p
            known = known & (p >= 0)
        return np.where(known, key, -1)

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)

    def hits(self, w: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the document, places in ``grams``) of the n-grams that are in ``grams``."""
        key = self.keys(w)
        at = np.flatnonzero(key >= 0)
        if not len(at) or not len(grams):
            return at[:0], at[:0]
        place = np.searchsorted(grams, key[at])
        place[place == len(grams)] = 0
        same = grams[place] == key[at]
        return at[same], place[same]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over words: best local score and the end of its passage side."""
    steps = -GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0
    for x in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == x, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps  # gaps along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


@dataclass
class Seeds:
    block: Items
    grams: np.ndarray            # sorted seed keys
    starts: np.ndarray           # owners of seed k: owners[starts[k]:starts[k + 1]]
    owners: list[tuple[int, int]]  # (item, position in it)

    @classmethod
    def of(cls, block: Items) -> Seeds:
        by_key: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(block.items):
            for j, key in enumerate(block.keys(w).tolist()):
                by_key.setdefault(key, []).append((i, j))
        grams = np.array(sorted(by_key), dtype=np.int64)
        owners = [o for g in grams for o in by_key[int(g)]]
        starts = np.cumsum([0] + [len(by_key[int(g)]) for g in grams])
        return cls(block, grams, starts, owners)

    def leaks(self, text: str | None) -> list[dict]:
        w = self.block.numbers(text)
        at, place = self.block.hits(w, self.grams)
        windows: dict[int, list[tuple[int, int]]] = {}
        for p, k in zip(at.tolist(), place.tolist()):
            for i, j in self.owners[self.starts[k]:self.starts[k + 1]]:
                n = len(self.block.items[i])
                slack = n // 3 + 4
                windows.setdefault(i, []).append((max(0, p - j - slack), min(len(w), p - j + n + slack)))
        out = []
        for i, spans in sorted(windows.items()):
            item, best = self.block.items[i], None
            for lo, hi in merged(sorted(spans)):
                passage = w[lo:hi]
                shared = int(np.isin(passage, item).sum())
                if 2 * shared < len(item) and shared < LEAST_WORDS:
                    continue  # even if all of them agreed, the passage would stay below both limits
                score, end = align(item, passage)
                if best is None or score > best[0]:
                    start = len(passage) - align(item[::-1], passage[::-1])[1]
                    agree = min(int(np.isin(passage[start:end], item).sum()), (score + end - start) // (MATCH + 1) + 1)
                    best = score, agree, lo + start, lo + end
            if best and (best[0] >= LEAST_SCORE * MATCH * len(item) or best[0] >= MATCH * LEAST_WORDS):
                out.append({"item_id": self.block.ids[i], "score": best[0] / (MATCH * len(item)), "n_words": best[1],
                            "start_word": best[2], "end_word": best[3]})
        return out


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Union of sorted windows."""
    lo, hi = spans[0]
    for a, b in spans[1:]:
        if a <= hi:
            hi = max(hi, b)
        else:
            yield lo, hi
            lo, hi = a, b
    yield lo, hi


def blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """Test items in blocks of about BLOCK_WORDS words, one block in memory at a time."""
    items = benchmark.select(F.col(key).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / (5 * BLOCK_WORDS)))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield Items.of(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[1] if r[0] is None else r)))


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Input rows with ``leaks``: the test items each row's text holds, with score and place."""
    kind = LEAKS.format(benchmark.schema[item_key].dataType.simpleString())
    leaks: Column = F.array().cast(kind)
    rows = packed(df)
    for block in blocks(benchmark, item_key, item_text):
        if block.items:
            seeds = Seeds.of(block)
            leaks = F.concat(leaks, searched(seeds, kind)(F.col("row").getField(text)))
    return unpacked(rows.withColumn("leaks", leaks), "leaks")


def keep_clean(df: DataFrame, benchmark: DataFrame, text: str = "text", **items: str) -> DataFrame:
    """The input rows that leak no test item, with the input's columns."""
    rows = packed(df).select("row", F.col("row").getField(text).alias("text"))
    return unpacked(find_leaks(rows, benchmark, "text", **items).where(F.size("leaks") == 0))


def searched(seeds: Seeds, kind: str):
    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([seeds.leaks(t) for t in texts], dtype=object)

    return found
