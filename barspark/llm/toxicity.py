"""Toxicity by multiple-instance learning: labels are on documents, scores on sentences.

A sentence's score is logistic in the words it holds; a document is toxic unless every sentence is
clean (noisy-or: 1 - prod(1 - s)). The bias is a leak: it is charged once per document, and a sentence
adds only what its words raise its score above the bias. Of these excesses, what as many sentences of
clean training documents hold on average (``noise``) is taken off, down to the excess of the worst
sentence; so length alone makes no document toxic, and hides no toxic sentence.
Sentence weights are trained from document labels by the gradient of the noisy-or likelihood, so the
model learns which sentences made a document toxic and can point at them. A word's features are the
word and its prefixes, screened by how differently toxic and clean training documents hold them.

The classifier is fitted on a bounded sample of labelled documents of any length (``MAX_PER_CLASS``
of each class, by hash order of the key, as far as they fit ``MAX_CLASS_CHARS`` characters), weighted
back to the class sizes. Tasks count the features and look up the chosen ones; the driver gets only the
chosen features of the sentences that hold some (4 bytes each; 40 million characters give some tens of MB).
Everything else reads whole texts of all rows. Labels, language, source and key are
no inputs of a score.

Defined cases: null or empty text, or text without words, has no sentence and scores 0; several
labels of a document count as their maximum; without labels of both classes all scores are 0;
repeated rows get the same score; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import cut, drop, packed, unpacked

# Production parameters of op7.
MAX_PER_CLASS = 4000
MAX_CLASS_CHARS = MAX_PER_CLASS * 5_000  # of all sampled texts of a class together
HELD_OUT_OF = 5
PREFIXES = (4, 5, 6, 7)
LEAST_DOCS, LEAST_Z, MAX_FEATURES = 4, 3.0, 20_000
ROUNDS, RATE, DECAY, START = 250, 0.1, 1e-4, -5.0
DOCS_AT_ONCE = 200

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
OFFENCES = "struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>"


def word_features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) >= k]


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct words) of each sentence that holds a word."""
    out = []
    for m in SENTENCE.finditer(text or ""):
        words = WORD.findall(m.group().lower())
        if words:
            out.append((m.start(), m.end(), list(dict.fromkeys(words))))
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float | None = None  # None: nothing was learned
    noise: float = 0.0  # mean excess hazard of a sentence of a clean document

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))


def screened(counts: DataFrame, n0: int, n1: int) -> list[str]:
    """The features whose share of documents differs most between the classes, by a two-proportion z."""
    share = (F.col("c1") + F.col("c0") + 1) / F.lit(n0 + n1 + 2)
    z = F.abs(F.col("c1") / F.lit(n1) - F.col("c0") / F.lit(n0)) / F.sqrt(share * (1 - share) * F.lit(1 / n1 + 1 / n0))
    rows = (counts.where(F.col("c1") + F.col("c0") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
            .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").collect())
    return [r[0] for r in rows]


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, c0, c1): sampled documents of each class that hold it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), DOCS_AT_ONCE):
                held: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(batch["text"][lo:lo + DOCS_AT_ONCE], batch["label"][lo:lo + DOCS_AT_ONCE]):
                    words = {w for _, _, found in sentences(text) for w in found}
                    held[int(label)].update({f for w in words for f in word_features(w)})
                features = list(held[0] | held[1])
                yield pd.DataFrame({"feature": features, "c0": [held[0][f] for f in features], "c1": [held[1][f] for f in features]})

    counts = sample.select("text", F.col("label").cast("int").alias("label")).mapInPandas(run, "feature string, c0 long, c1 long")
    return counts.groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def feature_rows(sample: DataFrame, key: str, chosen: list[str]) -> DataFrame:
    """Per sampled document its number of sentences and the chosen features of those that hold some:
    ``slots`` of one after the other, ``sizes`` of each."""
    slot = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            rows = []
            for k, text, label in zip(batch["key"], batch["text"], batch["label"]):
                slots, sizes, n = [], [], 0
                for _, _, words in sentences(text):
                    n, before = n + 1, len(slots)
                    for w in words:
                        if w not in known:
                            known[w] = [slot[f] for f in word_features(w) if f in slot]
                        slots += known[w]
                    if len(slots) > before:
                        sizes.append(len(slots) - before)
                rows.append((k, label, n, np.array(slots, dtype=np.int32), np.array(sizes, dtype=np.int32)))
                if len(known) > 1_000_000:  # a cache only: bounded memory
                    known.clear()
            yield pd.DataFrame(rows, columns=["key", "label", "n", "slots", "sizes"])

    return (sample.select(F.xxhash64(key).alias("key"), F.col("label").cast("int").alias("label"), "text")
            .mapInPandas(run, "key long, label int, n int, slots array<int>, sizes array<int>"))


def fit(labels: np.ndarray, n: np.ndarray, slots: np.ndarray, sizes: list[np.ndarray], chosen: list[str],
        class_sizes: tuple[int, int]) -> Model:
    """Noisy-or likelihood by gradient steps (Adam) over all sentences of the sample. A sentence without a
    chosen feature adds nothing to its document but the common leak."""
    labels = np.asarray(labels, dtype=float)
    n1, n0, n_docs = labels.sum(), len(labels) - labels.sum(), len(labels)
    sent_doc = np.repeat(np.arange(n_docs), [len(x) for x in sizes])
    sent_size = np.concatenate([np.zeros(0), *sizes]).astype(np.int64)  # empty lists come as doubles
    first = np.cumsum(sent_size) - sent_size
    weight = np.where(labels == 1, class_sizes[1] / n1, class_sizes[0] / n0)
    weight = weight / weight.mean()
    worded = n > 0

    def logits(theta, bias):
        x = np.add.reduceat(theta[slots], first) if len(first) else np.zeros(0)
        logit = np.clip(bias + x, -30, 30)
        return x, logit, np.maximum(np.logaddexp(0, logit) - np.logaddexp(0, bias), 0)

    theta, bias = np.zeros(len(chosen)), START
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, ROUNDS + 1):
        x, logit, above = logits(theta, bias)
        s, leak = 1 / (1 + np.exp(-logit)), 1 / (1 + np.exp(-bias))
        hazard = np.bincount(sent_doc, weights=above, minlength=n_docs) + worded * np.logaddexp(0, bias)  # -log P(clean)
        p = np.clip(-np.expm1(-hazard), 1e-9, 1)
        # d loss / d hazard: 1 for clean documents, -(1 - p) / p for toxic ones
        pull = weight * np.where(labels == 1, -(1 - p) / p, 1.0) / n_docs
        g_logit = np.where(x >= 0, pull[sent_doc] * s, 0.0)
        g_bias = (pull * worded).sum() * leak + (pull[sent_doc] * (s - leak))[x > 0].sum()
        g_theta = np.bincount(slots, weights=np.repeat(g_logit, sent_size), minlength=len(chosen))
        g = np.append(g_theta + DECAY * theta, g_bias)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    _, _, above = logits(theta, bias)
    clean_sentences = n[labels == 0].sum()
    noise = above[labels[sent_doc] == 0].sum() / clean_sentences if clean_sentences else 0.0
    return Model({f: float(t) for f, t in zip(chosen, theta)}, float(bias), float(noise))


def is_held_out(key: str = "doc_id"):
    """crc32 of the key as text, modulo 5, is 0; a null key counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF) == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    known = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(key))
             .groupBy(key).agg(F.max(label).alias("label")))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    picked = [known.where(F.col("label") == c).orderBy(F.xxhash64(key), key).limit(MAX_PER_CLASS) for c in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    found = cut(docs.select(key, text).join(F.broadcast(sample), key)  # at most 2 * MAX_PER_CLASS documents
                .groupBy(key, "label").agg(F.min(text).alias("text")).where(F.col("text").isNotNull()), "sample")
    lengths = found.select(key, "label", F.length("text").alias("n")).orderBy(F.xxhash64(key), key).collect()
    room, too_much = {0: MAX_CLASS_CHARS, 1: MAX_CLASS_CHARS}, []
    for k, c, n in lengths:
        if n <= room[c]:
            room[c] -= n
        else:
            too_much.append(k)
    sample = found.where(~F.col(key).isin(too_much)) if too_much else found
    counts = dict(sample.groupBy("label").count().collect())
    model = Model()
    if len(counts) == 2:
        chosen = screened(feature_counts(sample), counts[0], counts[1])
        rows = feature_rows(sample, key, chosen).toPandas().sort_values("key", kind="stable")
        if rows["n"].sum():
            slots = np.concatenate(rows["slots"].tolist()).astype(np.int32)
            model = fit(rows["label"].to_numpy(), rows["n"].to_numpy(), slots, rows["sizes"].tolist(), chosen,
                        (sizes.get(0, 0), sizes.get(1, 0)))
    drop(found)
    return model


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Input rows with ``score`` and ``offending``: the sentences that reach ``threshold`` on their own."""
    @F.pandas_udf(OFFENCES)
    def scored(texts: pd.Series) -> pd.DataFrame:
        weight: dict[str, float] = {}
        leak = 0.0 if model.bias is None else float(np.logaddexp(0.0, model.bias))
        out_score, out_sentences = [], []
        for text in texts:
            found = sentences(text) if model.bias is not None else []
            excess, worst, bad = 0.0, 0.0, []
            for start, end, words in found:
                logit = model.bias
                for w in words:
                    x = weight.get(w)
                    if x is None:
                        x = weight[w] = model.word_weight(w)
                    logit += x
                above = max(0.0, float(np.logaddexp(0.0, logit)) - leak)
                excess, worst = excess + above, max(worst, above)
                s = 1 / (1 + np.exp(-max(-700.0, logit)))
                if s >= threshold:
                    bad.append({"start": start, "end": end, "score": float(s)})
            hazard = leak + max(worst, excess - len(found) * model.noise) if found else 0.0  # -log P(clean)
            out_score.append(float(-np.expm1(-hazard)))
            out_sentences.append(bad)
            if len(weight) > 1_000_000:  # a cache only: bounded memory
                weight.clear()
        return pd.DataFrame({"score": out_score, "sentences": out_sentences})

    out = packed(df).withColumn("x", scored(F.col("row").getField(text)))
    return unpacked(out.select("row", F.col("x.score").alias("score"), F.col("x.sentences").alias("offending")), "score", "offending")


def keep_clean(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input rows that score below ``threshold``, with the input's columns."""
    rows = packed(df).select("row", F.col("row").getField(text).alias("text"))
    return unpacked(score(rows, model, "text").where(~is_toxic(threshold=threshold)))


def is_toxic(score_column="score", threshold: float = 0.5):
    return F.col(score_column) >= threshold
