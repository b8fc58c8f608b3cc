"""op11: repeated byte strings against a plain dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from barspark.llm import queries, run_index
from tests.llm.util import documents_dir


def brute(rows, width):
    """(key, text) -> per row the bytes left, by the first (key, start) of every string; null keys first."""
    place = lambda k: (k is not None, k or 0)
    first = {}
    for k, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1):
            s, at = raw[i:i + width], (place(k), i)
            first[s] = min(first.get(s, at), at)
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, dtype=bool)
        for i in range(len(raw) - width + 1):
            if (place(k), i) > first[raw[i:i + width]]:
                gone[i + 1:i + 1 + width] = True
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((k, len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["alpha", "béta", "γάμμα", "delta", "x" * 9, "über", "zeta", "η"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passage, boiler = prose(40), "All rights reserved by the holders of the marks named in this notice and elsewhere. " * 2
    rows = [(i, prose(rng.randint(0, 120))) for i in range(60)]
    rows += [(100 + i, prose(30) + passage[:rng.randint(150, len(passage))] + prose(30)) for i in range(30)]
    rows += [(200 + i, boiler + prose(rng.randint(5, 20)) + boiler) for i in range(20)]
    original = prose(200)
    rows += [(300 + i, original) for i in range(25)]
    rows += [(400 + i, original[:300 + i] + "!" + original[300 + i:]) for i in range(15)]
    rows += [(500, "a" * 700), (501, "ab" * 300), (502, ""), (503, None), (504, "short"), (None, passage), (None, original),
             (505, prose(4000) + passage), (506, "é" * 400), (507, passage[:100]), (507, passage[:100]), (507, "y" + passage[:100])]
    rng.shuffle(rows)
    return rows


def digest(df):
    q = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()]
    return sorted(q, key=str)


def test_query_equals_brute_force(spark, tmp_path_factory):
    rows = corpus()
    path = documents_dir(spark, tmp_path_factory, [Row(doc_id=k, text=t) for k, t in rows])
    assert digest(queries.op11_run_index(spark, path)) == brute(rows, 100)


@pytest.mark.parametrize("width,bucket,hot", [(100, 2000, 1_000_000), (100, 4 << 20, 2), (64, 3000, 3)])
def test_small_buckets_and_crowded_seeds(spark, width, bucket, hot):
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = run_index.remove_repeats(df, width=width, bucket=bucket, hot=hot).collect()
    spans = sorted((str((r.doc_id, len((r.text or "").encode()), sum(s.end - s.start for s in r.removed), len(r.removed),
                         hashlib.sha256(bytes(r.kept)).hexdigest())) for r in got))
    assert spans == [str(x) for x in brute(rows, width)]


def test_slices_of_long_texts(monkeypatch):
    import pyarrow as pa

    rows = [t for _, t in corpus(7)]
    whole = {(r, s) for r, t in enumerate(rows) for s in range(len((t or "").encode()) - 99)}
    monkeypatch.setattr(run_index, "SLICE", 512)
    seen = []
    for data, limits, of, offset in run_index.text_slices(pa.array(rows, pa.string())):
        doc, start, length, _, _ = run_index.pieces(data, limits)
        for d, s, n in zip(doc, start, length):
            seen += [(of[d], s - limits[d] + offset[d] + k) for k in range(n - 99)]
    assert len(seen) == len(set(seen)) and set(seen) == whole


def test_index_matches_neighbours():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    index = run_index.RunIndex(np.frombuffer(b"".join(strings), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in strings]))))
    neighbour, length = index.matching_statistics()
    suffix = {}
    for at, s in zip(index.starts, strings):
        suffix |= {int(at) + k: s[k:] for k in range(len(s))}
    assert len(index.place) < index.size
    best = 0
    for p, s in suffix.items():
        n = int(length[p])
        assert n <= 0 or s[:n] == suffix[int(neighbour[p])][:n]
        best += n > 0
    assert best > len(suffix) / 2


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run_index.remove_repeats(empty).collect() == []
    df = spark.createDataFrame([("b", "z" * 150, 1, {"a": 1}), ("a", "z" * 150, 2, None)], "name string, kept string, removed int, spans map<string,int>")
    out = run_index.remove_repeats(df, key="name", text="kept")
    assert out.columns == ["name", "spans", "removed", "kept"]
    assert {r.name: len(r.kept) for r in out.collect()} == {"a": 1, "b": 0}
