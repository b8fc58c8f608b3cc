"""op13: lockstep merging and corpus counts against sets of token ends."""

import glob
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import Row

from barspark.llm import queries, token_alignment
from tests.llm.util import documents_dir


class Listed:
    """Tokenizer A by the library its file is made for."""

    def __init__(self):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}")
        self.tokenizer.encode_special_tokens = True
        alphabet = token_alignment.byte_alphabet()
        self.bytes = {i: bytes(alphabet.get(c, 0) for c in p) for p, i in self.tokenizer.get_vocab().items()}

    def encode(self, texts):
        return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def tokenizers(_made=[]):  # noqa: B006
    if not _made:
        _made += [Listed(), token_alignment.Pieces(f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")]
    return _made


def brute_groups(text):
    sides = []
    for tok in tokenizers():
        ids = tok.encode([text])[0] if text else []
        if b"".join(tok.bytes[i] for i in ids) != (" " + (text or "")).encode():
            return []
        sides.append((ids, np.cumsum([len(tok.bytes[i]) for i in ids]).tolist()))
    (a, a_ends), (b, b_ends) = sides
    groups, i, j = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        i2, j2 = len([e for e in a_ends if e <= end]), len([e for e in b_ends if e <= end])
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return groups


def brute(rows):
    grouped = [brute_groups(t) for _, t in rows]
    linked = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in grouped]
    count = Counter(p for c in linked for p in c)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (k, _), g, c in zip(rows, grouped, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    words = ["the", "Über", "naïve", "tokens", "日本語", "x=1;", "<|endoftext|>", "</s>", "<0x0A>", "🙂", "\n\n", "\t", "l'été", "antidisestablishment"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "  two  blanks  "), (105, "=" * 3000), (106, "é" * 999),
             (107, " ".join(rng.choice(words) for _ in range(3000))), (108, "\x00\x01"), (None, "the tokens"), (109, "the tokens"), (109, "the tokens")]
    return rows


def test_query_equals_brute_force(spark, tmp_path_factory):
    rows = corpus()
    path = documents_dir(spark, tmp_path_factory, [Row(doc_id=k, text=t) for k, t in rows])
    got = queries.op13_token_alignment(spark, path).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", *token_alignment.DIGESTS, "groups_sha256")) for r in got), key=str) == \
        brute(rows)


def test_units_and_groups(spark):
    rows = corpus()
    df = spark.createDataFrame([(str(k), t, 1) for k, t in rows], "name string, text string, n_a int").repartition(3)
    out = token_alignment.align_corpus(df, key="name", unit=700, keep_groups=True)
    assert out.columns == ["name", *token_alignment.DIGESTS, "groups_sha256", "groups"]
    want = sorted(("None" if x[0] is None else str(x[0]), *x[1:]) for x in brute(rows))
    got = out.collect()
    assert sorted((r.name, *(r[c] for c in token_alignment.DIGESTS), r.groups_sha256) for r in got) == want
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)


def test_merge_with_any_lanes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = rng.integers(1, 60, rng.integers(1, 6))
        limits = np.concatenate(([0], np.cumsum(lengths)))
        ends = [np.unique(np.concatenate([limits[1:], rng.integers(1, limits[-1] + 1, rng.integers(0, 40))])) for _ in range(2)]
        common = np.intersect1d(*ends)
        cuts = [np.searchsorted(e, common) + 1 for e in ends]
        want = np.stack([np.append(0, cuts[0][:-1]), cuts[0], np.append(0, cuts[1][:-1]), cuts[1]], axis=1)
        for lane in (1, 3, 7, 1000):
            assert np.array_equal(token_alignment.merge(*ends, limits, lane), want)


def test_large_groups_are_made_distinct(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 80), rng.integers(0, 7, 90)
    groups, doc = np.array([[0, 50, 0, 60], [50, 80, 60, 90]]), np.array([0, 1])
    plain = Counter((d, x, y) for d, (a0, a1, b0, b1) in zip(doc.tolist(), groups.tolist()) for x in a[a0:a1].tolist() for y in b[b0:b1].tolist())
    for large in (1, 10_000):
        monkeypatch.setattr(token_alignment, "LARGE", large)
        keys, times = token_alignment.links(groups, doc, a, b, 7, 63)
        assert {(k // 63, k % 63 // 7, k % 7): t for k, t in zip(keys.tolist(), times.tolist())} == dict(plain)


def test_long_pieces_of_one_kind():
    a = token_alignment.ByteLevel(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}")
    texts = ["=" * 50_000, "ab" * 20_000, " " * 30_000, "1" * 10_000, "é" * 10_000, "<|endoftext|> <|endoftext|>", "it's\u00a0I'LL 'tis"]
    assert a.encode(texts) == tokenizers()[0].encode(texts)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align_corpus(empty).collect() == []


def test_units_are_kept_in_bounded_pieces(spark, monkeypatch):
    """A unit is no single row, and no row group grows with the unit or the task."""
    rng, words = random.Random(3), ["alpha", "beta", "Gamma", "delta", "42", "naïve", "epsilon,", "zeta"]
    rows = [Row(doc_id=i, text=" ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(400))) for i in range(600)]
    rows += [Row(doc_id=i, text="") for i in range(600, 610)]
    df = spark.createDataFrame(rows).coalesce(1)
    kept, plain = [], token_alignment.cut
    monkeypatch.setattr(token_alignment, "cut", lambda *a, **b: kept.append(plain(*a, **b)) or kept[-1])
    got = token_alignment.align_corpus(df).collect()
    groups, cells = [], 0
    for f in glob.glob(f"{kept[0].scratch_path.removeprefix('file:')}/*.parquet"):
        table = pq.ParquetFile(f)
        groups += [table.metadata.row_group(g).total_byte_size for g in range(table.num_row_groups)]
        cells = max(cells, *(max((len(v) for v in c.to_pylist() if hasattr(v, "__len__")), default=0) for c in table.read().columns))
    assert max(groups) < 10 << 20 and cells <= 8 * 8192, (groups, cells)
    monkeypatch.setattr(token_alignment, "SLICE", 7)
    small = token_alignment.align_corpus(df.where("doc_id % 100 < 3"), unit=50_000).collect()
    one = token_alignment.align_corpus(df.where("doc_id % 100 < 3")).collect()
    assert sorted(small) == sorted(one) and len(got) == len(rows)
