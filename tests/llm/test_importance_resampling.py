import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moorage.llm import importance_resampling as ir
from moorage.llm.position_crc import BLOCK, crc32_of_spans, length_constants
from tests.llm.fixtures import LONG, no_documents, odd_documents


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=5 * BLOCK), st.integers(0, 3)), min_size=1, max_size=20))
def test_sums_of_spans(parts):
    flat, starts, ends = b"", [], []
    for data, gap in parts:
        starts.append(len(flat))
        ends.append(len(flat) + len(data))
        flat += data + b"x" * gap
    got = crc32_of_spans(np.frombuffer(flat, np.uint8), np.array(starts), np.array(ends))
    assert got.tolist() == [zlib.crc32(data) for data, _ in parts]


@pytest.mark.parametrize("size", [1, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 2 * BLOCK + 1, 17 * BLOCK + 5, 300_001])
def test_long_spans_beside_short_ones(size):
    flat = np.random.default_rng(size).integers(0, 256, size + 20, dtype=np.uint8)
    starts, ends = np.array([0, 7, size + 8]), np.array([3, size + 7, size + 20])
    assert crc32_of_spans(flat, starts, ends).tolist() == [zlib.crc32(flat[a:b]) for a, b in zip(starts, ends)]
    assert length_constants(np.array([size])).tolist() == [zlib.crc32(bytes(size))]


def features(text, longest=2):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_force(rows, target, spec=ir.ResamplingSpec()):
    def buckets(text):
        return [zlib.crc32(f.encode()) % spec.buckets for f in features(text, spec.words)[1]]

    s, t = [0] * spec.buckets, [0] * spec.buckets
    for counts, texts in ((s, (r[1] for r in rows)), (t, target)):
        for text in texts:
            for b in buckets(text):
                counts[b] += 1
    total_s, total_t = sum(s) + spec.buckets, sum(t) + spec.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in range(spec.buckets)]
    out = []
    for doc_id, text in rows:
        own = buckets(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{spec.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None, features(text)[0] >= spec.least_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: spec.percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v or 0) for v in r))


def test_feature_buckets_across_slices(monkeypatch):
    monkeypatch.setattr(ir, "SLICE", 500)
    texts = [LONG[:4000], "", None, "one", "été 中文 A-b_c", "x" * 3000 + " y " + "z" * 700, "a b"]
    spec = ir.ResamplingSpec(words=3, buckets=997)
    got = sorted((int(p), int(b)) for _, place, bucket in ir.feature_buckets(texts, spec) for p, b in zip(place, bucket))
    assert got == sorted((i, zlib.crc32(f.encode()) % 997) for i, t in enumerate(texts) for f in features(t, 3)[1])


def test_odd_documents(spark):
    docs, target = odd_documents(spark).repartition(3), ["the lazy dog jumps", None, "", "word1 other1"]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for spec in (ir.ResamplingSpec(), ir.ResamplingSpec(words=1, buckets=50, least_words=1, percent=60, seed=1), ir.ResamplingSpec(least_words=0, percent=100)):
        got = ir.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), spec)
        assert order(got.collect()) == order(brute_force(rows, target, spec))


def test_many_ties_are_ranked_by_id(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i // 3, text) for i in range(600)] + [(None, text)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = ir.resample(docs, spark.createDataFrame([("w1 w2",)], "text string")).collect()
    assert order(got) == order(brute_force(rows, ["w1 w2"]))


def test_drawn_rows_keep_their_columns(spark):
    docs = odd_documents(spark).where("doc_id > 1")
    spec = ir.ResamplingSpec(least_words=1, percent=50)
    got = ir.drawn(docs, docs.select("text"), spec)
    assert got.columns == docs.columns and got.count() == docs.where(r"text RLIKE '[0-9A-Za-z\\x{80}-\\x{10FFFF}]'").count() // 2


def test_no_documents(spark):
    empty = no_documents(spark)
    assert ir.resample(empty, empty).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert order(ir.resample(one, empty.select("text")).collect()) == order(brute_force([(1, "a b c")], []))


def test_query(spark):
    from moorage.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert order(QUERIES["op13_importance_resampling"](spark, folder).collect()) == order(brute_force(rows, target))
