import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moorage.llm import quotient_filters as qf
from tests.compare import difference, duck
from tests.llm.fixtures import no_documents, odd_documents, odd_rows

COUNTS = st.dictionaries(st.integers(0, 2**20 - 1), st.integers(1, 10**6), max_size=200)


def filter_of(held: dict[int, int], width: int = 20) -> qf.CountingQuotientFilter:
    keys = sorted(held)
    return qf.build(np.array(keys, np.uint64), np.array([held[k] for k in keys], np.int64), width)


@settings(deadline=None, max_examples=200)
@given(COUNTS)
def test_a_filter_holds_what_was_put_in(held):
    fingerprints, counts = qf.contents(filter_of(held))
    assert dict(zip(fingerprints.tolist(), counts.tolist())) == held and fingerprints.tolist() == sorted(held)


@settings(deadline=None, max_examples=100)
@given(st.lists(COUNTS, min_size=1, max_size=5))
def test_merging_loses_nothing(parts):
    total: dict[int, int] = {}
    for part in parts:
        for key, n in part.items():
            total[key] = total.get(key, 0) + n
    assert qf.merge([filter_of(p) for p in parts]) == filter_of(total)


def test_runs_that_push_each_other_on_and_wide_counters():
    crowded = {(5 << 12) + i: i + 1 for i in range(300)} | {(6 << 12) + i: 1 for i in range(300)} | {(2**20 - 1): 2**40}
    fingerprints, counts = qf.contents(filter_of(crowded))
    assert dict(zip(fingerprints.tolist(), counts.tolist())) == crowded


def test_filters_of_partitions_count_all_rows(spark):
    values = [(i * i * 7919 % (1 << 40),) for i in range(3000)] * 2 + [(12345,)] * 500
    rows = spark.createDataFrame(values, "fingerprint bigint").repartition(7)
    merged = qf.merged_filters(qf.partition_filters(rows, 3))
    got = {r.fingerprint: r.n for r in qf.counted(merged).collect()}
    expected: dict[int, int] = {}
    for (v,) in values:
        expected[v] = expected.get(v, 0) + 1
    assert got == expected


def brute_force(rows):
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows]
    out = []
    for (doc_id, *_), text in zip(rows, texts):
        same = [r[0] for r, t in zip(rows, texts) if t == text]
        ids = [i for i in same if i is not None]
        out.append((doc_id, min(ids) if ids else None, len(same), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("rename", [False, True])
def test_odd_documents(spark, rename):
    docs = odd_documents(spark).repartition(3)
    names = {"doc_id": "number", "text": "body"} if rename else {}
    got = qf.exact_duplicates(docs.withColumnsRenamed(names), **{k: v for k, v in names.items()}).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=lambda r: key(r[:3]) + (r[3],)) == sorted(brute_force(odd_rows()), key=lambda r: key(r[:3]) + (r[3],))
    kept: dict[str, int] = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_white_space_is_one_space_and_null_is_empty(spark):
    rows = [(1, "a b"), (2, "a \t\n b"), (3, " a b"), (4, "\x0ba b"), (5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A b")]
    got = {r.doc_id: r.keep_id for r in qf.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}


def test_equal_fingerprints_of_other_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(qf, "_fingerprint", lambda sha: qf.F.conv(qf.F.substring(sha, 1, 1), 16, 10).cast("bigint"))
    rows = [(i, f"text {i % 60}") for i in range(100)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in qf.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (i % 60, 2 if i % 60 < 40 else 1) for i in range(100)}


def test_first_of_each_keeps_all_columns(spark):
    docs = odd_documents(spark)
    kept = qf.first_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in odd_rows()})


def test_no_documents(spark):
    assert qf.exact_duplicates(no_documents(spark)).collect() == []
    assert qf.first_of_each(no_documents(spark)).collect() == []


def test_query_beside_its_sql(spark):
    from moorage.llm.oracles import ORACLES
    from moorage.llm.queries import QUERIES

    name, folder = "op12_quotient_filters", "/root/testdata/sf0.01"
    assert difference(QUERIES[name](spark, folder), duck(folder).sql(ORACLES[name])) is None
