import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moorage.llm import adaptive_rules, bbit_minhash
from moorage.llm.bbit_minhash import MinHashSpec, estimates, minima, near_duplicates, packed, shingles, tokens
from moorage.llm.components import components
from moorage.llm.oracles import ORACLES
from moorage.llm.queries import QUERIES
from tests.compare import difference, duck
from tests.llm.fixtures import no_documents, odd_documents


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert difference(QUERIES[name](spark, folder), duck(folder).sql(ORACLES[name])) is None


# --- rules

@pytest.mark.parametrize("seed", range(30))
def test_repeated_words(seed):
    rng = random.Random(seed)
    words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    wanted = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    assert adaptive_rules.repeated_words(words) == len(wanted)


def test_rules_on_odd_documents(spark):
    rows = adaptive_rules.quality_rules(odd_documents(spark)).collect()
    assert len(rows) == 11 and all(r.kept is not None and not (r.base_failed and r.kept) for r in rows)
    empty = [r for r in rows if r.n_words == 0]
    assert len(empty) == 4 and all(r.base_failed for r in empty)
    assert adaptive_rules.quality_rules(no_documents(spark)).collect() == []


def test_sketches_merge(spark):
    rows = spark.range(2000).select(F.lit("k").alias("k"), (F.col("id") * F.col("id") % 99991).alias("v"))
    whole = adaptive_rules.sketch(rows, ["k"], ["v"])
    parts = adaptive_rules.sketch(rows.where("v < 500"), ["k"], ["v"]).union(adaptive_rules.sketch(rows.where("v >= 500"), ["k"], ["v"]))
    merged = parts.groupBy("k", "rule", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(whole.collect()) == sorted(merged.collect())
    q = adaptive_rules.quartiles(whole, ["k"]).first()
    exact = sorted(r.v for r in rows.collect())
    for got, at in ((q.q1, 499), (q.q3, 1499)):
        assert got <= exact[at] < got * (1 + 1 / 60) + 1


def test_fences_follow_the_group(spark):
    plain = "some plain words that are all of them different here and now one two three four five six seven eight nine ten"
    marked = " ".join(w + "#" for w in plain.split())
    rows = [(i, plain, "en", "prose", 0) for i in range(40)] + [(100, marked, "en", "prose", 0)] + [(200 + i, marked, "en", "code", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = {r.doc_id: r.kept for r in adaptive_rules.quality_rules(docs).collect()}
    assert not kept[100] and all(v for k, v in kept.items() if k != 100)


def test_every_rule_rejects(spark):
    def prose(n, seed):
        return [f"word{(i * 7919 + seed * 104729) % 9973:04d}" + "x" * (seed % 4) for i in range(n)]

    def lines(words, k=9):
        return "\n".join(" ".join(words[i : i + k]) for i in range(0, len(words), k))

    plain = {i: lines(prose(180 + i, i)) for i in range(60)}
    odd = {
        100: lines(prose(180, 100)) + " # # # # #",
        101: lines(prose(180, 101)) + "\nsame line" * 5,
        102: " ".join(w := prose(160, 102)) + " " + " ".join(w[:9]) + " x " + " ".join(w[40:49]),
        103: " ".join(w * 4 for w in prose(180, 103)),
    }
    few = {104: lines(prose(180, 104)) + " # # # #", 105: lines(prose(180, 105)) + "\nsame line" * 4, 106: " ".join(w := prose(160, 106)) + " " + " ".join(w[:9])}
    # A source of few documents has its language's fences.
    alone = {200: lines(prose(170, 200)), 201: lines(prose(180, 201)) + " # # # # #"}
    rows = [(k, t, "en", "a" if k < 200 else "b") for k, t in (plain | odd | few | alone).items()]
    kept = {r.doc_id: r.kept for r in adaptive_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert sorted(k for k, v in kept.items() if not v) == [100, 101, 102, 103, 201]


# --- near duplicates

def brute(rows, size, numerator, denominator):
    """Component of every id by comparing all pairs on sets of word tuples."""
    sets = {}
    for key, text in rows:
        w = tokens(text)
        sets.setdefault(key, []).append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            for s in sets[a]:
                for t in sets[b]:
                    both = len(s & t)
                    if s and t and denominator * both >= numerator * (len(s) + len(t) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {k: find(k) for k in keys}


def near_copies(seed, n=120, bases=4, words=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = random.Random(seed * 100 + i % bases)
        text = [f"w{base.randint(0, 400)}" for _ in range(words)]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            text[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append((i * 3 + 1, "  ".join(text).upper() if i % 7 == 0 else " ".join(text)))
    return out


@pytest.mark.parametrize("block", [256, 7])
@pytest.mark.parametrize("spec", [MinHashSpec(words=3, numerator=85), MinHashSpec()])
def test_links_are_those_of_all_pairs(spark, spec, block):
    from dataclasses import replace

    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in near_duplicates(docs, replace(spec, block=block)).collect()}
    wanted = brute(rows, spec.words, spec.numerator, spec.denominator)
    assert {k: r.component_id for k, r in got.items()} == wanted
    assert all(r.kept == (k == wanted[k]) for k, r in got.items()) and len(set(wanted.values())) > 4
    kept = bbit_minhash.first_of_each(docs.withColumn("digest", F.lit(1)), spec)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values())) and kept.columns == ["doc_id", "text", "digest"]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = near_duplicates(docs, MinHashSpec(words=3, numerator=85)).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 11 and by[1].component_id == by[2].component_id == 1 and not by[2].kept
    # The row with a null id is near 1 and takes its id; the one without words has no id to take.
    assert sorted((r.component_id, r.n_shingles > 0) for r in rows if r.doc_id is None and r.n_shingles) == [(1, True)]
    assert all(by[k].component_id == k and by[k].n_shingles == 0 and by[k].kept for k in (3, 4, 5))
    assert near_duplicates(no_documents(spark), MinHashSpec()).collect() == []
    kept = bbit_minhash.first_of_each(docs, MinHashSpec(words=3, numerator=85))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, None]))
    assert bbit_minhash.first_of_each(no_documents(spark), MinHashSpec()).collect() == []


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
        cut = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:cut], rng.integers(0, 2**63, len(a) - cut).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        for bits in (1, 4, 8):
            x, y = (np.frombuffer(packed(minima(s, 240), bits), np.uint8) for s in (a, b))
            assert abs(estimates(x, y[None], 240, bits)[0] - true) < 0.17


def test_shingles():
    assert len(shingles([b"a", b"b"], 3)) == 1 and len(shingles([], 3)) == 0
    assert len(shingles([b"a", b"b", b"a", b"b", b"a"], 2)) == 2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)] + [(300, 301 + i) for i in range(40)]
    root = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "left int, right int")).collect()}
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in links)}
    assert components(spark.createDataFrame([], "left int, right int")).collect() == []
