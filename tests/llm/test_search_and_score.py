import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from moorage.llm import context_tree as ct
from moorage.llm import queries
from moorage.llm.bbit_minhash import tokens
from moorage.llm.decontaminate import ItemIndex, SearchSpec, clean, find_contamination, index_parts, length_band, question_and_answer, words_of
from tests.llm.fixtures import no_documents, odd_documents

# --- benchmark search


def an_index(items, spec=SearchSpec()):
    df = Counter()
    for _, text in items:
        df.update(set(words_of(text)))
        df[b""] += len(words_of(text))
    return ItemIndex(items, spec, df, len(items), df[b""] / len(items))


@pytest.mark.parametrize("seed", range(8))
def test_search_finds_all_above_the_threshold(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 80}" for _ in range(rng.randint(1, 25)))) for i in range(150)]
    index = an_index(items)
    for _ in range(60):
        terms = sorted({rng.randrange(len(index.terms)) for _ in range(rng.randint(1, 30))})
        least = rng.choice([0.1, 0.3, 0.6])
        scores = Counter()
        for t in terms:
            for i, w in zip(index.postings[t], index.weights[t]):
                scores[i] += w
        found = dict(index.search(terms, least))
        assert set(found) == {i for i, s in scores.items() if s >= least - 1e-9}
        assert all(abs(found[i] - scores[i]) < 1e-9 for i in found)


@pytest.mark.parametrize("seed", range(4))
def test_no_passage_above_the_threshold_is_passed_over(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randint(8, 30)))) for i in range(60)]
    index = an_index(items)
    words = [w for _ in range(30) for w in rng.choice([words_of(rng.choice(items)[1]), [b"t%d" % rng.randrange(200) for _ in range(40)]])]
    given = {first: set(terms) for first, terms in index.passages(words)}
    for first in range(0, len(words), index.half):
        terms = {index.terms[w] for w in words[first : first + 2 * index.half] if w in index.terms}
        scores = Counter()
        for t in terms:
            for i, w in zip(index.postings[t], index.weights[t]):
                scores[i] += w
        if max(scores.values(), default=0) >= index.spec.least_score:
            assert given[first] == terms


def test_a_copy_after_shuffled_words_is_found():
    item = " ".join(f"w{i}" for i in range(24))
    other = [f"f{i}" for i in range(400)]
    shuffled = sorted(item.split(), key=lambda w: zlib.crc32(w.encode()))
    index = an_index([(1, item), (2, " ".join(f"f{i}" for i in range(0, 400, 40)))])
    copy = [*other[:128], *item.split(), *other[128:256]]
    text = " ".join([*shuffled, *other[256:], *copy])
    found = [m for m in index.matches(words_of(text)) if m[0] == 1]
    assert len(found) == 1 and found[0][2] >= 200 and found[0][3:] == (1.0, 1.0)
    assert [m for m in index.matches(words_of(" ".join([*shuffled, *other]))) if m[0] == 1] == []


def test_a_long_item_does_not_widen_the_passages_of_short_ones(spark):
    short = [(i, " ".join(f"s{i}x{k}" for k in range(20))) for i in range(5)]
    long = (9, " ".join(f"l{k}" for k in range(900)))
    items = spark.createDataFrame([*short, long], "item_id bigint, text string")
    parts = list(index_parts(items, SearchSpec()))
    assert [[index.half for index in part] for part in parts] == [[32, 450]]
    # The halves of a short item far apart are no match; together, or the long item, they are.
    ends = short[0][1].split()
    rows = [(1, " ".join(ends[:10] + ["w"] * 300 + ends[10:])), (2, "w " * 300 + short[0][1]), (3, "w " * 40 + long[1]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in find_contamination(docs, items).collect()} == {(2, 0), (3, 9)}
    assert sorted(r.doc_id for r in clean(docs, items).collect()) == [1, 4]
    assert [length_band(n) for n in (0, 1, 64, 65, 256, 257, 1024, 1025)] == [0, 0, 0, 1, 1, 2, 2, 3]


def test_questions_and_answers():
    assert question_and_answer("What is it? It is so. Yes it is.") == ([b"what", b"is", b"it", b"it", b"is", b"so"], [b"yes", b"it", b"is"])
    assert question_and_answer("one two three four") == ([b"one", b"two", b"three"], [b"four"])
    assert question_and_answer("") == ([], [])


def test_contamination_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.op7_benchmark_search(spark, folder).collect()}
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    whole = {d.doc_id: b" " + b" ".join(words_of(d.text)) + b" " for d in docs}
    wanted = {(k, i.item_id) for i in items for k, w in whole.items() if b" " + b" ".join(words_of(i.text)) + b" " in w}
    assert wanted and wanted == got


@pytest.mark.parametrize("index_items", [20_000, 2])
def test_odd_documents_and_items(spark, index_items):
    spec = SearchSpec(index_items=index_items)
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "the lazy dog, and then it does so again. While nobody looks at all"), (2, None), (3, ""), (None, "nothing of this kind stands anywhere at once"), (4, "a b c d e"), (4, "a b c d e")], "item_id bigint, text string")
    got = find_contamination(docs, items, spec).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"] and {r.item_id for r in got} == {1}
    left = clean(docs, items, spec)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "5", "6", "7", "8", "None"]
    assert find_contamination(no_documents(spark), items, spec).collect() == []
    assert find_contamination(docs, items.where("false"), spec).collect() == [] and clean(docs, items.where("false"), spec).count() == 11


# --- context trees

TEXTS = ["the then that", "a that", "", "the a the a", "xq", "été then", "that the then a that xq the the", "ab ab ab ab ab ab ab"]


def streams(texts):
    return np.frombuffer(b"".join(ct.stream(tokens(t)) for t in texts), np.uint8)


def in_memory(grams, counts, depth, plan):
    """log2 probability of each gram, by buckets as a job would."""
    edges = np.append(np.searchsorted(grams, plan.lows), len(grams))
    parts, told = [], {}
    for b, root in enumerate(plan.roots.tolist()):
        own = slice(edges[b], edges[b + 1])
        parts.append((root, grams[own], counts[own]))
        if edges[b] < edges[b + 1]:
            told.setdefault(root, []).append(ct.subtree_products(grams[own], counts[own], depth, root))
    told = {r: tuple(np.concatenate(c, axis=-1) for c in zip(*p)) for r, p in told.items()}
    tops = ct.weigh_top(told)
    if max(told) > ct.MIDDLE:  # the same in two steps, as a job does it where roots are long
        deep, short = {r: t for r, t in told.items() if r > ct.MIDDLE}, {r: t for r, t in told.items() if r <= ct.MIDDLE}
        levels = ct.given_levels(deep, ct.MIDDLE)
        middle = (levels[-1].grams, levels[-1].counts, np.stack(list(ct.products(levels))))
        order = np.argsort(np.concatenate([short[ct.MIDDLE][0], middle[0]])) if ct.MIDDLE in short else slice(None)
        both = [np.concatenate([a, b], axis=-1)[..., order] for a, b in zip(short[ct.MIDDLE], middle)] if ct.MIDDLE in short else middle
        above = ct.weigh_top({**short, ct.MIDDLE: tuple(both)})
        found = {**above, **ct.weigh_top(deep, above[ct.MIDDLE], ct.MIDDLE)}
        for r, (grams, mixed) in tops.items():
            at = np.searchsorted(found[r][0], grams)
            assert (found[r][0][at] == grams).all() and found[r][1][:, :, at] == pytest.approx(mixed, abs=1e-5)
    return np.concatenate([ct.weigh_bucket(g, c, depth, r, *tops[r]) for r, g, c in parts if len(g)])


def truth(grams, counts, depth):
    """The same by the recursive definition."""
    size = depth + 1
    rows = [(g.to_bytes(size, "big")[:-1], g & 255, int(c)) for g, c in zip(grams.tolist(), counts.tolist())]
    seen, below = {}, {}
    for context, byte, c in rows:
        for k in range(8):
            for d in range(size):
                node = (context[:d], k, byte >> 8 - k)
                seen.setdefault(node, [0, 0])[byte >> 7 - k & 1] += c
                if d < depth:
                    below.setdefault(node, set()).add((context[: d + 1], k, byte >> 8 - k))

    def pe(node):
        a, b = seen[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @lru_cache(None)
    def pw(node):
        return pe(node) if node not in below else np.logaddexp(pe(node), sum(map(pw, below[node]))) - math.log(2)

    out = []
    for context, byte, _ in rows:
        total = 0.0
        for k in range(8):
            p = None
            for d in range(depth, -1, -1):
                node = (context[:d], k, byte >> 8 - k)
                c = seen[node]
                if sum(c):
                    kt = (c[byte >> 7 - k & 1] + 0.5) / (sum(c) + 1)
                    own = 1 if p is None else 1 / (1 + math.exp(sum(map(pw, below[node])) - pe(node)))
                    p = kt if p is None else own * kt + (1 - own) * p
            total += math.log2(p or 0.5)
        out.append(total)
    return out


@pytest.mark.parametrize("most", [1e9, 6, 1])
@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_tree_is_context_tree_weighting(depth, most):
    flat = streams(TEXTS * 3)
    train = np.array([i % len(TEXTS) != 5 for i in range(len(TEXTS) * 3)])
    grams, counts = ct.count_grams(flat, depth, train)
    plan = ct.plan_buckets(np.sort(ct.stream_grams(flat, depth, 0, len(flat))), depth, most)
    assert (counts == 0).any() and (most > 6 or depth < 3 or len(set(plan.roots.tolist())) > 1)
    assert in_memory(grams, counts, depth, plan) == pytest.approx(truth(grams, counts, depth), abs=1e-5)


def test_decisions_are_a_distribution():
    depth = 3
    grams, counts = ct.count_grams(streams(TEXTS), depth, np.ones(len(TEXTS), bool))
    context = int(grams[len(grams) // 2]) & ~255
    every = np.array([context | b for b in range(256)], np.uint64)
    both, n = ct._collapse([(grams, counts), (every, np.zeros(256, np.int64))])
    p = in_memory(both, n, depth, ct.plan_buckets(grams, depth, 4))[np.searchsorted(both, every)]
    assert (2.0**p).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("most", [0.5, 3, 40, 1000])
@pytest.mark.parametrize("depth", [2, 4, 6])
def test_buckets_are_bounded_subtrees(depth, most):
    rng = random.Random(depth)
    flat = streams([" ".join("".join(rng.choice("aaaaab") for _ in range(rng.randint(1, 9))) for _ in range(200))] * 3)
    grams = np.sort(ct.stream_grams(flat, depth, 0, len(flat)))
    plan = ct.plan_buckets(grams, depth, most)
    edges = np.append(np.searchsorted(grams, plan.lows), len(grams))
    assert plan.lows[0] == 0 and (np.diff(plan.lows.astype(object)) > 0).all() and 1 <= plan.roots.min() <= plan.roots.max() < depth
    subtrees = []
    for b, root in enumerate(plan.roots.tolist()):
        own = [g.to_bytes(depth + 1, "big") for g in grams[edges[b] : edges[b + 1]].tolist()]
        assert len({g[: root - 1] for g in own}) <= 1
        assert len(own) <= most or len({g[:root] for g in own}) == 1 and root == depth - 1
        subtrees += [(b, g[:root]) for g in set(own)]
    assert len(set(subtrees)) == len({root for _, root in subtrees})


def test_no_bucket_is_without_sample():
    plan = ct.plan_buckets(np.zeros(0, np.uint64), 6, 0.0)
    assert plan.lows.tolist() == [0] and plan.roots.tolist() == [1]


def base(rows, held):
    known = Counter()
    for text, out in zip(rows, held):
        if not out:
            known.update([*tokens(text), b"\n"])
    n, v = sum(known.values()), len(known)
    out = []
    for text in rows:
        words = [*tokens(text), b"\n"]
        out.append((len(words), sum(known[w] > 0 for w in words), n, sum(math.log10((known[w] + 1) / (n + v + 1)) for w in words)))
    return out


@pytest.mark.parametrize("chunk", [32_000_000, 1000])
def test_scores_of_a_small_table(spark, chunk, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK_BYTES", chunk)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    got = {r.doc_id: r for r in queries.op8_context_tree(spark, "/root/testdata/sf0.001").collect()}
    for row, out, (n, known, total, plain) in zip(rows, held, base([r.text for r in rows], held)):
        r = got[row.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(plain) and r.score < 0


def test_odd_texts(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "doc_id = 2 AS held_out")
    got = ct.score_documents(docs).collect()
    empty = [r for r in got if r.n_tokens == 1]
    assert len(got) == 11 and len(empty) == 4 and len({(r.score, r.base_score) for r in empty}) == 1
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert ct.score_documents(docs.where("false")).collect() == []
    unlearned = ct.score_documents(docs.selectExpr("doc_id", "text", "true AS held_out")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in unlearned)


def whole_tree(texts, depth):
    """log10 of each text when every context of the texts has a node, weighed in one piece."""
    flat = streams(texts)
    grams, counts = ct.count_grams(flat, depth, np.ones(len(texts), bool))
    logs = in_memory(grams, counts, depth, ct.plan_buckets(grams[:0], depth, 0.0))
    each = logs[np.searchsorted(grams, ct.stream_grams(flat, depth, 0, len(flat)))]
    ends = np.flatnonzero(flat == 10)
    return np.add.reduceat(each, np.append(0, ends[:-1] + 1)) * math.log10(2)


@pytest.mark.parametrize("chunk, broadcast", [(32_000_000, 1 << 20), (1000, 0)])
@pytest.mark.parametrize("depth", [1, 2, 6])
def test_rare_contexts_have_nodes_in_a_large_corpus(spark, chunk, broadcast, depth, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ct, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(ct, "SLICE", 7_001)
    monkeypatch.setattr(ct, "SMALL_BUCKET_BYTES", 3_000)
    monkeypatch.setattr(ct, "SAMPLE_STEP", 16)
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(300)), False) for i in range(150)]
    docs = spark.createDataFrame([*rows, (150, "", False)], "doc_id int, text string, held_out boolean")
    got = {r.doc_id: r.score for r in ct.score_documents(docs, depth=depth).collect()}
    texts = [t for _, t, _ in rows] + [""]
    assert sum(map(len, texts)) > 1 << 17
    assert [got[i] for i in range(151)] == pytest.approx(whole_tree(texts, depth).tolist(), rel=1e-5)


def test_contexts_reach_across_words(spark):
    flat = np.frombuffer(b"ab cd\nef\n", np.uint8)
    parts = [ct.stream_grams(flat, 6, a, b) for a, b in [(0, 2), (2, 4), (4, 9)]]
    wanted = [b"      a", b"     ab", b"    ab ", b"   ab c", b"  ab cd", b" ab cd\n", b"      e", b"     ef", b"    ef\n"]
    assert [g.to_bytes(7, "big") for g in np.concatenate(parts).tolist()] == [w[-2::-1] + w[-1:] for w in wanted]
    assert ct.grams_at(flat, 6, np.array([1, 3, 7])).tolist() == np.concatenate(parts)[[1, 3, 7]].tolist()
    rows = [(i, "red sky and blue sea", False) for i in range(40)] + [(40, "red sky and blue sea", True), (41, "sea blue red and sky", True)]
    got = {r.doc_id: r for r in ct.score_documents(spark.createDataFrame(rows, "doc_id int, text string, held_out boolean")).collect()}
    assert got[40].base_score == pytest.approx(got[41].base_score) and got[40].score > got[41].score + 3
