import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moorage.llm import language_mix, pu_quality, queries, toxic_segments
from tests.llm.fixtures import no_documents, odd_documents

SMALL = "/root/testdata/sf0.01"


# --- quality

def test_features_of_odd_texts():
    assert not pu_quality.features(None).any() and not pu_quality.features("").any()
    assert np.isfinite(pu_quality.features("a" * 100_000)).all() and len(pu_quality.features("é😀")) == pu_quality.N_FEATURES


def test_prior_is_the_share_of_positives():
    rng = np.random.default_rng(1)
    good = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)])
    assert abs(pu_quality.estimate_prior(good, mixed) - 0.7) < 0.06


def test_negatives_are_found_without_negative_labels():
    rng = random.Random(3)
    good = ["the cat sat on the mat and looked at a bird " * rng.randint(1, 4) for _ in range(300)]
    bad = ["BUY!! NOW!! $$$ %%% | CLICK!! " * rng.randint(1, 4) for _ in range(60)]
    x = np.stack([pu_quality.features(t) for t in good + bad])
    model = pu_quality.fit(x[:150], x[150:])
    scores = model.score(x)
    assert scores[:300].min() > 0.7 > 0.3 > scores[300:].max()


@pytest.mark.parametrize("seed", range(6))
def test_slopes_are_those_of_the_risk(seed):
    rng = np.random.default_rng(seed)
    prior = [0.2, 0.5, 0.9][seed % 3]
    p, u = rng.normal(1, 2, 7), rng.normal(-4 if seed > 2 else 0, 2, 11)

    def plain(x):
        return np.log1p(np.exp(x))

    on_positives, on_negatives = pu_quality.risk(p, u, prior)
    assert on_positives == pytest.approx(prior * sum(plain(-x) for x in p) / len(p))
    assert on_negatives == pytest.approx(sum(map(plain, u)) / len(u) - prior * sum(map(plain, p)) / len(p))
    below = on_negatives < 0

    def stepped_down(p, u):
        a, b = pu_quality.risk(p, u, prior)
        return -b if below else a + b

    gp, gu = pu_quality.slopes(p, u, prior)
    for scores, slope, at in ((p, gp, 0), (u, gu, 1)):
        for k in range(len(scores)):
            both = []
            for step in (1e-6, -1e-6):
                moved = [p.copy(), u.copy()]
                moved[at][k] += step
                both.append(stepped_down(*moved))
            assert slope[k] == pytest.approx((both[0] - both[1]) / 2e-6, abs=1e-7)


def test_both_signs_of_the_risk_on_negatives_were_met():
    signs = set()
    for seed in range(6):
        rng = np.random.default_rng(seed)
        signs.add(pu_quality.risk(rng.normal(1, 2, 7), rng.normal(-4 if seed > 2 else 0, 2, 11), [0.2, 0.5, 0.9][seed % 3])[1] < 0)
    assert signs == {True, False}


@pytest.mark.parametrize("text", ["Ab1 .!|#é\n\n\t(x) ZZ", "a", "", "one two two\none two two\n" * 9, "été\x01 œ ß"])
def test_features_are_shares(text):
    got = pu_quality.features(text)
    data = text.encode()
    kinds = [int(pu_quality._CLASS_OF[c]) for c in data]
    n = len(kinds)
    pairs, triples = np.zeros(169), np.zeros(256)
    for k in range(n - 1):
        pairs[kinds[k] * 13 + kinds[k + 1]] += 1
    for k in range(n - 2):
        triples[zlib.crc32(bytes(kinds[k : k + 3])) % 256] += 1
    assert got[:169] == pytest.approx(np.sqrt(pairs / max(n, 1)), abs=1e-6)
    assert got[169:425] == pytest.approx(np.sqrt(triples / max(n, 1)), abs=1e-6)
    assert len(set("abz")) == 3 and len({int(pu_quality._CLASS_OF[ord(c)]) for c in "aA1 \n\t.;!|#\x01"}) == 12


def test_quality_query(spark):
    got = queries.op1_pu_quality(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert got.count() == 1000 and held > 0.95
    assert got.where("score < 0 OR score > 1 OR (predicted = 1) <> (score >= 0.7) OR held_out IS NULL").count() == 0


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_quality_of_odd_documents(spark, make):
    docs = make(spark)
    positives = spark.createDataFrame([(1,), (1,), (2,), (None,), (99,)], "doc_id bigint")
    model = pu_quality.train(docs, positives)
    scored = pu_quality.score(docs, model).select("doc_id", "text", "score").collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not r.text}) <= 1


# --- toxic segments

def naive_segments(scores):
    """Largest-sum segment first, shortest among equals, then the same left and right of it."""

    def go(low, high):
        best = None
        for a in range(low, high):
            total = 0
            for b in range(a, high):
                total += scores[b]
                if total > 0 and (best is None or total > best[0] or total == best[0] and b - a < best[2] - best[1]):
                    best = (total, a, b)
        return [] if best is None else go(low, best[1]) + [best] + go(best[2] + 1, high)

    return go(0, len(scores))


@pytest.mark.parametrize("seed", range(60))
def test_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-5.5, -3.25, -1.125, 1.0625, 2.5, 4.03125]) + rng.randint(0, 9) / 1024 for _ in range(rng.randint(0, 14))]
    assert toxic_segments.maximal_segments(scores) == naive_segments(scores)  # sums of binary fractions are exact


def test_stems_lend_their_odds():
    model = toxic_segments.ToxicModel({"3bad": (50, 0), "4badw": (50, 0), "5badwo": (50, 0), "=fine": (0, 200)}, 0.1)
    assert model.token_score("badword") > 3 > model.token_score("badge") > 0 > model.token_score("other") == -1.0 > model.token_score("fine")


def test_token_scores_are_dirichlet_means():
    rng = random.Random(2)
    counts = {f"{n}{'abcdefgh'[:n]}": (rng.randint(0, 30), rng.randint(0, 90)) for n in (3, 5, 6)} | {"=abcdefgh": (7, 1), "=ab": (0, 5)}
    model = toxic_segments.ToxicModel(counts, 0.07, strength=11.0, drift=0.6)

    def expected(word):
        share = 0.07
        for key in (*(f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n), "=" + word):
            if key in counts:
                toxic, clean = counts[key]
                share = (toxic + 11.0 * share) / (toxic + clean + 11.0)
        return math.log(share / (1 - share)) - math.log(0.07 / 0.93) - 0.6

    for word in ("abcdefgh", "abcdefg", "abcdef", "abcde", "abc", "ab", "zz", "abcxyz"):
        assert model.token_score(word) == pytest.approx(expected(word))


@pytest.mark.parametrize("seed", range(4))
def test_keys_lambda_and_k_by_direct_sums(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"{c}{d}word{i}" for c in "abc" for d in "xyz" for i in range(6)]
    rows = []
    for i in range(160):
        toxic = int(i % 4 == 0)
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] + ["vileness"] * (toxic * 2)
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(3)
    held = {}
    for _, text, toxic in rows:
        for key in {k for w in set(text.split()) for k in toxic_segments._levels(w)}:
            held.setdefault(key, [0, 0])[1 - toxic] += 1
    assert {r.key: [r.toxic, r.clean] for r in toxic_segments.count_keys(docs).collect()} == held

    model = toxic_segments.train(docs, docs.select("doc_id", "toxic"))
    words = [w for _, text, toxic in rows if not toxic for w in text.split()]
    scores = [round(20 * model.token_score(w)) / 20 for w in words]
    if max(scores) > 0:
        assert sum(math.exp(model.decay * s) for s in scores) / len(scores) == pytest.approx(1, abs=1e-6)
    clean = [(len(text.split()), max((s for s, _, _ in model.segments(text)[1]), default=0.0)) for _, text, toxic in rows if not toxic]
    assert model.density == pytest.approx(len(clean) / sum(n * math.exp(-model.decay * best) for n, best in clean))
    x = [(model.evidence(text), toxic) for _, text, toxic in rows]
    assert min(model.score(t) for _, t, toxic in rows if toxic) > max(model.score(t) for _, t, toxic in rows if not toxic) or {e for e, t in x if t} & {e for e, t in x if not t}


def test_each_passage_is_judged_on_its_own():
    bad = ["vile", "rotten", "beast", "filthy", "scum"]
    model = toxic_segments.ToxicModel({f"={w}": (95, 5) for w in bad}, 0.05)
    passage, plain = " ".join(bad), " ".join(f"plain{i}" for i in range(300))
    alone = model.segments(passage)[1][0][0]
    once_each = " ".join(f"{w} {plain}" for w in bad * 8)
    late = model.segments(f"{once_each} {passage}")[1]
    assert late[-1][0] == pytest.approx(alone) and late[-1][0] == max(s for s, _, _ in late)
    thrice = model.segments(f"{passage} {plain} {passage} {plain} {passage}")[1]
    assert [s for s, _, _ in thrice] == pytest.approx([alone] * 3)
    # Near copies: each lies in a passage. One word over and over scores no more than a few words.
    near = model.segments(" ".join(f"{passage} a b c d" for _ in range(12)))[1]
    assert {k for _, a, b in near for k in range(a, b + 1)} >= {9 * n + k for n in range(12) for k in range(5)}
    assert max(s for s, _, _ in model.segments("vile " * 5000)[1]) < alone / 2


def test_toxic_query(spark):
    got = queries.op3_toxic_segments(spark, SMALL)
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    # In these tables only English documents labelled toxic hold toxic words.
    known = got.join(labels, "doc_id").join(docs.where("lang = 'en'").select("doc_id"), "doc_id").where("held_out")
    assert got.count() == 1000 and known.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.97
    assert got.where("score < 0 OR score > 1 OR (predicted = 1) <> (score >= 0.5)").count() == 0


def test_passages(spark):
    clean = [f"plain words number {i} stand here and there {i * 7}" for i in range(60)]
    toxic = [c + " you vile rotten beast " + c for c in clean[:30]]
    rows = [(i, t, int(i >= 60)) for i, t in enumerate(clean + toxic)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = toxic_segments.train(docs, docs.select("doc_id", "toxic"))
    found = toxic_segments.passages(docs, model).collect()
    assert {r.doc_id for r in found} == set(range(60, 90))
    assert all("rotten" in r.passage and r.passage == rows[r.doc_id][1][r.start : r.stop] and r.e_value <= 1 for r in found)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (7, 0)]])
def test_toxicity_of_odd_documents(spark, make, labels):
    docs = make(spark)
    model = toxic_segments.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    scored = toxic_segments.score(docs, model).select("score").collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxic_segments.passages(docs, model).count() >= 0


# --- languages

def test_mixtures():
    texts = {"aa": "kala mala sala tala lama nasa " * 20, "bb": "woru boru toru zoru gouru hurou " * 20, "cc": "piti kiti miti siti riti niti " * 20}
    counts = np.full((1 << 16, 3), 0.1)
    for k, t in enumerate(texts.values()):
        np.add.at(counts[:, k], language_mix.trigrams(t)[0], 1)
    model = language_mix.LanguageModel(tuple(texts), np.log(counts / counts.sum(0)).astype(np.float32))
    best, top, shares = model.predict([*texts.values(), texts["aa"] + texts["aa"] + texts["bb"], "", None, "123 !?", "kala"])
    assert best == ["aa", "bb", "cc", "aa", "und", "und", "und", "aa"]
    assert shares[3] == pytest.approx([2 / 3, 1 / 3, 0], abs=0.01) and (shares[0] > 0).sum() == 1
    assert top[4:7].tolist() == [0, 0, 0] and all(0 <= t <= 1 for t in top)


def by_subsets(likelihoods, subset, rounds):
    """Shares of a set of languages by EM from even ones, and the mixture's cost, in plain sums."""
    shares = {k: 1 / len(subset) for k in subset}
    for _ in range(rounds if len(subset) > 1 else 1):
        sums = dict.fromkeys(subset, 0.0)
        for word in likelihoods:
            total = sum(shares[k] * math.exp(word[k] - max(word)) for k in subset)
            for k in subset:
                sums[k] += shares[k] * math.exp(word[k] - max(word)) / total
        shares = {k: v / len(likelihoods) for k, v in sums.items()}
    fit = sum(max(word) + math.log(sum(shares[k] * math.exp(word[k] - max(word)) for k in subset)) for word in likelihoods)
    return shares, -2 * fit + (len(subset) - 1) * math.log(max(2, len(likelihoods)))


@pytest.mark.parametrize("seed", range(5))
def test_mixtures_by_all_subsets(seed):
    rng = random.Random(seed)
    sounds = {"aa": "kltm", "bb": "wrbz", "cc": "pkts", "dd": "gnhv"}
    texts = {name: " ".join("".join(rng.choice(cons) + rng.choice("aeiou") for _ in range(3)) for _ in range(300)) for name, cons in sounds.items()}
    counts = np.full((1 << 16, 4), 0.1)
    for k, t in enumerate(texts.values()):
        np.add.at(counts[:, k], language_mix.trigrams(t)[0], 1)
    model = language_mix.LanguageModel(tuple(texts), np.log(counts / counts.sum(0)).astype(np.float32))
    asked = []
    for _ in range(12):
        names = rng.sample(list(texts), rng.randint(1, 3))
        asked.append(" ".join(" ".join(rng.sample(texts[n].split(), rng.choice([3, 15, 40]))) for n in names))
    _, _, found = model.predict(asked, rounds=6)
    for text, got in zip(asked, found):
        slots, begins = language_mix.trigrams(text)
        likelihoods = [[float(x) for x in row] for row in np.add.reduceat(model.log_p[slots], begins, axis=0).astype(float)]
        costs = {}
        for bits in range(1, 16):
            subset = tuple(k for k in range(4) if bits >> k & 1)
            costs[subset] = by_subsets(likelihoods, subset, 6)
        chosen = tuple(np.flatnonzero(got).tolist())
        # The set found is as cheap as any, and its shares are those of EM.
        assert costs[chosen][1] == pytest.approx(min(c for _, c in costs.values()), abs=1e-3)
        assert [got[k] for k in chosen] == pytest.approx([costs[chosen][0][k] for k in chosen], abs=1e-5)


def test_language_query(spark):
    got = queries.op4_language_mix(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    assert got.count() == 1000
    assert got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_language_of_odd_documents(spark, make):
    docs = make(spark)
    rows = language_mix.identify(docs, language_mix.train(docs)).select("text", "lang_pred", "score").collect()
    assert len(rows) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not (r.text or "").strip())
    assert all(r.lang_pred in ("en", "fr") for r in rows if (r.text or "").strip())
    unlearned = language_mix.identify(docs, language_mix.train(docs.where("false"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlearned] in ([], ["und"])
