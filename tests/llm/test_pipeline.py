import random

import pytest

import corpus_pipeline
from moorage.llm.decontaminate import words_of
from tests.llm.fixtures import no_documents, odd_documents
from tests.llm.test_near_and_rules import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, junk and toxic documents, near copies, and documents that hold an item."""
    rng = random.Random(4)
    at = tmp_path_factory.mktemp("corpus")

    def prose(n=90):
        return " ".join(rng.choice(["stone", "river", "light", "under", "morning", "walked", "slowly", "bright", "garden", "window"]) + rng.choice(["", "s", "ing", "er"]) + str(rng.randint(0, 40)) for _ in range(n))

    item = "which of the seven northern lakes freezes first in a cold winter. the answer is the small one by the mill"
    rows, labels = [], []
    for i in range(120):
        kind = ("clean", "clean", "junk", "toxic", "copy", "holds")[i % 6]
        text = prose()
        if kind == "junk":
            text = " ".join(w.upper() + "!!" for w in prose().split()[:20] * 4)
        elif kind == "toxic":
            words = text.split()
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(["vilebeast", "rottenfool"]))
            text = " ".join(words)
        elif kind == "copy":
            text = rows[i - 4][1] + " end"
        elif kind == "holds":
            text = f"{text} {item} {prose(20)}"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_kind = {k: {i for i in texts if i % 6 in v} for k, v in {"clean": (0, 1), "junk": (2,), "toxic": (3,), "copy": (4,), "holds": (5,)}.items()}
    held = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        held.append({r.doc_id for r in docs.collect()})
    # The classifier is fitted on some sixty texts here: no junk stays, and of the others nearly all.
    assert not held[0] & by_kind["junk"] and len(held[0]) >= 0.95 * len(set(texts) - by_kind["junk"])
    assert held[1] == held[0] - by_kind["toxic"]
    assert held[2] == set(brute([(i, texts[i]) for i in held[1]], 5, 80, 100).values()) and len(held[2]) < len(held[1]) - 15
    assert held[3] == {i for i in held[2] if b"northern lakes freezes" not in b" ".join(words_of(texts[i]))}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == held[3] <= by_kind["clean"] | by_kind["copy"] and max(r.offset + r.length for r in packed) <= 2048


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_documents(spark, folder, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and len(rows) <= docs.count()
        else:
            assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}) == len(rows) >= docs.count()
