import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moorage.llm.base import fresh_folder
from moorage.llm.repair import BLOCKS, Block, compress, read_ids, write_ids
from moorage.llm.tokens import Encoder, TokenizerFile
from tests.llm.fixtures import no_documents, odd_documents, odd_rows

TOKENIZER = TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=8), top=st.sampled_from([0, 65_000, 2**31]))
def test_round_trip(docs, top):
    docs = [[i + top * (i == 3) for i in d] for d in docs]
    ids, lengths = np.array([i for d in docs for i in d], np.uint32), np.array([len(d) for d in docs], np.int64)
    if top < 2**31:
        block = Block(compress(ids, lengths, least=2))
        assert block.all_ids().tolist() == ids.tolist() and block.doc_lengths.tolist() == lengths.tolist()
        for k, d in enumerate(docs):
            assert block.ids(k).tolist() == d
            assert [block.id_at(k, p) for p in range(len(d))] == d


def test_repeats_shrink_and_rules_stay_within_documents():
    one = [5, 6, 7, 8] * 100
    ids, lengths = np.array(one * 50, np.uint32), np.full(50, 400)
    data = compress(ids, lengths)
    block = Block(data)
    assert len(block.symbols) < len(ids) / 8 and len(block.rules) >= 3
    assert block.rule_lengths.max() == 16 and block.all_ids().tolist() == ids.tolist()
    runs = np.full(1001, 9, np.uint32)
    assert Block(compress(runs, np.array([1000, 1]))).all_ids().tolist() == runs.tolist()


def test_not_a_block():
    with pytest.raises(ValueError):
        Block(b"\0" * 32)


@pytest.mark.parametrize("block_ids", [10, 2_000_000])
def test_documents(spark, block_ids):
    path = fresh_folder(spark, "ids")
    write_ids(odd_documents(spark), TOKENIZER, path, end_id=1, block_ids=block_ids)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_ids(spark, path).collect())
    encode = Encoder(TOKENIZER.text)
    wanted = [(i, encode.ids(t or "") + b"\1\0\0\0") for i, t, *_ in odd_rows()]
    assert [r[1] for r in got] == sorted((i for i, _ in wanted), key=lambda i: (i is not None, i))
    assert sorted((r[1] or 0, r[2], r[3]) for r in got) == sorted((i or 0, len(d) // 4, zlib.crc32(d)) for i, d in wanted)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n


def test_nothing(spark):
    path = fresh_folder(spark, "ids")
    write_ids(no_documents(spark), TOKENIZER, path, end_id=1)
    assert read_ids(spark, path).collect() == [] and spark.read.schema(BLOCKS).parquet(path).count() == 0
