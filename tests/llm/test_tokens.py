from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moorage.llm import digest_counts
from moorage.llm.base import fresh_folder
from moorage.llm.tokens import Encoder, TokenizerFile
from tests.llm.fixtures import no_documents, odd_documents, odd_rows

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ENCODERS = {f: Encoder(TokenizerFile.read(public_tokenizers.path(f)).text) for f in FILES}
WHOLE = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(st.characters(max_codepoint=255), max_size=60), st.text("ab 's\n1é \x85\x1c", max_size=40)))
def test_ids_are_the_librarys(name, text):
    assert ENCODERS[name].ids(text) == array("I", WHOLE[name].encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("name", FILES)
def test_special_strings_and_long_texts(name):
    for _, text, *_ in odd_rows():
        assert ENCODERS[name].ids(text or "") == array("I", WHOLE[name].encode(text or "", add_special_tokens=False).ids).tobytes()


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr("moorage.llm.tokens.KEPT_PIECES", 3)
    own = Encoder(TokenizerFile.read(public_tokenizers.path(FILES[0])).text)
    text = "one two three four five six one two"
    assert own.ids(text) == ENCODERS[FILES[0]].ids(text) and len(own) <= 3


def expected_counts():
    rows = [(i, t or "") for i, t, *_ in odd_rows()]
    return sorted(((i, len(t.encode()), len(WHOLE[FILES[0]].encode(t, add_special_tokens=False).ids)) for i, t in rows), key=str)


def test_counts_and_cache(spark):
    tokenizer = TokenizerFile.read(public_tokenizers.path(FILES[0]))
    path = fresh_folder(spark, "cache")
    docs = odd_documents(spark)
    assert sorted(map(tuple, digest_counts.count_tokens(docs, tokenizer, path).collect()), key=str) == expected_counts()
    stored = spark.read.parquet(path).collect()
    # "", null and blank text are one content for a tokenizer that drops white space; copies are one too.
    assert len(stored) == len({bytes(r.content_digest) for r in stored}) == 6
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9, "new  text"), (10, "new text")], "doc_id bigint, text string"))
    again = digest_counts.count_tokens(more, tokenizer, path)
    assert again.count() == 13 and again.where("n_tokens IS NULL").count() == 0
    assert spark.read.parquet(path).count() == 7
    other = TokenizerFile.read(public_tokenizers.path(FILES[1]))
    assert digest_counts.count_tokens(docs, other, path).agg(F.sum("n_tokens")).first()[0] == sum(len(ENCODERS[FILES[1]].ids(t or "")) // 4 for _, t, *_ in odd_rows())


def test_counts_of_nothing(spark):
    tokenizer = TokenizerFile.read(public_tokenizers.path(FILES[0]))
    assert digest_counts.count_tokens(no_documents(spark), tokenizer, fresh_folder(spark, "cache")).collect() == []
