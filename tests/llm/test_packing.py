import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from moorage.llm.packing import cut, empty_bins, pack, pack_documents, pack_lengths
from moorage.llm.tokens import Encoder, TokenizerFile
from tests.llm.fixtures import no_documents, odd_documents, odd_rows

TOKENIZER = TokenizerFile.read(public_tokenizers.path("byte_bpe_50k.json"))


def valid(bins, lengths, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= capacity for b in bins)


@pytest.mark.parametrize("seed", range(20))
def test_bins_are_valid_and_few(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, rng.choice([20, 60, 100])) for _ in range(200)), reverse=True)
    bins = pack_lengths(lengths, 100)
    valid(bins, lengths, 100)
    plain = pack_lengths(lengths, 100, tries=0)
    assert len(bins) <= len(plain) <= -(-sum(lengths) // 100) * 11 // 9 + 2


def test_local_search_empties_a_bin_by_swaps():
    # Best fit would not make these bins; swaps fill the first two and empty the third.
    lengths = [60, 50, 40, 30, 20]
    bins = empty_bins([[0, 4], [1, 3], [2]], lengths, 100, tries=1000)
    valid(bins, lengths, 100)
    assert len(bins) == 2


def test_two_for_one():
    lengths = [55, 50, 30, 25, 20, 20]
    bins = empty_bins([[0, 3], [1, 4, 5], [2]], lengths, 100, tries=1000)
    valid(bins, lengths, 100)
    assert len(bins) == 2


def test_search_goes_on_among_many_underfull_bins():
    rng = random.Random(3)
    lengths = sorted((rng.randint(300, 900) for _ in range(4000)), reverse=True)
    bins = pack_lengths(lengths, 2048)
    valid(bins, lengths, 2048)
    assert len(bins) <= len(pack_lengths(lengths, 2048, tries=0)) - 15


def check(rows, texts, capacity):
    encode = Encoder(TOKENIZER.text)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = defaultdict(list)
    for key, text in texts:
        data = encode.ids(text or "") + b"\0\0\0\0"
        n = len(data) // 4
        first = (n - 1) % capacity + 1
        edges = [0, *range(first, n + 1, capacity)]
        wanted[key] += [(k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in wanted.items()}
    return len(by_sequence)


def test_documents(spark):
    rows = pack_documents(odd_documents(spark), TOKENIZER, capacity=64, end_id=0).collect()
    sequences = check(rows, [(i, t) for i, t, *_ in odd_rows()], 64)
    assert sequences == -(-sum(r.length for r in rows) // 64)


def test_many_groups(spark):
    pieces = cut(odd_documents(spark), TOKENIZER, capacity=64, end_id=0)
    check(pack(pieces, capacity=64, group_pieces=50).collect(), [(i, t) for i, t, *_ in odd_rows()], 64)


def test_nothing(spark):
    assert pack_documents(no_documents(spark), TOKENIZER, capacity=64, end_id=0).collect() == []
