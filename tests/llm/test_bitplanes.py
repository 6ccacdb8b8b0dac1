import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from urlsieve.llm.bitplanes import ByteBpe, crc_join, document_digests, from_planes, read_planes, to_planes, write_planes
from urlsieve.llm.store import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
BPE = ByteBpe(PATH)


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="aB é\n\t 　.'s1<|>日", max_size=400), max_size=4))
def test_memory_of_chunks_equals_the_library(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in BPE.encode(pa.array(texts, pa.string()))]
    assert got == [ids(t)[:-1] for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    for values in ([0], [2**32 - 1, 0, 7], list(range(50_000))):
        block = np.array(values, "<u4")
        assert from_planes(len(block), bits, *to_planes(block, bits, 1)).tolist() == values


def test_crc_of_joined_parts():
    a, b = b"abc" * 77, b"\x00\xff" * 1234
    assert crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize(("bits", "block"), [(False, 64), (True, 1000)])
def test_files_hold_all_ids_in_order(spark, odd_docs, odd_rows, bits, block):
    out = scratch(spark, "planes")
    write_planes(odd_docs, out, PATH, bits=bits, block=block)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in document_digests(spark, out).collect())
    assert [g[1] for g in got] == sorted((i for i, *_ in odd_rows), key=lambda x: (x is not None, x))
    ends = [0, *np.cumsum([g[2] for g in got]).tolist()]
    assert [g[0] for g in got] == ends[:-1]
    want = sorted((str(i), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t, _, _ in odd_rows)
    assert sorted((str(g[1]), g[2], g[3]) for g in got) == want
    blocks = sorted(read_planes(spark, out).collect(), key=lambda r: (r.part, r.block))
    assert all(len(b.ids) == b.n <= block for b in blocks) and sum(b.n for b in blocks) == ends[-1]


def test_empty_table(spark, no_docs):
    out = scratch(spark, "planes")
    write_planes(no_docs, out, PATH)
    assert document_digests(spark, out).collect() == []
