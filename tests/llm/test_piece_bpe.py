import hashlib

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from urlsieve.llm import piece_bpe
from urlsieve.llm.queries import op8_piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = piece_bpe.PieceBpe(PATH)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab the▁ \n\té日\x00😀1.,<s>", max_size=80))
def test_ids_and_text_equal_the_library(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode(text) and OWN.decode(ids) == LIBRARY.decode(ids)


def test_a_full_memory_changes_nothing(monkeypatch, sample):
    monkeypatch.setattr(piece_bpe, "MEMORY", 2000)
    monkeypatch.setattr(piece_bpe, "PAIRS", 30)
    own = piece_bpe.PieceBpe(PATH)
    for _, text in sample[:20]:
        assert own.encode(text) == LIBRARY.encode(text)


def test_query_against_the_library(spark, sample, small_dir):
    got = sorted(tuple(r) for r in op8_piece_bpe(spark, small_dir).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [LIBRARY.encode(t or "") for _, t in sample]
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x))) for (i, _), x in zip(sample, ids, strict=True))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = piece_bpe.encode_pieces(odd_docs, PATH).collect()
    want = [(i, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, _, _ in odd_rows]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert piece_bpe.encode_pieces(no_docs, PATH).collect() == []
