import numpy as np
import pyarrow as pa

from urlsieve.llm.store import parts
from urlsieve.llm.text import cut_words, spans, utf8, window_hashes, word_hashes

TEXTS = ["", None, "a", " a  b ", "a\tb\nc\x0bd", "x" * 300_000, "é ü z a", "   ", "b a"]


def test_words_are_those_of_split():
    data, offs = utf8(pa.array(TEXTS))
    s, e, first = spans(data, offs)
    raw = data.tobytes()
    got = [[raw[s[w] : e[w]] for w in range(first[k], first[k + 1])] for k in range(len(TEXTS))]
    assert got == [(t or "").encode().split() for t in TEXTS]
    assert cut_words(data, s, e).to_pylist() == [w.decode() for ws in got for w in ws]


def test_sliced_arrays_keep_their_texts():
    data, offs = utf8(pa.array(["no", *TEXTS, "no"]).slice(1, len(TEXTS)))
    assert [data[a:b].tobytes().decode() for a, b in zip(offs, offs[1:], strict=False)] == [t or "" for t in TEXTS]


def test_equal_words_and_windows_have_equal_hashes():
    words = (b"".join(b"w%d " % (k % 977) for k in range(20_000))).decode()
    data, offs = utf8(pa.array([words]))
    s, e, _ = spans(data, offs)
    h = word_hashes(data, s, e)
    assert len(np.unique(h)) == 977 and (h[:977] == h[977 : 2 * 977]).all()
    runs = window_hashes(h, 20)
    assert len(np.unique(runs)) == 977 and (runs[:977] == runs[977 : 2 * 977]).all()
    assert len(window_hashes(h[:5], 20)) == 0


def test_parts_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 50, 5, 5)], "k": [1, 2, 3, 4, 5]})
    cut = list(parts([batch, batch.slice(0, 0)], "text", 12))
    assert [b.column("k").to_pylist() for b in cut] == [[1, 2], [3], [4, 5]]
