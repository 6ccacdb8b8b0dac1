"""Operator 8: SentencePiece BPE by a merge-type prefix table.

For every prefix of a text the last token of its encoding is unique: the token t that ends
there and whose predecessor, the last token of the prefix before t, is *compatible* with
it, i.e. the pair does not merge across its border. An automaton lists the tokens that end
at each position, pair tests pick the one that is right, and the ids follow backwards from
the end. Merges go by piece score, the leftmost first, as in the library.

Texts fall apart at word marks that follow another character, since no piece of the
vocabulary has a mark there (checked when the model is read); repeated chunks are encoded
once per Python worker. Nulls are empty texts; an empty text has no ids and decodes to an
empty text. Rows are independent, so repeated rows, ties and extra columns do not matter.
Texts and words of any length are encoded whole; only words up to ``LONG`` characters are
remembered. A worker remembers ``MEMORY`` bytes of words at most, and ``PAIRS`` pair tests.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from urlsieve.llm.store import parts, table, tidy

MARK = "▁"
MEMORY = 96 << 20
PAIRS = 200_000
LONG = 512
#: bytes of a dictionary's place for one entry
ENTRY = 100


class PieceBpe:
    """Vocabulary, automaton and pair tests of one model file."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only models with identity normalisation and a dummy prefix")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces) or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback and neither user-defined nor unused pieces")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece holds a word mark after another character")
        self.bytes = [0] * 256
        self.raw = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.raw.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.raw.append(p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else b"")
        self.longest = max(map(len, self.ids))
        self.tokens = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.merged(piece) == [piece]:  # only such a piece can be a token of any encoding
                self.tokens.add_word(piece, (piece, len(piece)))
        self.tokens.make_automaton()
        #: neighbours inside some piece; between any other two characters every encoding has a border
        self.inner = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.decimal = [str(i) for i in range(len(self.raw))]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.inside: dict[str, bytes] = {}
        self.held = self.held_inside = 0

    def merged(self, text: str) -> list[str]:
        """Encoding of a short text by its definition: merge the best pair, leftmost first."""
        symbols, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def pieces(self, chunk: str) -> list[str]:
        """Tokens of a chunk; a character outside the vocabulary stands for itself."""
        last, done, known = list(chunk), -1, self.pairs
        for end, (piece, size) in self.tokens.iter(chunk):
            if end == done:
                continue
            start = end - size
            if start >= 0:
                fits = known.get((last[start], piece))
                if not (self.compatible(last[start], piece) if fits is None else fits):
                    continue
            last[end] = piece
            done = end
        out, end = [], len(chunk) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])
        out.reverse()
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        out = array("i")
        for piece in self.pieces(chunk):
            known = self.ids.get(piece)
            if known is None:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(known)
        return out.tobytes()

    def kept(self, word: str) -> bytes:
        """Ids of a mark and ``word``, remembered; half of the memory goes when it is full."""
        got = self.older.get(word)
        if got is None:
            chunk = MARK + word
            cuts = [i for i, pair in enumerate(zip(chunk, word), 1) if pair not in self.inner]
            if cuts and cuts[0] > 1:
                head = word[: cuts[0] - 1]
                got = self.recent.get(head) or self.kept(head)
                for a, b in zip(cuts, [*cuts[1:], len(chunk)]):
                    got += self.part(chunk[a:b])
            else:
                got = self.chunk_ids(chunk)
        if len(word) <= LONG:
            if self.held > MEMORY // 2:
                self.older, self.recent, self.held = self.recent, {}, 0
            self.recent[word] = got
            self.held += sys.getsizeof(word) + sys.getsizeof(got) + ENTRY
        return got

    def part(self, text: str) -> bytes:
        """Ids of what stands between two borders inside a word."""
        got = self.inside.get(text)
        if got is None:
            got = self.chunk_ids(text)
            if len(text) <= LONG and self.held_inside < MEMORY // 4:
                self.inside[text] = got
                self.held_inside += sys.getsizeof(text) + sys.getsizeof(got) + ENTRY
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin or end ids."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        if "" in words:  # a run of marks belongs to the word behind it
            words, gap = [], ""
            for word in text.replace(MARK, " ").split(" "):
                if word:
                    words.append(gap + word)
                    gap = ""
                else:
                    gap += MARK
            tail = self.chunk_ids(gap) if gap else b""
        else:
            tail = b""
        out = list(map(self.recent.get, words))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    out[i] = self.kept(words[i])
        return array("i", b"".join(out) + tail).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(4)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``(doc_id, ids, decoded)`` per row, or with ``digests`` their count and sha256.

    ``path`` names the model file on every executor.
    """

    @tidy
    def run(source):
        bpe = piece_bpe(path)
        for batch in parts(source, "text"):
            ids, decoded = [], []
            for text in batch.column("text").to_pylist():
                ids.append(bpe.encode(text or ""))
                decoded.append(bpe.decode(ids[-1]))
                if digests:
                    joined = ",".join(map(bpe.decimal.__getitem__, ids[-1]))
                    ids[-1] = (len(ids[-1]), hashlib.sha256(joined.encode()).hexdigest())
                    decoded[-1] = hashlib.sha256(decoded[-1].encode()).hexdigest()
            if digests:
                counts, shas = zip(*ids, strict=True)
                yield table(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())])
            else:
                yield table(["doc_id", "ids", "decoded"],
                            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {out}")
