"""Operator 2: token ids as bit- or byte-plane blocks with a chunk index.

Documents are dealt into ranges of ascending id, encoded there, and cut into blocks of a
fixed number of ids. A block's ids are transposed into planes (all first bits or bytes, then
all second ones, ...), planes that are zero throughout are left out and the others are
compressed with zstandard, each on its own. One row of the written table is one block: its place, its planes, and
an index of the pieces of documents it holds, so that any block can be read alone.

Texts of any length are encoded whole. Nulls are empty texts; such a document has only its end id. Equal ids stay next to each
other, ordered by a hash of their text; null ids come first. An empty table writes no block
and reads back empty. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urlsieve.llm.store import parts, shuffles_removed, table
from urlsieve.llm.text import cut_words, owners, spans, utf8

BLOCK = 1 << 16
CACHE = 800_000
LONG = 256
ONE_SPACE = np.zeros(256, bool)
ONE_SPACE[0x20] = True
#: white space of one byte, and first bytes of white space of several
BLANK = np.zeros(256, bool)
BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
LEAD = np.zeros(256, bool)
LEAD[list({c.encode()[0] for c in map(chr, range(0x80, 0x3001)) if c.isspace()})] = True
CLOSE = re.compile(r"\s\s|\s\Z")


class ByteBpe:
    """The tokenizers library behind a memory of words.

    Byte-level pre-tokenization always cuts before a space between two other characters, so
    the ids of ``" word"`` do not depend on what stands around it. The ids of all words that a
    worker remembers lie one after the other in one array.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.marks = [t.encode() for t in self.special]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.ids = np.empty(0, "<u4")
        self.heads: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def head(self, word: bytes) -> bytes:
        """Ids of a word that opens a text."""
        got = self.heads.get(word)
        if got is None:
            got = self.heads[word] = self.whole(word.decode())
        return got

    def sure(self, raw: bytes, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts without special tokens and without white space that the cuts do not account for:
        two in a row, one at the end, a space at the start."""
        out = offs[1:] > offs[:-1]
        blank = BLANK[data]
        twice = np.flatnonzero(blank[1:] & blank[:-1])
        owner = np.searchsorted(offs, twice, "right") - 1
        out[owner[twice + 1 < offs[owner + 1]]] = False
        some = np.flatnonzero(out)
        out[some] = (data[offs[some]] != 0x20) & ~blank[offs[some + 1] - 1]
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                out[np.searchsorted(offs, at, "right") - 1] = False
                at = raw.find(mark, at + 1)
        # white space of several bytes is rare: these texts are read as text
        lead = np.flatnonzero(LEAD[data])
        for k in np.unique(np.searchsorted(offs, lead, "right") - 1).tolist():
            if out[k] and CLOSE.search(raw[offs[k] : offs[k + 1]].decode()):
                out[k] = False
        return out

    def learn(self, words: list[str]) -> None:
        """Ids of all words, each behind a space, with one call of the library."""
        if not words:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.opens[ids])
        self.place |= zip(words, range(len(self.place), len(self.place) + len(words)), strict=True)
        self.ends = np.concatenate([self.ends, len(self.ids) + starts[1:], [len(self.ids) + len(ids)]])
        self.ids = np.concatenate([self.ids, ids])

    def known(self, words: list[str]) -> np.ndarray:
        """Places of the words in the memory; the library is asked for those that are new."""
        at = list(map(self.place.get, words))
        if None in at:
            self.learn([w for w, p in zip(words, at, strict=True) if p is None])
            at = list(map(self.place.get, words))
        return np.array(at, np.int64)

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of every text of an Arrow array."""
        if len(self.place) + len(self.heads) > CACHE:
            self.forget()
        data, offs = utf8(column)
        raw = data.tobytes()
        sure = self.sure(raw, data, offs)
        s, e, first = spans(data, offs, ONE_SPACE)
        inner = sure[owners(first)]
        inner[first[:-1][np.diff(first) > 0]] = False  # a text's first word has no space before it
        own = np.flatnonzero(inner)
        seen = cut_words(data, s[own], e[own]).dictionary_encode()
        at = self.known(seen.dictionary.to_numpy(zero_copy_only=False).tolist())[seen.indices.to_numpy(zero_copy_only=False)]
        sizes = self.ends[at + 1] - self.ends[at]
        after = np.cumsum(sizes)
        ids = self.ids[np.arange(int(sizes.sum())) + np.repeat(self.ends[at] - (after - sizes), sizes)].tobytes()
        cuts = 4 * np.concatenate([[0], after])[np.searchsorted(own, first)]
        out = []
        for k, plain in enumerate(sure.tolist()):
            if plain:
                word = first[k]
                out.append(self.head(raw[s[word] : e[word]]) + ids[cuts[k] : cuts[k + 1]])
            else:
                out.append(self.mixed(raw[offs[k] : offs[k + 1]].decode()))
        return out

    def mixed(self, text: str) -> bytes:
        """A text with special tokens goes to the library as it is, others in runs between sure cuts."""
        if len(text) < LONG or any(s in text for s in self.special):
            return self.whole(text)
        runs, run = [], []
        for word in text.split(" "):
            if run and word and not word[0].isspace() and run[-1] and not run[-1][-1].isspace():
                runs.append(run)
                run = [word]
            else:
                run.append(word)
        runs.append(run)
        alone = list({r[0] for r in runs[1:] if len(r) == 1 and not r[0][-1].isspace()})
        place = dict(zip(alone, self.known(alone).tolist(), strict=True))
        out = [self.whole(" ".join(runs[0]))]
        for r in runs[1:]:
            at = place.get(r[0]) if len(r) == 1 else None
            out.append(self.whole(" " + " ".join(r)) if at is None else self.ids[self.ends[at] : self.ends[at + 1]].tobytes())
        return b"".join(out)


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def to_planes(ids: np.ndarray, bits: bool, level: int) -> tuple[list[int], list[bytes]]:
    """Numbers of the planes that are not zero, and each one compressed."""
    raw = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    press = zstandard.ZstdCompressor(level=level)
    numbers, planes = [], []
    for k in range(4):
        byte = np.ascontiguousarray(raw[:, k])
        if not byte.any():
            continue
        if not bits:
            numbers.append(k)
            planes.append(press.compress(byte.tobytes()))
            continue
        for j in range(8):
            bit = (byte >> j) & 1
            if bit.any():
                numbers.append(8 * k + j)
                planes.append(press.compress(np.packbits(bit).tobytes()))
    return numbers, planes


def from_planes(n: int, bits: bool, numbers: list[int], planes: list[bytes]) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in zip(numbers, planes, strict=True):
        got = np.frombuffer(open_.decompress(plane), np.uint8)
        if bits:
            raw[:, k // 8] |= np.unpackbits(got, count=n) << np.uint8(k % 8)
        else:
            raw[:, k] = got
    return raw.reshape(-1).view("<u4")


FILE = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("bits", pa.bool_()),
    ("plane", pa.list_(pa.int32())), ("data", pa.list_(pa.binary())),
    ("doc", pa.list_(pa.int64())), ("seq", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())),
])
FILE_DDL = (
    "part int, block int, first long, n int, bits boolean, plane array<int>, data array<binary>, "
    "doc array<long>, seq array<long>, size array<long>"
)


def write_planes(
    docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, bits: bool = False, block: int = BLOCK, level: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every document, append ``end_id`` and write the blocks to folder ``out``."""

    def run(source):
        bpe, part = byte_bpe(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        waiting, pieces, held, number, first, seq = [], [], 0, 0, 0, 0

        def blocks(last: bool):
            nonlocal waiting, pieces, held, number, first
            ids = np.frombuffer(b"".join(waiting), "<u4")
            at = 0
            while len(ids) - at >= block or last and at < len(ids):
                now = ids[at : at + block]
                inside, room = [], len(now)
                while room:
                    doc, s, size = pieces[0]
                    fits = min(size, room)
                    inside.append((doc, s, fits))
                    room -= fits
                    if fits == size:
                        pieces.pop(0)
                    else:
                        pieces[0] = (doc, s, size - fits)
                numbers, planes = to_planes(now, bits, level)
                docs_, seqs, sizes = map(list, zip(*inside, strict=True))
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "block": number, "first": first, "n": len(now), "bits": bits, "plane": numbers,
                    "data": planes, "doc": docs_, "seq": seqs, "size": sizes,
                }], FILE)
                number, first, at = number + 1, first + len(now), at + len(now)
            waiting, held = [ids[at:].tobytes()], len(ids) - at

        for batch in parts(source, "text"):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), bpe.encode(batch.column("text")), strict=True):
                waiting += [raw, end]
                pieces.append((doc, seq, len(raw) // 4 + 1))
                held, seq = held + len(raw) // 4 + 1, seq + 1
            if held >= block:
                yield from blocks(False)
        if held:
            yield from blocks(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.xxhash64("text")
    ranged = rows.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key)
    with shuffles_removed(docs.sparkSession):
        ranged.mapInArrow(run, FILE_DDL).write.parquet(out)


POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if b >> k & 1:
            out ^= a
        a = a >> 1 ^ (POLY if a & 1 else 0)
    return out


@lru_cache(65536)
def _shift(n: int) -> int:
    """x to the power 8n."""
    out, power = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, power)
        power, n = _times(power, power), n >> 1
    return out


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings in a row from the crc32 of each."""
    return _times(first, _shift(second_bytes)) ^ second


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """``(part, block, first, n, ids)`` of every block, decoded."""

    def run(source):
        for batch in source:
            for row in batch.to_pylist():
                ids = from_planes(row["n"], row["bits"], row["plane"], row["data"])
                yield table(["part", "block", "first", "n", "ids"], [
                    pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([row["first"]], pa.int64()),
                    pa.array([row["n"]], pa.int32()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())),
                ])

    blocks = spark.read.schema(FILE_DDL).parquet(path)
    return blocks.select("part", "block", "first", "n", "bits", "plane", "data").mapInArrow(run, "part int, block int, first long, n int, ids array<int>")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files."""

    def pieces(source):
        for batch in source:
            for row in batch.to_pylist():
                raw = from_planes(row["n"], row["bits"], row["plane"], row["data"]).tobytes()
                ends = np.cumsum([0, *row["size"]])
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                k = len(crcs)
                yield table(["doc_id", "part", "seq", "at", "n", "crc"], [
                    pa.array(row["doc"], pa.int64()), pa.array([row["part"]] * k, pa.int32()), pa.array(row["seq"], pa.int64()),
                    pa.array(row["first"] + ends[:-1], pa.int64()), pa.array(row["size"], pa.int64()), pa.array(crcs, pa.int64()),
                ])

    def joined(source):
        for batch in source:
            out = []
            for pieces_ in batch.column("pieces").to_pylist():
                crc = pieces_[0]["crc"]
                for piece in pieces_[1:]:
                    crc = crc_join(crc, piece["crc"], 4 * piece["n"])
                out.append(crc)
            rest = batch.select(["doc_id", "part", "start", "n_tokens"])
            yield table([*rest.schema.names, "ids_crc32"], [*rest.columns, pa.array(out, pa.int64())])

    blocks = spark.read.schema(FILE_DDL).parquet(path)
    found = blocks.mapInArrow(pieces, "doc_id long, part int, seq long, at long, n long, crc long")
    per_doc = (
        found.groupBy("part", "seq", "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
        .select("doc_id", "part", F.expr("pieces[0].at").alias("start"), F.expr("aggregate(pieces, 0L, (s, x) -> s + x.n)").alias("n_tokens"), "pieces")
        .mapInArrow(joined, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    )
    # one row per written range
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return per_doc.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
