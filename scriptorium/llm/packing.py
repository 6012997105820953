"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

1. Tokenise (map-only): a document's ids, then the end id; longer ones are cut into full pieces plus a rest.
   Ids are kept per blank- or newline-separated chunk in a bounded cache, so a frequent word is encoded once.
2. The pieces' lengths (no ids, no texts) are stored, and dealt by a hash of their key into shards of a bounded
   number of pieces. A shard's size is a parameter, so no task grows with the corpus; each shard leaves one partly
   filled sequence or so, under a thousandth of the total.
3. Within a shard, longest first, each piece goes to the tightest open bin that holds it. A segment tree over the
   remaining capacities (0..capacity) finds that bin in log2(capacity) steps.

Null text: only the end id. Empty tables: no rows. Repeated rows: packed as often as they occur.
Pieces of equal length go by doc_id and number, null ids last; extra columns are ignored.
"""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_text, stash

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces in one packing shard, about; bounds a packing task's rows.
SHARD_PIECES = 20_000
#: Distinct chunks whose ids a task keeps; beyond it the cache starts anew, which changes no result.
CACHE_CHUNKS = 400_000
#: A chunk longer than this is encoded but not kept.
CACHED_CHARS = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII punctuation but the apostrophe, which starts contractions: a run of these after letters is a token group of its own.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class ChunkEncoder(dict):
    """Chunk -> ids as little-endian uint32 bytes; a bounded cache that encodes what it lacks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its blank- or
    newline-separated chunks, one after the other. Letters below U+0180, where lower-casing is one to one and
    nothing composes, go straight to the tokenizer's merges, a run of punctuation after them apart; all other
    chunks, and texts that hold a special token's string, take the tokenizer's own way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode("utf-8")])
            found = array.array("I", [t.id for t in self.merges.tokenize(mapped)]).tobytes()
            if len(self.words) >= CACHE_CHUNKS:
                self.words.clear()
            self.words[word] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        base = chunk.rstrip(PUNCTUATION)
        if base.isalpha() and max(base) < "\u0180" and "\u0130" not in base:
            found = self._word(base.lower())
            if len(base) < len(chunk):
                found += self[chunk[len(base) :]]
        else:
            found = self.plain(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = found
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        get = self.__getitem__
        for t in texts:
            yield self.plain(t) if "<|" in t and any(s in t for s in self.special) else b"".join(map(get, t.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; map-only."""
    path = path or tokenizer_path()
    end = array.array("I", [end_id]).tobytes()

    def rows(texts: list[str | None]) -> tuple[list[int], list]:
        source, out = [], []
        for k, ids in enumerate(encoder(path).encode([t or "" for t in texts])):
            ids += end
            for i, s in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[s : s + 4 * capacity]
                source.append(k)
                out.append((i, s // 4, len(part) // 4, zlib.crc32(part)))
        return source, list(zip(*out, strict=True))

    return by_text(docs, rows, "piece int, start long, length long, ids_crc32 long", PIECES)


class Capacities:
    """Segment tree over remaining capacities 0..capacity: how many open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) of the tightest open bin with room for `need`."""
        at, count = need + self.size, self.count
        while not count[at]:
            while at & 1:  # a right child: nothing to the right below this parent
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; the pieces come longest first."""
    open_, bins, offsets, made = Capacities(capacity), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        room, b = open_.take(n) or (capacity, None)
        if b is None:
            b, made = made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            open_.add(room - n, b)
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    parts = stash(pieces(docs, capacity, end_id, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-parts.count() // shard_pieces))

    def place(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        bins, offsets = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        sequence = table.column("shard").to_numpy() * (1 << 32) + bins
        return table.drop_columns(["shard", "row"]).append_column("offset", pa.array(offsets)).append_column("sequence_id", pa.array(sequence))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name != "row")
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))  # numbers that are stored: even, whatever ids repeat
    return dealt.groupBy("shard").applyInArrow(place, f"{fields}, offset long, sequence_id long")
