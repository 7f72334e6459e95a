"""Packing token sequences by minimum bin slack.

A document's ids are cut at full windows; what remains goes to a pool of remainders by length.
For each window the longest remainder is set, and subset sums of the others, kept as the bits of
an integer, find the multiset that comes closest to the capacity; walking back through the
sums gives the counts. A partition packs its own documents, block by block, so that tokens
never move between executors and memory is bounded by a block and its longest document.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

CAPACITY, END_ID = 4096, 2
#: Ids a pool may hold before it is packed, and down to which it is then packed.
POOL_HIGH, POOL_LOW = 1 << 20, 1 << 18
#: Words, and pieces of words, whose ids a Python worker remembers, and how many bytes they may have; at the limit it forgets all.
WORDS, LONGEST = 700_000, 48


# The tokenizer's own rule for cutting text, and characters for which lower() and \\p{L} mean the same everywhere.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[!-~\u00a1-\u00ff]*")


def _bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def piece_encoder(path: str) -> Callable[[str], bytes]:
    """Encoder of single pieces by the merges of a byte-level tokenizer file with word ends, many times faster than the tokenizer.

    Parts are merged in the order of the ranks of their joined bytes. A word's end is a byte that
    UTF-8 does not have, and joins the last byte before all else. That equals merging the listed
    pairs in order: a stretch of bytes whose ends were never merged across has gone through the
    same merges as by itself, so two parts that join to a token are the pair it was learned from.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    end = model["end_of_word_suffix"]

    def raw(token: str) -> bytes:
        body = token.removesuffix(end) if token != end else token
        return bytes(byte_of[c] for c in body) + (b"\xff" if body != token else b"")

    order = [c for c in byte_of] + [c + end for c in byte_of] + [m if isinstance(m, str) else "".join(m) for m in (m.replace(" ", "") if isinstance(m, str) else m for m in model["merges"])]
    ranks: dict[bytes, int] = {}
    ids: list[int] = []
    for token in order:
        if raw(token) not in ranks:
            ranks[raw(token)] = len(ranks)
            ids.append(model["vocab"][token])
    join = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    packed = [_bytes([i]) for i in ids]
    return lambda piece: b"".join([packed[r] for r in join(piece.encode() + b"\xff")])


@cache
def word_encoder(path: str) -> Callable[[str], bytes]:
    """text -> ids, little-endian unsigned 32-bit, of a tokenizer that drops white space and case.

    Such a tokenizer cuts at ASCII white space before anything else, so a text's ids are those
    of its words in turn. A word of plain characters is cut further by the tokenizer's own rule
    once it is in lower case, see piece_encoder(); words of other characters are left to the
    tokenizer. Words and pieces are remembered.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer, words_known, pieces_known = Tokenizer.from_file(path), {}, {}
    cut, plain, of_piece = regex.compile(PIECES).findall, PLAIN.fullmatch, piece_encoder(path)

    def learn(words: Iterable[bytes]) -> dict[bytes, bytes]:
        if len(pieces_known) > WORDS:
            pieces_known.clear()
        other, found = [], {}
        for w in words:
            s = w.decode()
            if not plain(s) or "<|" in s:
                other.append(w)
                continue
            s = s.lower()
            if s.isalpha():
                pieces = (s,)
            elif s[-1] in ".,!" and s[:-1].isalpha():
                pieces = s[:-1], s[-1]
            else:
                pieces = cut(s)
            ids = []
            for p in pieces:
                if (known := pieces_known.get(p)) is None:
                    known = of_piece(p)
                    if len(p) <= LONGEST:
                        pieces_known[p] = known
                ids.append(known)
            found[w] = b"".join(ids)
        encoded = tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False) if other else []
        found.update((w, _bytes(e.ids)) for w, e in zip(other, encoded))
        words_known.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST)
        return found

    def encode(text: str) -> bytes:
        words = text.encode().split()
        if missing := set(words).difference(words_known):
            if len(words_known) > WORDS:
                words_known.clear()
                missing = set(words)
            new = learn(missing)
            return b"".join([words_known[w] if w in words_known else new[w] for w in words])  # a word may have no ids at all
        return b"".join(map(words_known.__getitem__, words))

    return encode


def fill(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts by length, out of lengths (length -> how many there are), whose sum is closest to capacity without passing it.

    Subset sums are bits of an integer. Counts are split into powers of two, and the search ends
    once the capacity itself is reached.
    """
    sums, steps, mask = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted((x for x in lengths if x <= capacity), reverse=True):
        left, part = min(lengths[length], capacity // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, sums))
            sums |= (sums << (length * part)) & mask
            left, part = left - part, part * 2
        if sums >> capacity:
            break
    best, used = sums.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            best -= length * part
            used[length] = used.get(length, 0) + part
    return used


class Packer:
    """Packs (key, ids) one after another; pieces() has what is decided so far."""

    def __init__(self, capacity: int = CAPACITY, first: int = 0):
        self.capacity, self.sequence, self.out = capacity, first, []
        self.pool: dict[int, list[tuple]] = {}
        self.held = 0

    def _put(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def _keep(self, item: tuple) -> None:
        n = len(item[2]) // 4
        self.pool.setdefault(n, []).append(item)
        self.held += n

    def _take(self, length: int) -> tuple:
        item = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= length
        return item

    def add(self, key: object, ids: bytes) -> None:
        total, step, at = len(ids) // 4, 4 * self.capacity, 0
        while len(ids) - at >= step:
            self._put([(key, at // 4, ids[at : at + step], total)])
            at += step
        if at < len(ids):
            self._keep((key, at // 4, ids[at:], total))
        if self.held > POOL_HIGH:
            while self.held > POOL_LOW:
                self._window(self.capacity)

    def _window(self, capacity: int) -> None:
        """Closes one window of `capacity` ids, of which the pool has at least as many; slack that no choice avoids is filled by a cut."""
        fitting = [x for x in self.pool if x <= capacity]
        pieces = [self._take(max(fitting))] if fitting else []
        room = capacity - sum(len(p[2]) // 4 for p in pieces)
        for length, count in fill({k: len(v) for k, v in self.pool.items()}, room).items() if room else ():
            pieces += [self._take(length) for _ in range(count)]
            room -= length * count
        if room:
            key, start, ids, total = self._take(max(self.pool))
            pieces.append((key, start, ids[: 4 * room], total))
            self._keep((key, start + room, ids[4 * room :], total))
        self._put(pieces)

    def finish(self) -> None:
        """Packs the pool: full windows, then one sequence for each power of two in what is left."""
        while self.held >= self.capacity:
            self._window(self.capacity)
        while self.held:
            self._window(1 << self.held.bit_length() - 1)

    def pieces(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then end_id, so that a null or empty text is one id. capacity must be
    a power of two. All sequences are full or have a power of two of ids, so that none is padded.
    Repeated rows are packed each for itself, null ids stay null. No rows give no pieces. The
    result depends on the rows of each partition and their order.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, key_type = word_encoder(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 36), None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.pieces())) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, key_type if i == 0 else pa.int64()) for i, c in enumerate(columns)], names)

        for b in batches:
            key_type = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(key, encode(text.as_py()) + end)
            yield rows()
        if key_type is not None:
            packer.finish()
            yield rows()

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))
