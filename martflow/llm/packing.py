"""Shortest-pack-first packing over the length histogram.

Texts become token ids with a closing id and are cut into pieces of at most
``size``.  Full pieces are sequences of their own.  The lengths of the others are
a histogram of fewer than ``size`` bins, however many texts there are, and only it
goes to the driver.  Lengths are placed longest first, each into the shortest
pack that has been begun; packs of equal content are one pattern with a count, so
the work depends on the bins and not on the texts.  A pattern's places give, for
every length, ranges of ranks: pieces are numbered within their length, spread
over hash buckets, and find their sequence by rank in a table of fixed size.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from martflow.llm.common import Layers, gapless

SIZE = 2048
CLOSING = 1
CACHE = 1_000_000  # words a Python worker keeps with their ids
LONGEST_CACHED = 40
CHUNK_BYTES = 8 << 20  # text encoded at a time
# Latin letters with one lower-case form each.
LETTERS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
MARKS = string.punctuation

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of a tokenizer file whose pre-tokenizer never crosses white space.

    A text's ids are then those of its white-space separated words in turn, and
    words recur: a chunk of texts becomes numbers of distinct words, and the ids of
    about ``CACHE`` words are kept, packed.  A word of Latin letters and closing
    marks has the ids of its letters and of its marks, which are looked up apart;
    letters need neither normaliser nor patterns and go straight to the model.  Control characters that Arrow
    alone takes for white space go the plain way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = {c.lower() for c in map(chr, range(128, 0x250)) if LETTERS.fullmatch(c)}
        self.bytewise = {ord(c): in_bytes(c)[0][0] for c in letters}
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _stem(self, stem: str) -> bytes:
        """Ids of a lower-case word of letters."""
        ids = [t.id for t in self.model.tokenize(stem if stem.isascii() else stem.translate(self.bytewise))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words."""
        if len(self.marks) > CACHE:
            self.marks = {"": b""}
        stems: dict[str, bytes] = {}
        out, odd = {}, []
        for w in words:
            letters = w.rstrip(MARKS)
            if not (letters.isalpha() if letters.isascii() else LETTERS.fullmatch(letters)):
                odd.append(w)
                continue
            stem, marks = letters.lower(), w[len(letters):]
            if (ids := stems.get(stem)) is None:
                ids = stems[stem] = self._stem(stem)
            if marks not in self.marks:
                self.marks[marks] = self.plain([marks])[0]
            out[w] = ids + self.marks[marks] if marks else ids
        out.update(zip(odd, self.plain(odd)))
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        new = self._learn([w for w in words if w not in self.known])
        self.known.update(new)
        ids = [self.known[w] for w in words]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del self.known[w]
        return ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, r"[\x1c-\x1f]").to_numpy(zero_copy_only=False))
        words = pc.utf8_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        which = coded.indices.to_numpy()
        n = lengths[which]
        ends = np.cumsum(n)
        shift = (np.cumsum(lengths) - lengths)[which] - (ends - n)
        of_all = flat[np.repeat(shift, n) + np.arange(len(n) and ends[-1])]
        edges = np.concatenate(([0], ends))[np.cumsum([0, *words.value_lengths().to_numpy()])]
        out = [of_all[i:j] for i, j in zip(edges, edges[1:])]
        for i in odd:
            out[i] = np.frombuffer(self.plain([texts[int(i)].as_py()])[0], "<u4")
        return out


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``size`` bytes, with the row each begins at."""
    run = np.cumsum(pc.binary_length(texts).to_numpy()) // size
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for i, j in zip(edges, edges[1:]):
        if i < j:
            yield i, texts.slice(i, j - i)


def pieces_of(ids: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    total = len(ids)
    return [(at, min(size, total - at), zlib.crc32(ids[at:at + size]), total) for at in range(0, total, size)]


_encoders: dict[str, Encoder] = {}


def cut(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    names = [c.split()[0] for c in PIECE.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        closing = np.asarray([CLOSING], "<u4")
        for batch in batches:
            for first, texts in chunks(batch.column(1).fill_null("")):
                found = [pieces_of(np.concatenate((ids, closing)), size) for ids in encoder.encode(texts)]
                row = np.repeat(np.arange(first, first + len(found)), [len(p) for p in found])
                cols = np.asarray([p for some in found for p in some], np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), *[pa.array(c) for c in cols]], ["doc_id", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(pieces, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE}")


# --- patterns ------------------------------------------------------------------


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how many packs have it) for a histogram of lengths up to ``size``."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # used -> [lengths, count]
    used_sizes: list[int] = []
    done: dict[tuple[int, ...], int] = defaultdict(int)

    def put(used: int, lengths: tuple[int, ...], count: int) -> None:
        if used == size:
            done[lengths] += count
            return
        if not open_packs[used]:
            insort(used_sizes, used)
        open_packs[used].append([lengths, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not used_sizes or used_sizes[0] + length > size:
                put(length, (length,), left)
                break
            used = used_sizes[0]
            lengths, count = open_packs[used].pop()
            if not open_packs[used]:
                used_sizes.pop(bisect_left(used_sizes, used))
            taken = min(count, left)
            if taken < count:
                put(used, lengths, count - taken)
            put(used + length, (*lengths, length), taken)
            left -= taken
    for used in used_sizes:
        for lengths, count in open_packs[used]:
            done[lengths] += count
    return sorted(done.items(), reverse=True)


def places_of(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Ranges of ranks: (length, rank, sequence, offset), each up to the next rank of the length."""
    rows, ranks, base = [], defaultdict(int), 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, ranks[length], base, offset))
            ranks[length] += count
            offset += length
        base += count
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"], dtype="int64").sort_values(
        ["length", "rank"], ignore_index=True)


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null and empty texts are one piece, the closing id.  Rows that repeat an id,
    with the same or another text, have pieces of their own; other columns are not
    read.  An empty table has no pieces.
    """
    layers = Layers(docs.sparkSession, "packing")
    pieces = layers.write(cut(docs, tokenizer, doc_id, text, size))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places_of(pack_histogram(histogram, size))
    lengths = table["length"].to_numpy()
    # One sorted key per range: lengths stay below 2^20, ranks below 2^43.
    keys = (lengths << 43) | table["rank"].to_numpy()
    sequence, offset = table["sequence"].to_numpy(), table["offset"].to_numpy()
    start = table["rank"].to_numpy()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(keys, (length << 43) | rank, side="right") - 1
            cols = [c for n, c in zip(b.schema.names, b.columns) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(sequence[at] + rank - start[at]), pa.array(offset[at])],
                [*[n for n in b.schema.names if n != "rank"], "sequence_id", "offset"])

    ranked = gapless(pieces, ["length"], "rank")
    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(find, f"doc_id {kind}, {PIECE}, sequence_id long, offset long")
