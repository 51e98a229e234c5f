"""Token-id output: seekable files of independent zstandard frames, one per document, and readers for them."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import handed_in_batches, shared_uri, stored
from logweave.llm.words import slices, text_bytes

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
# A file is closed at this size; the index of its documents is its last frame before the seek table.
FILE_BYTES = 32 << 20
FILE_DOCS = 1 << 18
# What a worker remembers at most: words with their ids, and bytes of such words. Bytes of text encoded at once, words encoded
# in a row, and rows that are handed to a worker at once.
REMEMBERED = 600_000
REMEMBERED_BYTES = 16 << 20
ENCODE_BYTES = 1 << 21
TOGETHER = 64
HANDED = 500

# Kinds of bytes: 0 unknown or white space, 1 letter, 2 digit, 3 other ASCII signs, 4 apostrophe.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 4
# Second bytes after 0xC3 that make a letter.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where a byte-level tokenizer always starts a new piece, whatever stands around: a blank between two
    characters that are no white space, both sides of such a line feed, and changes between letters, digits and signs
    other than the apostrophe. Only ASCII and letters led by 0xC3 count as known characters."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    begin, end = _KIND[data], _KIND[data]
    latin = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    begin[:-1][latin] = 1
    end[1:][latin] = 1
    left, right = end[:-1], begin[1:]
    cut[1:] = (left != right) & (left > 0) & (right > 0) & (left < 4) & (right < 4)
    lone = (left[:-1] > 0) & (right[1:] > 0)
    cut[1:-1] |= lone & (data[1:-1] == 32)
    line = lone & (data[1:-1] == 10)
    cut[1:-1] |= line
    cut[2:] |= line
    return cut


def _in_a_row(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the words between the borders ``at`` keep their borders when put in a row: those that begin with a blank
    before a known character and end in ASCII."""
    first, last = at[:-1], at[1:] - 1
    second = np.minimum(first + 1, last)
    known = (_KIND[data[second]] > 0) | ((data[second] == 0xC3) & _LATIN[data[np.minimum(first + 2, last)]])
    return (data[first] == 32) & known & (_KIND[data[last]] > 0)


class SeekableWriter:
    """Writes frames to a binary stream; ``close`` adds the document index and the seek table."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.sizes: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.bytes = 0

    def _frame(self, content: bytes) -> None:
        frame = self.packer.compress(content)
        self.out.write(frame)
        self.sizes.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.bytes += len(frame)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self._frame(ids.astype(f"<u{self.width}").tobytes())

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], np.uint8)
        values = np.array([i or 0 for i in self.ids], "<i8")
        self._frame(bytes([self.width]) + known.tobytes() + values.tobytes())
        table = b"".join(struct.pack("<III", *x) for x in self.sizes)
        table += struct.pack("<IBI", len(self.sizes), WITH_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class SeekableReader:
    """Reads documents of a file by place; only the seek table, the index and the frames asked for are read."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        head = struct.unpack("<II", self._at(end - 9 - 12 * count - 8, 8))
        if head != (SKIPPABLE_MAGIC, 12 * count + 9):
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(self._at(end - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self._frame(count - 1)
        n = count - 1
        self.width, known = index[0], np.frombuffer(index, np.uint8, n, 1)
        values = np.frombuffer(index, "<i8", n, 1 + n)
        self.ids = [int(v) if k else None for v, k in zip(values, known, strict=True)]

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def _frame(self, k: int) -> bytes:
        packed, size, check = self.table[k]
        frame = self._at(int(self.begin[k]), int(packed))
        content = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(size))
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, k: int) -> np.ndarray:
        """Token ids of the k-th document as unsigned 32-bit numbers."""
        return np.frombuffer(self._frame(k), f"<u{self.width}").astype("<u4")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of whole texts by a byte-level BPE tokenizer, each distinct word encoded once.

    Pieces of such a tokenizer do not influence each other, so a text may be cut where a piece starts whatever stands
    around (:func:`cuts`) and its ids are those of the cuts in a row. Texts with the string of an added token are
    encoded whole. What is remembered is bounded in words and bytes; when it is full, the words met most often stay.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # A byte-level token is written with one character per byte.
        self.size = np.zeros(self.vocabulary, np.int64)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.size[number] = len(token)
        # Of the known words in turn: the words, all ids in a row, where each word's end (and the first one begins), times met.
        self.known = pa.array([], pa.large_binary())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)
        # Hashes of the known words in ascending order, and the place of each among the known words.
        self.hashes, self.placed = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the known words ``place`` in a row, and where each word's end (and the first one begins)."""
        start = self.ends[place]
        size = self.ends[place + 1] - start
        done = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(start - done[:-1], size)
        source += np.arange(done[-1])
        return self.flat[source], done

    def _forget(self) -> None:
        """Keep the words met most often, up to half of what may be remembered; older meetings count half from then on."""
        size = pc.binary_length(self.known).to_numpy()
        stay = np.argsort(-self.met, kind="stable")[: REMEMBERED // 2]
        stay = np.sort(stay[np.cumsum(size[stay]) <= REMEMBERED_BYTES // 2])
        number = np.full(len(self.known), -1)
        number[stay] = np.arange(len(stay))
        placed = number[self.placed]
        self.hashes, self.placed = self.hashes[placed >= 0], placed[placed >= 0]
        self.known, self.met = self.known.take(pa.array(stay)), self.met[stay] // 2
        self.flat, self.ends = self._gather(stay)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the known ones, -1 where it is not known. Words of equal hash are told apart."""
        if not len(self.known):
            return np.full(len(words), -1)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = self.placed[near]
        same = np.flatnonzero(self.hashes[near] == hashes)
        equal = pc.equal(words.take(pa.array(same)), self.known.take(pa.array(place[same])))
        found = np.full(len(words), -1)
        same = same[equal.to_numpy(zero_copy_only=False)]
        found[same] = place[same]
        return found

    def _places(self, words: pa.Array) -> np.ndarray:
        """Number of each word among the known ones; unknown ones are encoded. ``words`` are distinct."""
        hashes = np.fromiter(map(hash, words.to_numpy(zero_copy_only=False)), np.int64, len(words))
        place = self._find(words, hashes)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place
        # The byte lengths of the ids tell which are whose when words stand in a row.
        together = _in_a_row(*text_bytes(words))[new]
        new, rows = np.concatenate([new[together], new[~together]]), int(together.sum())
        added = words.take(pa.array(new))
        data, at = text_bytes(added)
        raw = data.tobytes()
        borders = at[[*range(0, rows, TOGETHER), *range(rows, len(new) + 1)]].tolist()
        texts = [raw[i:j].decode() for i, j in pairwise(borders)]
        ids = [i for k in range(0, len(texts), 256) for i in self._encode(texts[k : k + 256])]
        ids = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
        stop = np.searchsorted(np.cumsum(self.size[ids]), at[1:]) + 1
        place[new] = np.arange(len(self.known), len(self.known) + len(new))
        self.known = pa.concat_arrays([self.known, added])
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + stop])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        new = new[np.argsort(hashes[new])]
        to = np.searchsorted(self.hashes, hashes[new])
        self.hashes, self.placed = np.insert(self.hashes, to, hashes[new]), np.insert(self.placed, to, place[new])
        return place

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn; nulls are empty texts. A text that repeats the one before it is not encoded again."""
        runs = pc.run_end_encode(column.cast(pa.string()))
        ends = np.asarray(runs.run_ends).astype(np.int64)
        for ids, n in zip(self._distinct(runs.values), np.diff(ends, prepend=0).tolist(), strict=True):
            for _ in range(n):
                yield ids

    def _distinct(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = text_bytes(column)
        for i, j in slices(offsets, ENCODE_BYTES):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            whole = {}
            raw = part.tobytes()
            for token in self.added:
                place = raw.find(token)
                while place >= 0:
                    k = int(np.searchsorted(at, place, "right")) - 1
                    whole[k] = None
                    place = raw.find(token, place + 1)
            for k in whole:
                text = raw[at[k] : at[k + 1]]
                whole[k] = np.array(self._encode([text.decode()])[0], np.uint32)
            yield from self._slice(part, at, whole)

    def _slice(self, part: np.ndarray, at: np.ndarray, whole: dict[int, np.ndarray]) -> Iterator[np.ndarray]:
        cut = cuts(part)
        cut[at[:-1][at[:-1] < len(part)]] = True
        begin = np.flatnonzero(cut)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(part)).astype(np.int64)), pa.py_buffer(part)]
        ).dictionary_encode()
        place, which = self._places(words.dictionary), np.asarray(words.indices)
        self.met[place] += np.bincount(which, minlength=len(place))
        ids, done = self._gather(place[which])
        if len(self.known) > REMEMBERED or pc.sum(pc.binary_length(self.known), min_count=0).as_py() > REMEMBERED_BYTES:
            self._forget()
        first = done[np.searchsorted(begin, at)]
        for k in range(len(at) - 1):
            yield whole[k] if k in whole else ids[first[k] : first[k + 1]]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of a worker, with the words that it met in earlier tasks."""
    return Encoder(path)


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write the ids in ascending id order; returns the manifest.

    The manifest has a row per file (file, part, piece, n_docs, n_tokens), in order of part and piece. Each task streams its
    sorted documents into files of bounded size. A file is written under another name and renamed, and its content
    depends on the data only, so a repeated task does no harm. ``folder`` is a URI that pyarrow.fs opens on every
    executor. Null ids come first, null texts are empty; rows with equal ids stand in the order of their texts'
    hashes, so many of them still spread over files, and equal texts of one id are encoded once. Ids are cast to
    long: an id that is no whole number becomes null, or stops the job in ANSI mode.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        end = np.array([end_id], np.uint32)
        out, made, n_tokens = None, [], 0

        def close() -> None:
            name = f"{root}/ids-{part:06d}-{len(made):06d}.zst"
            writer.close()
            out.close()
            store.move(f"{name}.{attempt}", name)
            made.append((name.removeprefix(f"{root}/"), part, len(made), len(writer.ids), n_tokens))

        for batch in batches:
            for doc, ids in zip(batch["id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/ids-{part:06d}-{len(made):06d}.zst.{attempt}", compression=None)
                    writer, n_tokens = SeekableWriter(out, width), 0
                writer.add(doc, np.concatenate([ids, end]))
                n_tokens += len(ids) + 1
                if writer.bytes >= FILE_BYTES or len(writer.ids) >= FILE_DOCS:
                    close()
                    out = None
        if out is not None:
            close()
        names = ["file", "part", "piece", "n_docs", "n_tokens"]
        columns = list(zip(*made, strict=True)) or [[]] * len(names)
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    with handed_in_batches(docs.sparkSession, HANDED):
        return stored(rows.mapInArrow(run, "file string, part long, piece long, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, read back from the files; start counts all ids before it.

    Files are opened where they are read and one frame is unpacked at a time.
    """
    # One row per file: the running sum over files is small work.
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    reader = SeekableReader(file)
                    for low in range(0, len(reader), 4096):
                        ids, starts, sizes, checks = [], [], [], []
                        for k in range(low, min(low + 4096, len(reader))):
                            tokens = reader.document(k)
                            ids.append(reader.ids[k])
                            starts.append(base)
                            sizes.append(len(tokens))
                            checks.append(zlib.crc32(tokens.tobytes()))
                            base += len(tokens)
                        columns = [pa.array(c, pa.int64()) for c in (ids, starts, sizes, checks)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = placed.repartition(max(1, placed.count()), "file").select("file", "base")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` (doc_id, text) below the shared folder and read them back.

    One row per row of ``docs``; an empty table writes no file and gives no rows; other columns are not read.
    """
    folder = folder or shared_uri(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id), folder)
