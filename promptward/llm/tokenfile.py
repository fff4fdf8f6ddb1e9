"""Token ids of a corpus in seekable binary files.

A file is a row of independent zstandard frames, one per document, each holding
the document's ids as little-endian unsigned 32-bit integers; a skippable frame with the document ids;
and the public zstandard seek table as the last, skippable, frame.  The seek table
has the compressed and decompressed size and a checksum of every frame, so a reader
finds any document from the end of the file and decompresses only that document,
while a plain zstandard reader still reads all ids in order.

Documents are dealt to tasks by ranges of their id.  A task writes its files under
names of its own attempt; only the names that a successful task returns enter the
manifest, so a repeated or speculative attempt leaves no trace but an unread file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptward.llm.common import new_folder, text_or_empty
from promptward.llm.pieces import LONGEST, _Remembered

#: Fixed values of the zstandard frame formats.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: A file is closed when its frames reach this size.
FILE_BYTES = 256 << 20
LEVEL = 1
#: Bytes of text that are encoded together, about.
TOGETHER = 8 << 20
#: ASCII punctuation that a tokenizer for words never joins with a letter.
EDGE = b".,!?;:%*&$#"

#: Bytes by what they are to the tokenizer: white space, letter, digit, other printing ASCII, and those that only it can
#: judge.  ``LATIN`` begins the characters U+00C0 to U+00FF, letters but for two, whose capitals end in a byte 32 lower.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
LATIN, NO_LETTERS, LAST_CAPITAL = 0xC3, (0x97, 0xB7), 0x9E
_KIND = np.full(256, ODD, dtype=np.uint8)
_KIND[33:127] = OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[LATIN] = LETTER
_KIND[ord("'")] = ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

MANIFEST = (
    "part INT, piece INT, path STRING, documents BIGINT, ids BIGINT, bytes BIGINT"
)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Writes one file; ``close`` adds the document ids and the seek table."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = files.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.bytes = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)
        self.bytes += len(frame)
        self.ids += len(ids) // 4

    def close(self) -> None:
        missing = bytes(i is None for i in self.doc_ids)
        numbers = np.array([i or 0 for i in self.doc_ids], dtype="<i8").tobytes()
        names = struct.pack("<Q", len(missing)) + numbers + missing
        self.out.write(struct.pack("<II", SKIPPABLE, len(names)) + names)
        table = np.array([*self.entries, (len(names) + 8, 0, 0)], dtype="<u4").tobytes()
        footer = struct.pack("<IBI", len(self.entries) + 1, CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class TokenFileReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"no seek table with checksums at the end of {uri}")
        table = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), dtype="<u4").reshape(-1, 3)
        self.sizes = table[:-1, 1].astype(np.int64)
        self.sums = table[:-1, 2]
        self.ends = np.cumsum(table[:-1, 0].astype(np.int64))
        at = int(self.ends[-1]) if len(self.ends) else 0
        n = len(self.sizes)
        names = self._read(at + 8, int(table[-1, 0]) - 8)
        ids, missing = np.frombuffer(names, "<i8", n, 8), names[8 + 8 * n :]
        self.doc_ids = [None if gone else int(i) for i, gone in zip(ids, missing)]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.sizes)

    def read(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of the file; a damaged frame raises."""
        start = int(self.ends[i - 1]) if i else 0
        frame = self._read(start, int(self.ends[i]) - start)
        ids = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.sizes[i]) or 1)
        if len(ids) != self.sizes[i] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(ids, dtype="<u4")


class WordEncoder:
    """Encodes texts with a tokenizers file whose pre-tokenizer drops white space.

    White space of ASCII ends every token, so a text has the ids of its words in a
    row.  A plain word, of ASCII and letters up to U+00FF, is cut where the tokenizer cuts it: into runs of letters,
    single digits and runs of other characters, each a piece with ids of its own.  The pieces of many
    texts are found and told apart as arrays; each different one is looked up once, and new ones
    are encoded together: each ends at a token of the word-end kind.

    Any other word is one piece, as it stands; so is one with an apostrophe or the start of a special token.
    Punctuation at its end is split off, but not where these or a sigma, whose lower case depends
    on what follows, could make a difference.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        vocabulary = self.tool.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts = _Remembered(self._ids)
        self.words = _Remembered(self._word)
        self.cuts: dict[bytes, tuple[bytes, bytes]] = {}

    def _ids(self, word: bytes) -> bytes:
        ids = self.tool.encode(word.decode("utf-8"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _cut(word: bytes) -> tuple[bytes, bytes]:
        """A word without and with the punctuation at its end."""
        if word.isalpha():
            return word.lower(), b""
        if b"'" in word or b"<|" in word or b"\xce\xa3" in word:
            return word, b""
        word = word.lower()
        head = word.rstrip(EDGE)
        if len(head) < len(word) and head.decode("utf-8")[-1:].lower()[-1:].isalnum():
            return head, word[len(head) :]
        return word, b""

    def _word(self, word: bytes) -> bytes:
        head, tail = self.cuts.pop(word, None) or self._cut(word)
        return self.parts[head] + self.parts[tail] if tail else self.parts[head]

    def _learn(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of the pieces that are not remembered yet, encoded together."""
        fresh = [p for p in pieces if p not in self.parts and p not in self.parts.older and len(p) <= LONGEST]
        if not fresh:
            return {}
        joined = b" ".join(fresh).decode("utf-8")
        ids = np.array(self.tool.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(fresh):  # some letter is taken apart; such words are encoded one by one
            return {}
        packed, at = ids.tobytes(), [0, *(4 * last).tolist()]
        learned = dict(zip(fresh, map(packed.__getitem__, map(slice, at, at[1:]))))
        self.parts.add_all(learned)
        return learned

    def _learn_words(self, words: list[bytes]) -> None:
        """Encode what is new of words that are not plain together, as far as it is letters."""
        fresh = [w for w in words if w not in self.words and w not in self.words.older]
        self.cuts = dict(zip(fresh, map(self._cut, fresh)))
        self._learn({h for h, _ in self.cuts.values() if h.decode("utf-8").isalpha()})

    @staticmethod
    def _pieces(data: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of the texts that begin at ``begins``, which of them are not plain, and the first one of each text."""
        kind, shown = _KIND[data], _LOWER[data]
        latin = np.flatnonzero(data == LATIN)
        second = data[latin + 1]
        letters = ~np.isin(second, NO_LETTERS)
        kind[latin + 1] = kind[latin] = np.where(letters, LETTER, ODD)
        shown[latin[letters & (second <= LAST_CAPITAL)] + 1] += 32
        kind[1:][(data[1:] == ord("|")) & (data[:-1] == ord("<"))] = ODD
        inside = kind != SPACE
        new = np.zeros(len(data), dtype=bool)  # at the start of a word
        new[:1] = True
        new[1:] = ~inside[:-1]
        new[begins[begins < len(data)]] = True
        cut = new.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        new &= inside
        cut &= inside
        odd, whole = np.flatnonzero(kind == ODD), np.zeros(len(data), dtype=bool)
        if len(odd):
            starts = np.flatnonzero(new)
            strange = np.zeros(len(starts), dtype=bool)
            strange[np.searchsorted(starts, odd, "right") - 1] = True
            whole[starts[0] :] = np.repeat(strange, np.diff(np.append(starts, len(data))))
            whole &= inside
            cut &= new | ~whole
            shown[whole] = data[whole]
        at = np.flatnonzero(cut)
        packed = shown[inside]
        offsets = np.append(np.flatnonzero(cut[inside]), len(packed)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        return pieces, whole[at], np.searchsorted(at, begins)

    def _looked_up(self, different: list[bytes], whole: np.ndarray) -> list[bytes]:
        """Ids of different pieces; those that are ``whole`` are words that are not plain."""
        ids = list(map(self.parts.get, different))
        absent = [i for i, found in enumerate(ids) if found is None]
        for i in absent:
            ids[i] = self.parts.older.get(different[i])
        again = [i for i in absent if ids[i] is not None]
        fresh = [i for i in absent if ids[i] is None]
        self.parts.add_all([(different[i], ids[i]) for i in again])
        words = whole[fresh].tolist()
        self._learn_words([different[i] for i, w in zip(fresh, words) if w])
        learned = self._learn(different[i] for i, w in zip(fresh, words) if not w)
        for i, w in zip(fresh, words):
            piece = different[i]
            ids[i] = self.words[piece] if w else learned[piece] if piece in learned else self.parts[piece]
        return ids

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        pieces, odd, first = self._pieces(data, ends[:-1] - ends[0])
        named = pieces.dictionary_encode()
        code, different = named.indices.to_numpy(), named.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = np.zeros(len(different), dtype=bool)
        whole[code[odd]] = True
        ids = self._looked_up(different, whole)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start, each = np.cumsum(size) - size, size[code]
        after = np.concatenate(([0], np.cumsum(each)))
        table = np.frombuffer(b"".join(ids), dtype="<u4")
        found = table[np.repeat(start[code] - after[:-1], each) + np.arange(after[-1])].tobytes()
        cuts = (4 * after[np.append(first, len(code))]).tolist()
        return [found[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string())) if texts else []

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``TOGETHER`` bytes of text at a time; a longer text is alone."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield batch.slice(low, high - low)
        low = high


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of every text, in ascending order of document ids; returns the manifest.

    A null text counts as empty and has the end id alone.  Rows with equal ids are
    written side by side, in order of a hash of their texts; rows without an id come
    last.  Other columns are ignored.  An empty table gives an empty manifest.  The
    files go to ``folder``/files and the manifest, as Parquet, to ``folder``/manifest.
    """
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    ranged = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        done: list[tuple] = []
        writer, path = None, ""

        def close() -> None:
            writer.close()
            done.append((part, len(done), path, len(writer.doc_ids), writer.ids, writer.bytes))

        for batch in batches:
            for some in _slices(batch):
                for doc_id, ids in zip(some.column(0).to_pylist(), tool.encode_column(some.column(1))):
                    if writer is None:
                        path = f"{folder}/files/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.zst"
                        writer = TokenFileWriter(path)
                    writer.add(doc_id, ids + end)
                    if writer.bytes >= file_bytes:
                        close()
                        writer = None
        if writer is not None:
            close()
        names = ["part", "piece", "path", "documents", "ids", "bytes"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*done)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, ids (little-endian bytes).

    ``start`` counts the ids of all documents before it.  The sums run over one row
    per file; each file is then read by a task of its own.
    """
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path"), batch.column("start")):
                file, at = TokenFileReader(path.as_py()), start.as_py()
                for low in range(0, len(file), 256):
                    ids = [file.read(i) for i in range(low, min(low + 256, len(file)))]
                    starts = at + np.cumsum([0, *map(len, ids)])
                    at = int(starts[-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[low : low + 256], pa.int64()),
                            pa.array(starts[:-1], pa.int64()),
                            pa.array([x.tobytes() for x in ids], pa.binary()),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    return (
        files.select("path", "start")
        .repartition(n, "path")
        .mapInArrow(read, "doc_id BIGINT, start BIGINT, ids BINARY")
    )


def round_trip(
    spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the files to a new shared folder and read all documents back."""
    folder = new_folder(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id, id_col, text))
