"""SentencePiece encoding and decoding of whole documents, for merge-type models.

Encoding fills a prefix table.  Every prefix of a string has exactly one last
token, and token ``b`` may follow token ``a`` exactly when merging the characters of
``a + b`` gives ``[a, b]`` again.  So for each end position the pieces that end
there (found by an automaton over all pieces) are tried, and the one that is
compatible with the last token of the prefix before it is stored.  The ids are
then read off backwards.  This is linear in the text, without a merge queue.

Strings are encoded in segments: no piece reaches over a place where its two
characters stand next to each other in no piece, so the encoding of a text is that
of its segments in a row.  Segments and words are remembered in two generations of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of one generation of remembered words.
REMEMBERED = 200_000
#: Longest word or segment that is remembered.
LONGEST = 64
#: A batch is handed on when its texts reach this many characters.
BATCH_CHARS = 4_000_000
#: Numbers above all piece ids stand for characters that are no piece.
_CHARACTER = 1 << 17


class _Remembered(dict):
    """Values of a function by key, in two generations: the older one is dropped whole."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

    def add_all(self, pairs) -> None:
        """Remember keys, as ``update`` takes them, with the values that the function has for them."""
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self.update(pairs)


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.end_id = model.eos_id()
        self.ids, self.scores, self.bytes = {}, {}, {}
        self.shown = [""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte = int(piece[3:5], 16)
                self.bytes[byte] = i
                # Bytes of a character travel as lone surrogates until all are there.
                self.shown[i] = chr(byte) if byte < 0x80 else chr(0xDC00 + byte)
            elif model.is_unknown(i):
                self.shown[i] = " ⁇ "
            elif not (model.is_control(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.shown[i] = piece.replace(SPACE, " ")
        self.pieces = {i: p for p, i in self.ids.items()}
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.shown_by_text = {str(i): s for i, s in enumerate(self.shown)}
        self.segments = _Remembered(self._encode_segment)
        self.words = _Remembered(self._encode_word)

    # --- pair compatibility -------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """Merge the characters of a short text, best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = score, i
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _string(self, token: int) -> str:
        return self.pieces[token] if token < _CHARACTER else chr(token - _CHARACTER)

    def _compatible(self, before: int, token: int) -> bool:
        """Whether ``token`` keeps its shape right after ``before`` (-1: at the start)."""
        b = self._string(token)
        if before < 0:
            return self._merged(b) == [b]
        a = self._string(before)
        return self._merged(a + b) == [a, b]

    # --- encoding -----------------------------------------------------------

    def _tokens(self, text: str) -> list[int]:
        """Tokens of a text by the prefix table; characters outside the model as such."""
        ending: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, found in self.automaton.iter(text):
            ending[end].append(found)
        last = [-1] * (len(text) + 1)
        length = [0] * (len(text) + 1)
        pairs = self.pairs
        for end, found in enumerate(ending, start=1):
            for size, token in found:
                key = ((last[end - size] + 1) << 21) | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > 4 * REMEMBERED:
                        pairs.clear()
                    fits = pairs[key] = self._compatible(last[end - size], token)
                if fits:
                    last[end], length[end] = token, size
                    break
            else:
                last[end], length[end] = _CHARACTER + ord(text[end - 1]), 1
        out = []
        end = len(text)
        while end:
            out.append(last[end])
            end -= length[end]
        out.reverse()
        return out

    def _encode_segment(self, segment: str) -> str:
        """Ids in decimal, each with a space before it."""
        out = []
        for token in self._tokens(segment):
            if token < _CHARACTER:
                out.append(token)
            else:
                out.extend(self.bytes[b] for b in chr(token - _CHARACTER).encode())
        return "".join(f" {i}" for i in out)

    def _encode_word(self, word: str) -> str:
        cuts, neighbours = [0], self.neighbours
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in neighbours:
                cuts.append(i)
        if len(cuts) == 1:
            return self.segments[word]
        cuts.append(len(word))
        return "".join(self.segments[word[a:b]] for a, b in zip(cuts, cuts[1:]))

    def encode_text(self, text: str) -> str:
        """Ids of a text and the end id, in decimal, joined by one space."""
        if not text:
            return str(self.end_id)
        # A blank belongs to the word after it; the text starts with one more.
        words = (SPACE + text.replace(" ", SPACE)).replace(SPACE, " " + SPACE)[1:].split(" ")
        if SPACE in words:
            joined, blanks = [], ""
            for word in words:
                if word == SPACE:
                    blanks += word
                else:
                    joined.append(blanks + word)
                    blanks = ""
            words = joined + [blanks] * bool(blanks)
        return f"{''.join(map(self.words.__getitem__, words))} {self.end_id}"[1:]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split(" ")]

    # --- decoding -----------------------------------------------------------

    def decode_text(self, ids: str) -> str:
        """The text of ids in decimal, joined by one space."""
        text = "".join(map(self.shown_by_text.__getitem__, ids.split(" "))) if ids else ""
        if text.startswith(" "):
            text = text[1:]
        return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_text(" ".join(map(str, ids)))


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec per worker and file."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode_decode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_text`` and ``decoded_text`` to every row.

    ``ids_text`` holds the ids in decimal, joined by one space, with the end id;
    ``decoded_text`` is decoded from those ids.  A null text counts as empty and
    gives the end id alone.  Columns of ``docs`` with one of the new names are
    replaced; all other columns and all rows, repeated ones too, are kept.
    """
    new = ("n_tokens", "ids_text", "decoded_text")
    kept = [c for c in docs.columns if c not in new]
    at = kept.index(text)
    schema = ", ".join(
        [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
        + ["n_tokens BIGINT, ids_text STRING, decoded_text STRING"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_file)
        for batch in batches:
            texts = batch.column(at)
            start, size, counts, ids, decoded = 0, 0, [], [], []
            for i in range(batch.num_rows):
                encoded = tool.encode_text(texts[i].as_py() or "")
                ids.append(encoded)
                counts.append(encoded.count(" ") + 1)
                decoded.append(tool.decode_text(encoded))
                size += len(encoded)
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                        names=[*kept, *new],
                    )
                    start, size, counts, ids, decoded = i + 1, 0, [], [], []

    return docs.select(*kept).mapInArrow(run, schema)


def ids_of(ids_text: str) -> Column:
    """``ids_text`` as an array of numbers."""
    return F.split(ids_text, " ").cast("array<int>")
