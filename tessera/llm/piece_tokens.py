"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

The automaton of all pieces reads a text once; at each character its output links give every piece
that ends there, and each relaxes the best score of that position.  A character that is no piece
is spelled in byte pieces (or is the unknown piece), at a score below all pieces'.

No piece of the usual vocabularies runs from a word into the next (``x▁``) or holds a line feed
without being one; where that holds, which is checked on loading, best paths of a text are best
paths of its words put together.  Words are then remembered in a table of bounded size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, texts

SPACE = "▁"
#: An unknown character scores so much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Stretches remembered, and how long one may be to be remembered.
CACHE_ENTRIES, LONGEST_KNOWN = 300_000, 200

Path = tuple[bytes, float]


class Pieces:
    """Pieces and scores of one model file."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelling: list[bytes] = []
        self.bytes_: dict[int, int] = {}
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.separable = self.by_line = True
        scores = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_[value] = i
                self.spelling.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelling.append(b"")
            else:
                self.spelling.append(piece.encode())
                self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
                scores.append(model.get_score(i))
                if len(piece) == 1:
                    self.single.add(piece)
                self.separable &= SPACE not in piece.lstrip(SPACE)
                self.by_line &= "\n" not in piece
        self.automaton.make_automaton()
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.entries = entries
        self.known: dict[str, Path] = {}

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Piece ids of the best path and its score; of equal paths the one whose last pieces are longer."""
        n = len(text)
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        strange = [i for i, c in enumerate(text) if c not in self.single]
        at, many = 0, len(strange)
        for end, (size, score, piece) in self.automaton.iter(text):
            while at < many and strange[at] < end:  # positions before this match are settled first
                i = strange[at]
                if best[i] + self.unknown_score > best[i + 1]:
                    best[i + 1], back[i + 1] = best[i] + self.unknown_score, (i, -1)
                at += 1
            start = end + 1 - size
            score += best[start]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (start, piece)
        for i in strange[at:]:
            if best[i] + self.unknown_score > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.unknown_score, (i, -1)
        ids: list[int] = []
        i = n
        while i:
            start, piece = back[i]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += reversed([self.bytes_.get(b, self.unknown) for b in text[start].encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown])
            i = start
        ids.reverse()
        return ids, best[n]

    def _word(self, word: str) -> Path:
        ids, score = self.viterbi(word)
        path = (struct.pack(f"<{len(ids)}I", *ids), score)
        if len(word) <= LONGEST_KNOWN:  # so the table is bounded in bytes as well
            if len(self.known) > self.entries:
                self.known.clear()
            self.known[word] = path
        return path

    def cuts(self, text: str) -> list[str]:
        """The escaped text in stretches that no piece crosses."""
        out = []
        lines = (SPACE + text.replace(" ", SPACE)).split("\n") if self.by_line else [SPACE + text.replace(" ", SPACE)]
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            if not self.separable:
                out.append(line)
                continue
            words = line.split(SPACE)
            if words[0]:
                out.append(words[0])
            lead = SPACE
            for w in words[1:]:
                if w:
                    out.append(lead + w)
                    lead = SPACE
                else:
                    lead += SPACE
            if len(lead) > 1:  # spaces at the end
                out.append(lead[1:])
        return [c for c in out if c]

    def encode(self, text: str) -> Path:
        """Little-endian unsigned 32-bit ids of a text and their score; the empty text has none."""
        if not text:
            return b"", 0.0
        get, make = self.known.get, self._word
        paths = [get(c) or make(c) for c in self.cuts(text)]
        return b"".join([p[0] for p in paths]), sum([p[1] for p in paths])

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids: byte pieces as bytes, the first space dropped."""
        spelling = self.spelling
        text = b"".join([spelling[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_OPEN: dict[str, Pieces] = {}


def opened(path: str) -> Pieces:
    """The pieces of a file, kept for the life of the worker process."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``<id_col>, n_tokens, ids_crc32, score, restored`` (and ``ids``) for every row, no shuffle.

    ``restored`` tells whether decoding gives the text back (it does unless the text holds U+2581
    itself).  Null and empty texts have no tokens.  Repeated rows and null identifiers pass
    through; other columns are ignored; an empty table gives an empty result.
    """
    schema = "row_id long, n_tokens long, ids_crc32 long, score double, restored boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = opened(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                cols: list[list] = [[], [], [], [], []]
                for text in texts(batch, "body"):
                    data, score = pieces.encode(text)
                    ids = np.frombuffer(data, dtype="<u4")
                    for col, x in zip(cols, (len(ids), zlib.crc32(data), score, pieces.decode(ids.tolist()) == text, ids.astype(np.int32) if with_ids else None), strict=True):
                        col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int32()))
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: 4 + with_ids]
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), *arrays], names=[f.split()[0] for f in schema.split(", ")])

    return limit_batches(df).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body")).mapInArrow(run, schema).withColumnRenamed("row_id", id_col)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``<id_col>, text`` from an array of ids; a null array gives a null text, an empty one the empty text.
    Repeated rows and null identifiers pass through; other columns are ignored; very long arrays take time in
    proportion; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = opened(path)
        for batch in batches:
            out = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(out, pa.string())], names=["row_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "row_id long, text string").withColumnRenamed("row_id", id_col)
