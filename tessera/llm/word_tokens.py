"""Token ids of a word-level BPE vocabulary file, fast for running text.

The tokenizer lower-cases, drops white space and splits the rest into pretokens (runs of
letters, single digits, runs of other signs); none spans a space or line feed.  So texts are cut
at the strings of added tokens, then at those two characters, and each distinct cut is encoded once
and remembered, in tables of bounded size that live as long as the worker process.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

#: Entries kept of each table's young half; a full one becomes the old half, and the old one goes.
CACHE_ENTRIES, LONGEST_KEPT = 350_000, 200
_PIECES = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}']+")
#: UTF-8 bytes as the vocabulary spells them: printable Latin-1 as it is, the rest from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = dict(zip([b for b in range(256) if b not in _PRINTABLE], range(256, 512), strict=False))


class _Memory(dict):
    """Values by key, worked out when first asked for; two generations, so what is used stays."""

    def __init__(self, make: Callable[[str], bytes], entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = value
        return value

    def trim(self) -> None:
        self.old = {}

    def age(self) -> None:
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


class WordTokens:
    """Encoder for one vocabulary file; ``ids`` gives little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # an added token's string in a text is that token, found before anything else; such texts are cut there first
        added = {t.content: struct.pack("<I", i) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that are matched after normalising, as single words or with white space aren't supported")
        self.added = added
        self.added_at = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        vocab = self.tokenizer.get_vocab()
        self.sentence_ends = sorted(i for s, i in vocab.items() if s.endswith("</w>") and s[:-4] and not s[:-4].strip(".!?"))
        self.cuts, self.pieces = _Memory(self._cut, entries), _Memory(self._piece, entries // 2)

    def _piece(self, piece: str) -> bytes:
        """One pretoken: the vocabulary's merges of it, spelled."""
        spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_SPELLING)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cut(self, cut: str) -> bytes:
        """A cut by its pretokens where the plain reading is certain, else (apostrophes, other white
        space, signs outside Latin or not composed) the whole tokenizer's way."""
        if cut.isascii() or (max(cut) < "\u0250" and unicodedata.is_normalized("NFC", cut)):
            low = cut.lower()
            if low.isalpha() and len(low) == len(cut):
                return self.pieces[low]
            pieces = _PIECES.findall(low)
            if sum(map(len, pieces)) == len(cut):
                return b"".join([self.pieces[x] for x in pieces])
        ids = self.tokenizer.encode(cut, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def trim(self) -> None:
        """Free what wasn't used lately; called at the end of a task."""
        self.cuts.trim()
        self.pieces.trim()

    def ids(self, text: str) -> bytes:
        """The library's own ids of ``text``, without special tokens around it."""
        if any(content in text for content in self.added):
            parts = self.added_at.split(text)
            return b"".join([self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(parts)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words, out = text.replace("\n", " ").split(" "), []
        for at in range(0, len(words), 50_000):
            self.cuts.age()
            self.pieces.age()
            out.append(b"".join(map(self.cuts.__getitem__, words[at : at + 50_000])))
        return out[0] if len(out) == 1 else b"".join(out)


_OPEN: dict[str, WordTokens] = {}


def opened(path: str) -> WordTokens:
    """The encoder of a file, kept for the life of the worker process."""
    if path not in _OPEN:
        _OPEN[path] = WordTokens(path)
    return _OPEN[path]
