"""Token ids of whole texts by a public tokenizer, with a bounded memory of words.

The vocabularies split a text before any merge happens, and a single space is always such a split. So a text is
cut at its spaces, each distinct piece is encoded once, and the pieces' ids are joined. Texts where white space
runs over such a cut, or that hold a special token's string, are encoded as a whole. Plain Latin words skip the
normaliser and the splitter and go straight to the merges of the library's model.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Runs of white space that a byte-level splitter keeps together over a single space, and what every such run holds.
_UNSAFE, _BLANKS = re.compile(r"\s \s|\s $"), re.compile(r" \s")
#: A word of Latin letters and the marks after it; an apostrophe may begin a contraction and is left to the library.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_ENCODERS: dict[tuple[str, int], TextEncoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible Latin-1, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids by piece, learned when first asked for, in two halves of ``half`` pieces: a full one takes the place of the other."""

    def __init__(self, learn: Callable[[str], bytes], half: int):
        super().__init__()
        self.learn, self.half, self.before = learn, half, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(piece)
        if ids is None:
            ids = self.learn(piece)
        self[piece] = ids
        return ids


class TextEncoder:
    """Ids of texts as little-endian unsigned 16-bit (vocabularies under 65536) or 32-bit numbers.

    ``memory`` bounds the remembered pieces; pieces in use stay known when it is full. This never changes an id.
    """

    def __init__(self, path: str, memory: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) < 65536 else "<u4")
        self.lower = self.tokenizer.normalizer is not None  # the word vocabulary: lower case, white space dropped
        self.known = _Pieces(self._learn, memory // 2)
        self.starts = _Pieces(lambda word: self._tokenize(word, ""), memory // 16)  # words at the start of a line
        self.marks = _Pieces(lambda marks: self._whole([marks])[0], memory // 16)  # marks after words
        letters = _byte_letters()
        self.space = "" if self.lower else letters[32]
        self.letters = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(0x100)}
        self.raw = [bytes(x) for x in np.arange(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=self.kind)[:, None]]
        self.line = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in got]

    def _tokenize(self, word: str, space: str) -> bytes:
        """Ids of a word of Latin letters after ``space``, the stand-in of a space or nothing."""
        shown = word if word.isascii() else "".join(map(self.letters.__getitem__, word))
        return b"".join([self.raw[t.id] for t in self.tokenizer.model.tokenize(space + shown)])

    def _plain(self, word: str) -> bytes:
        """Ids of a word of Latin letters as a piece of its own."""
        low = word.lower() if self.lower else word
        return self._tokenize(word, self.space) if low == word else self.known[low]

    def _latin(self, piece: str, first: Callable[[str], bytes]) -> bytes | None:
        """Ids of a piece whose lines are a Latin word and marks each, the first word's by ``first``; None for all others.

        A line break between a mark or letter and a letter is always a token of its own.
        """
        lines = []
        for line in piece.split("\n"):
            m = _WORD.fullmatch(line)
            if m is None:
                return None
            word, marks = m.groups()
            ids = self.starts[word] if lines else first(word)
            lines.append(ids + self.marks[marks] if marks else ids)
        return self.line.join(lines)

    def _learn(self, piece: str) -> bytes:
        """Ids of a piece, after its space where the vocabulary keeps spaces."""
        if piece.isascii() and piece.isalpha():
            return self._plain(piece)
        ids = self._latin(piece, lambda word: self._plain(word) if word == piece else self.known[word])
        return self._whole([piece if self.lower else " " + piece])[0] if ids is None else ids

    def _head(self, piece: str) -> bytes:
        """Ids of the first piece of a text, which has no space before it."""
        ids = self._latin(piece, self.starts.__getitem__) if piece else b""
        return self._whole([piece])[0] if ids is None else ids

    def _unsafe(self, text: str) -> bool:
        """Whether the text must be encoded as a whole."""
        if "<|" in text:
            return True
        return not self.lower and (text.endswith(" ") or _BLANKS.search(text) is not None) and _UNSAFE.search(text) is not None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens of its own."""
        if self.lower:
            texts = [t.replace("\n", " ") for t in texts]
        unsafe = list(map(self._unsafe, texts))
        whole = iter(self._whole([t for t, u in zip(texts, unsafe, strict=True) if u]))
        out = []
        for t, u in zip(texts, unsafe, strict=True):
            if u:
                out.append(np.frombuffer(next(whole), self.kind))
                continue
            pieces = t.split(" ")
            head = b"" if self.lower else self._head(pieces.pop(0))
            out.append(np.frombuffer(head + b"".join(map(self.known.__getitem__, pieces)), self.kind))
        return out


def encoder(path: str, memory: int = 1_000_000) -> TextEncoder:
    """The encoder of this process; a worker that runs many tasks keeps its words."""
    if (path, memory) not in _ENCODERS:
        _ENCODERS[path, memory] = TextEncoder(path, memory)
    return _ENCODERS[path, memory]
