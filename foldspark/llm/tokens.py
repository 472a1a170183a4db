"""Exact, cached encoding with the public vocabularies of the tokenizers library.

Both vocabularies split a text at white space before any merge is made, so the ids of a text are the ids of its
white-space chunks in order.  Most chunks are repeated words: each worker keeps the ids of the chunks it has met (at
most ``CACHE_CHUNKS``; rarer ones are simply encoded again) and the library encodes only the others.  Texts whose
white space or control characters could make a chunk depend on its neighbours go to the library whole, and so do texts
that hold the string of an added token (an end mark, say), which the library cuts out before anything else.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable

import numpy as np

#: Chunks that one worker remembers, of some 230 bytes each.
CACHE_CHUNKS = 450_000
#: Longer chunks are not remembered.
CACHE_CHARS = 64

_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")
#: A chunk that is one word of Latin-1 letters and perhaps one mark: its pre-tokens are plain, and no normal form changes it.
_PLAIN = re.compile(r"( ?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?]?)")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _visible_bytes() -> dict[int, int]:
    """The printable stand-ins of byte-level vocabularies: bytes without a glyph move to 256 and up, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {b: moved.get(b, b) for b in range(256)}


_VISIBLE = _visible_bytes()
_BLANK = chr(_VISIBLE[32])


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """The file of a public vocabulary: in ``folder``, or where the installed package keeps it."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class _Chunks(dict):
    """ids by chunk; computes what it lacks."""

    def __init__(self, compute: Callable[[str], bytes], most: int):
        super().__init__()
        self._compute, self._most = compute, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self._compute(chunk)
        if len(self) < self._most and len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids


class Encoder:
    """ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, keeps_spaces: bool, most: int = CACHE_CHUNKS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._keeps_spaces = keeps_spaces
        self._model = self._tokenizer.model
        self._known = _Chunks(self._chunk, most)
        self._known.update((mark, self._direct([mark])[0]) for mark in ".,;:!?")

    def _direct(self, texts: list[str]) -> list[bytes]:
        out = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in out]

    def _word(self, word: str) -> bytes:
        """ids of one pre-token, straight from the vocabulary's model."""
        ids = [t.id for t in self._model.tokenize(word)]
        return _PACK[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            return self._direct([chunk])[0]
        space, word, mark = plain.groups()
        key = space + word
        ids = self._known.get(key)
        if ids is None:
            key = key if self._keeps_spaces else word.lower()
            ids = self._word(key.replace(" ", _BLANK) if key.isascii() else key.encode().decode("latin-1").translate(_VISIBLE))
        return ids + self._known[mark] if mark else ids

    def _look_up(self, chunks: list[str]) -> bytes:
        return b"".join(map(self._known.__getitem__, chunks))

    def encode(self, text: str | None) -> np.ndarray:
        """ids (uint32) of a text; none for null or an empty text."""
        if not text:
            return np.empty(0, "<u4")
        if any(mark in text for mark in self._added):
            return np.frombuffer(self._direct([text])[0], "<u4")
        if self._keeps_spaces:
            # Each white space is a lone blank or line end between words (no other is printable): a blank belongs to the
            # word after it.
            flat = text.replace("\n", " ")
            if "  " in flat or flat[0] == " " or flat[-1] == " " or not flat.isprintable():
                return np.frombuffer(self._direct([text])[0], "<u4")
            chunks = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
            return np.frombuffer(self._look_up(chunks), "<u4")
        if _ODD_SPACE.search(text):
            return np.frombuffer(self._direct([text])[0], "<u4")
        return np.frombuffer(self._look_up(text.split()), "<u4")


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_spaces: bool, most: int = CACHE_CHUNKS) -> Encoder:
    """The worker's own encoder of a vocabulary file."""
    key = (path, keeps_spaces)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keeps_spaces, most)
    return _encoders[key]


def encode_all(encode: Callable[[str | None], np.ndarray], texts: Iterable[str | None], end_id: int) -> list[np.ndarray]:
    """ids of each text, followed by the end id."""
    end = np.array([end_id], "<u4")
    return [np.concatenate([encode(t), end]) for t in texts]
