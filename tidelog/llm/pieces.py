"""A public SentencePiece vocabulary as seen by the operators: word-wise encoding with bounded caches.

No piece of such a vocabulary has its white-space marker anywhere but in front, so no segmentation joins two words:
each word, with its marker, is encoded once and looked up afterwards.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

MARK = "▁"
#: Words that an encoder remembers before it starts anew.
CACHE = 500_000
DEFAULT_FILE = "piece_bpe_32k.model"


def vocabulary_path(name: str = DEFAULT_FILE, folder: str | None = None) -> str:
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def read_model(path: str | None = None) -> bytes:
    """The vocabulary file; read by the driver and sent along, so that executors need no copy of their own."""
    with open(path or vocabulary_path(), "rb") as f:
        return f.read()


class WordCache(dict):
    """What is known of words: a missing one is learned; begun anew, between texts, when it holds ``CACHE`` words."""

    def __missing__(self, word: str):
        value = self[word] = self.learn(word)
        return value

    def learn(self, word: str):
        raise NotImplementedError

    def look_up(self, text: str):
        """The known values of the text's words (split at single spaces); none for an empty text."""
        if len(self) > CACHE:
            self.clear()
        return map(self.__getitem__, text.split(" ")) if text else ()


class _Pieces(WordCache):
    def __init__(self, model: bytes):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._mark = self.sp.piece_to_id(MARK)

    def ids_of(self, word: str) -> list[int]:
        return self.sp.encode(word) if word else [self._mark]


class PieceCounter(_Pieces):
    """Numbers of pieces by the vocabulary's own tokenizer."""

    def learn(self, word: str) -> int:
        return len(self.ids_of(word))

    def count(self, text: str) -> int:
        return sum(self.look_up(text))


class PieceEncoder(_Pieces):
    """Piece ids by the vocabulary's own tokenizer."""

    def __init__(self, model: bytes):
        super().__init__(model)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])

    def learn(self, word: str) -> bytes:
        return array("i", self.ids_of(word)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.look_up(text)), np.int32)


@lru_cache(maxsize=4)
def shared(kind: type, model: bytes):
    """One object for each worker process, so that tasks that follow each other keep what was learned."""
    return kind(model)
