"""SentencePiece encoding and decoding with a unigram vocabulary.

Encoding is the best path through the lattice of pieces (``lattice``: Viterbi over a double-array trie), with the pieces of
its UTF-8 bytes for a character that no piece covers. Decoding joins the pieces' bytes and turns white-space markers
back into spaces.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import Lattice
from .pieces import CACHE, MARK, read_model

#: Texts encoded together.
_TEXTS = 256


class _Known(dict):
    def __init__(self):
        super().__init__()
        self.missing: list[str] = []

    def __missing__(self, word: str) -> None:
        self.missing.append(word)
        self[word] = None


class UnigramCodec:
    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        usable = [lattice.pieces[i] for i in lattice.ids]
        #: Whether no piece reaches over the start of a word, so that words can be encoded one by one.
        self.by_word = not any(MARK in p[1:] for p in usable)
        self._bytes = [p.encode() for p in lattice.pieces]
        for b, i in enumerate(lattice.byte_ids.tolist()):
            self._bytes[i] = bytes([b])
        self.is_byte = np.zeros(len(lattice.pieces), bool)
        self.is_byte[lattice.byte_ids] = True
        self._known = _Known()

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        return text.split(" ") if self.by_word else [text.replace(" ", MARK)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text: one space is put before it, as SentencePiece does; an empty text has none."""
        split = [self._words(t) for t in texts]
        if len(self._known) > CACHE:
            self._known = _Known()
        known = self._known
        for words in split:
            deque(map(known.__getitem__, words), maxlen=0)
        if known.missing:
            ids, _ = self.lattice.viterbi([MARK + w for w in known.missing])
            for w, x in zip(known.missing, ids):
                known[w] = np.array(x, np.int32).tobytes()
            known.missing = []
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD, and a marker in the text itself a space."""
        raw = b"".join(map(self._bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return raw[1:] if raw.startswith(" ") else raw


def encode_documents(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array<int>, n_pieces, n_bytes: of them byte pieces, log_score: natural, decoded: what the ids give back).

    Null and empty texts have no pieces and decode to an empty text. Rows are independent, so repeated ones give repeated
    results; an empty table gives an empty one.
    """
    lattice = docs.sparkSession.sparkContext.broadcast(Lattice.from_model(model or read_model()))

    def run(batches):
        if "codec" not in _own or _own["of"] is not lattice.value:
            _own.update(codec=UnigramCodec(lattice.value), of=lattice.value)
        codec = _own["codec"]
        logp = codec.lattice.logp
        for b in batches:
            for at in range(0, b.num_rows, _TEXTS):
                part = b.slice(at, _TEXTS)
                ids = codec.encode([x or "" for x in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids)
                total = np.concatenate([[0.0], np.cumsum(logp[flat])])
                bytes_ = np.concatenate([[0], np.cumsum(codec.is_byte[flat])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends)), pa.array(np.diff(bytes_[ends]).astype(np.int32)), pa.array(np.diff(total[ends])), pa.array([codec.decode(x) for x in ids], pa.string())],
                    ["id", "ids", "n_pieces", "n_bytes", "log_score", "decoded"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, ids array<int>, n_pieces int, n_bytes int, log_score double, decoded string")


#: The codec of this worker process.
_own: dict = {}


def decode_ids(rows: DataFrame, model: bytes | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) for rows of piece ids; null lists decode to an empty text."""
    lattice = rows.sparkSession.sparkContext.broadcast(Lattice.from_model(model or read_model()))

    def run(batches):
        codec = UnigramCodec(lattice.value)
        for b in batches:
            text = [codec.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "id long, decoded string")
