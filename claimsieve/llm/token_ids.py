"""Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

A text is cut where one pre-token always ends, distinct pieces are encoded once by the library, and the ids of a text are
the ids of its pieces in order. This gives the ids that the library gives for the whole text (tests hold the two
together) at a fraction of the time.
"""

from __future__ import annotations

import functools
import re

import numpy as np

from claimsieve.llm.common import PieceCache


#: Pieces that keep apart from each other in one text, with no mark or a line break before each.
_JOINS = {
    b"": re.compile(rb" [!-~\xc3\xd0\xd1][^\s\xc2\xe1\xe2\xe3]*").fullmatch,
    b"\n": re.compile(rb"[!-~\xc3\xd0\xd1][^\s\xc2\xe1\xe2\xe3]*").fullmatch,
}


class TextEncoder:
    """Encodes lists of texts; one per Python worker and tokenizer file (``text_encoder``)."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.width = np.zeros(size, np.int64)  # bytes of each token: in this vocabulary a character stands for a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.line = self._one(b"\n")
        self.cache = PieceCache(self._encode_pieces)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        # Many are encoded in one call: those that start with their space as they are, others after a line break.
        out: dict[bytes, bytes] = {}
        for mark in (b"", b"\n"):
            own = [p for p in pieces if _JOINS[mark](p)]
            groups = [own[i : i + 256] for i in range(0, len(own), 256)]
            before = self.line if mark else b""
            texts = [b"".join([mark + p for p in g]).decode() for g in groups]
            for group, enc in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(enc.ids, "<u4")
                ends = np.cumsum([len(p) + len(mark) for p in group])
                reached = np.cumsum(self.width[ids])
                at = np.searchsorted(reached, ends)
                if len(ids) and np.array_equal(reached[np.minimum(at, len(ids) - 1)], ends):
                    raw, cut = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
                    out.update(zip(group, [raw[a + len(before) : b] for a, b in zip(cut, cut[1:])], strict=True))
        return [out[p] if p in out else self._one(p) for p in pieces]  # by itself also where a vocabulary isn't byte-level

    def _one(self, piece: bytes) -> bytes:
        return np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.joined(texts)


@functools.lru_cache(1)
def text_encoder(tokenizer_path: str) -> TextEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    return TextEncoder(tokenizer_path)
