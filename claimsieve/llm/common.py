"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from string import ascii_letters, digits, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SPACE, _SURE, _STARTS, _ALNUM, _PUNCTUATION, _LEAD = (1 << i for i in range(6))


def _classes() -> np.ndarray:
    """What each byte of UTF-8 may be: bits of the classes above."""
    of = np.zeros(256, np.uint8)
    of[[9, 10, 11, 12, 13, 32]] = _SPACE
    plain = np.array([b for b in range(128) if not of[b] and not 0x1C <= b <= 0x1F])
    of[plain] |= _SURE | _STARTS  # no white space
    of[[b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3)]] |= _STARTS  # begins no white space character
    of[list((ascii_letters + digits).encode())] |= _ALNUM
    of[list(punctuation.encode())] |= _PUNCTUATION
    of[[0xC3, 0xD0, 0xD1]] |= _LEAD  # two bytes that are a letter, but for the signs of multiplication and division
    return of


_CLASSES = _classes()
#: Stands between texts; no byte of UTF-8.
_END = b"\xff"
#: Longer pieces are computed again wherever they occur, so that texts without spaces do not fill the memory.
LONGEST = 48


def piece_starts(raw: np.ndarray) -> np.ndarray:
    """Where texts, each with ``_END`` after it, may be cut: every pre-token of byte-level BPE stays as it is.

    Cut are: before a space that no white space follows; between a letter or digit and ASCII punctuation; around a line break
    between two characters that are no white space; around ``_END``. Bytes of which the class is not known are not cut at.
    """
    of = _CLASSES[raw]
    letter = (of & _ALNUM) > 0
    wide = (of[:-1] & _LEAD > 0) & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
    letter[1:] |= wide & (raw[1:] >= 0x80) & (raw[1:] < 0xC0)
    starts = np.append((of[1:] & _STARTS) > 0, False)  # of the next byte
    cut = (raw == 32) & starts
    cut[1:] |= letter[:-1] & (of[1:] & _PUNCTUATION > 0)
    line = (raw == 10) & starts
    line[1:] &= letter[:-1] | (of[:-1] & _SURE > 0)
    line[0] = False
    end = raw == 0xFF
    cut |= line | end
    cut[1:] |= line[:-1] | end[:-1]
    cut[0] = True
    return np.flatnonzero(cut)


class PieceCache:
    """Values of pieces of texts, joined by text. Each distinct piece of a call is computed once; short ones are remembered.

    The memory that remembered pieces take is bounded by ``limit`` bytes for each of two generations: a piece that was
    forgotten, or is longer than ``LONGEST``, is computed again.
    """

    def __init__(self, compute: Callable[[list[bytes]], list[bytes]], limit: int = 24 << 20):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def joined(self, texts: list[str]) -> list[bytes]:
        """For each text, the values of its pieces in order, joined."""
        raw = _END.join([t.encode() for t in texts]) + _END
        data = np.frombuffer(raw, np.uint8)
        at = piece_starts(data)
        ends = np.flatnonzero(data[at] == 0xFF)
        offsets = np.append(at, len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        values = self._values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        got = pa.array(values, pa.large_binary()).take(coded.indices)
        cuts = [0, *np.frombuffer(got.buffers()[1], np.int64)[ends].tolist()]
        out = memoryview(got.buffers()[2] or b"")
        return [bytes(out[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _values(self, pieces: list[bytes]) -> list[bytes]:
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        values = list(map(self.young.get, pieces))
        new = []
        for i in [i for i, v in enumerate(values) if v is None]:
            if (v := b"" if pieces[i] == _END else self.old.get(pieces[i])) is not None:
                self._keep(pieces[i], v)
                values[i] = v
            else:
                new.append(i)
        for i, v in zip(new, self.compute([pieces[i] for i in new]), strict=True):
            values[i] = v
            if len(pieces[i]) <= LONGEST:
                self._keep(pieces[i], v)
        return values

    def _keep(self, piece: bytes, value: bytes) -> None:
        self.young[piece] = value
        self.size += 170 + len(piece) + len(value)  # two objects and an entry of the dictionary


def spare(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Bytes of a batch of rows between Spark and a Python worker, whatever the length of texts.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after batches for Python workers have been bounded in bytes: many long texts make a batch of any size else."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key, None) != str(BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df


def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at the end, memory that Python and Arrow hold for later goes back to the machine, since workers live on."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def portions(batches: Iterator[pa.RecordBatch], column: str, chars: int = 3_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts (NULL: empty), of about ``chars`` characters each, so that memory stays bounded."""
    for batch in give_back(batches):
        if batch.num_rows == 0:
            continue
        texts = [t or "" for t in batch.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
