"""Hashed character features of distinct words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm import _bytes as B

#: Distinct words that are hashed at a time, so that memory follows the features alone.
PART = 8192


class Words:
    """The distinct words of a chunk and where each stands."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.starts, self.ends, self.counts = B.spans(B.ALNUM[data], offs)
        self.data = B.LOWER[data]
        self.keys, at, self.which = np.unique(B.Hasher(self.data)(self.starts, self.ends), return_index=True, return_inverse=True)
        self.at, self.until = self.starts[at], self.ends[at]

    def _parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bytes of ``PART`` distinct words after the other, and the words' lengths."""
        for a in range(0, len(self.at), PART):
            at, length = self.at[a : a + PART], (self.until - self.at)[a : a + PART]
            yield self.data[np.repeat(at - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))], length

    def ngrams(self, sizes: tuple[int, ...], tables: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes below ``tables`` of the byte n-grams of each distinct word, between
        marks of its start and end, and their number in each word."""
        grams, totals = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for data, length in self._parts():
            begin = np.cumsum(length + 2) - (length + 2)
            padded = np.full(int((length + 2).sum()), 94, np.uint8)
            padded[np.repeat(begin + 1 - (np.cumsum(length) - length), length) + np.arange(len(data))] = data
            padded[begin + length + 1] = 36
            hasher = B.Hasher(padded)
            each = [np.maximum(length + 3 - n, 0) for n in sizes]
            total = sum(each)
            out, place = np.empty(int(total.sum()), np.int32), np.cumsum(total) - total
            for n, many in zip(sizes, each):
                turn = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                first = np.repeat(begin, many) + turn
                out[np.repeat(place, many) + turn] = hasher(first, first + n) % np.uint64(tables)
                place = place + many
            grams.append(out)
            totals.append(total)
        return np.concatenate(grams), np.concatenate(totals)

    def prefixes(self, sizes: tuple[int, ...], tables: int) -> np.ndarray:
        """Hashes below ``tables`` of each distinct word's first bytes, a column for each size."""
        out = [np.zeros((0, len(sizes)), np.int32)]
        for data, length in self._parts():
            hasher, at = B.Hasher(data), np.cumsum(length) - length
            each = [B.mix(hasher(at, at + np.minimum(length, n)) + np.uint64(n)) % np.uint64(tables) for n in sizes]
            out.append(np.stack(each, axis=1).astype(np.int32))
        return np.concatenate(out)

    @classmethod
    def of(cls, texts: list[str], limit: int = 1 << 20) -> Words:
        """Words of texts of any total size; only the distinct ones' bytes are kept."""
        self = cls.__new__(cls)
        ids: dict[int, int] = {}
        counts, which, pieces, sizes = [], [], [], []
        for _, _, data, offs in B.text_chunks(pa.array(texts, pa.string()), limit):
            part = cls(data, offs)
            raw = part.data.tobytes()
            for key, a, b in zip(part.keys.tolist(), part.at.tolist(), part.until.tolist()):
                if key not in ids:
                    ids[key] = len(ids)
                    pieces.append(raw[a:b])
                    sizes.append(b - a)
            which.append(np.fromiter((ids[k] for k in part.keys.tolist()), np.int32, len(part.keys))[part.which])
            counts.append(part.counts)
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.until = np.cumsum(np.array(sizes, np.int64))
        self.at = self.until - np.array(sizes, np.int64)
        self.keys = np.fromiter(ids, np.uint64, len(ids))
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.which = np.concatenate(which) if which else np.zeros(0, np.int32)
        return self


def sum_rows(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``counts`` of them for each; none: zeros."""
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out
