"""Encoding of texts by way of their space-separated pieces.

The tokenizers' pattern starts a new match at every single space before a
non-space, so a text is the concatenation of the pieces ``" word"`` and each
piece can be encoded by itself and remembered.  Texts in which a run of white
space would be cut are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larder.llm.common import chunks, ranges

#: A space between two white-space characters, or a space that ends a longer run at the end of the text.
_CUT_RUN = re.compile(r"\s \s|\s \Z")
MAX_PIECES, MAX_PIECE_CHARS, BATCH_CHARS = 250_000, 64, 1 << 20


class PieceCache:
    """Remembers encoded pieces in two generations: when the new one is full it
    becomes the old one, and pieces met again move up.  ``encode`` maps a list of strings to their
    encoded bytes, ``whole`` tells texts that have to be encoded whole."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[str], bool] = lambda text: False):
        self.encode, self.whole, self.known, self.old = encode, whole, {}, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        batch, size = [], 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size > BATCH_CHARS:
                out += self._batch(batch)
                batch, size = [], 0
        return out + (self._batch(batch) if batch else [])

    def _batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MAX_PIECES:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        parts: list[list[bytes | None] | None] = []  # of the pieces after the first; None: a text encoded whole
        plain: dict[str, bytes] = {}  # whole texts and first pieces, which have no space before them
        heads: list[str] = []
        missing: list[tuple[int, list[str]]] = []
        for at, text in enumerate(texts):
            if _CUT_RUN.search(text) or self.whole(text):
                parts.append(None)
                heads.append(text)
            else:
                head, *rest = text.split(" ")
                found = list(map(known.get, rest))
                if None in found:
                    missing.append((at, rest))
                parts.append(found)
                heads.append(head)
            plain[heads[-1]] = b""
        new = {p for at, rest in missing for p, ids in zip(rest, parts[at]) if ids is None}
        fresh = {p: old[p] for p in new if p in old}
        todo = list(new.difference(fresh))
        first = list(plain)
        done = self.encode(first + [" " + p for p in todo])
        plain.update(zip(first, done))
        fresh.update(zip(todo, done[len(first):]))
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= MAX_PIECE_CHARS)
        for at, rest in missing:
            parts[at] = [fresh[p] if ids is None else ids for p, ids in zip(rest, parts[at])]
        return [plain[head] + b"".join(found or ()) for head, found in zip(heads, parts)]


POOL_PIECES, POOL_PIECE_BYTES, POOL_BATCH_BYTES, JOINED, JOINS = 400_000, 64, 4 << 20, 256, 64
_CUT_RUN_ARROW = r"[\t-\r\x1c-\x20\x{85}\pZ] (?:[\t-\r\x1c-\x20\x{85}\pZ]|\z)"


class PiecePool:
    """``PieceCache`` on arrays: the pieces of a batch are told apart and looked up by Arrow, and only new ones are encoded.
    ``encode`` maps a list of strings to their ids, one after another, and the number of ids of each; ``n_bytes`` holds
    the bytes that each id stands for.  New pieces are encoded joined to longer strings and their ids told apart by
    their bytes; where that doesn't add up, they are encoded one by one."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], n_bytes: np.ndarray,
                 whole: Callable[[str], bool] = lambda text: False, pieces: int = POOL_PIECES):
        self.encode, self.n_bytes, self.whole, self.most = encode, n_bytes, whole, pieces
        self.pieces, self.ids = pa.array([], pa.large_string()), np.empty(0, np.uint32)
        self.start, self.count, self.met = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def texts(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        offs = np.r_[0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))].astype(np.int64)
        out: list[bytes] = []
        for lo, hi in chunks(offs, POOL_BATCH_BYTES):
            ids, n = self._batch(texts[lo:hi], column.slice(lo, hi - lo))
            ends = np.cumsum(n).tolist()
            out += [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        return out

    def _batch(self, texts: list[str], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = [c or self.whole(t) for c, t in zip(pc.match_substring_regex(column, _CUT_RUN_ARROW).to_pylist(), texts)]
        split = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), column), " ")
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, head = split.flatten(), np.cumsum(n) - n
        rest = np.ones(len(flat), bool)
        rest[head] = False
        coded = flat.filter(pa.array(rest)).dictionary_encode()
        start, count = self._pieces(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        heads = [t if w else h for t, w, h in zip(texts, whole, flat.take(pa.array(head)).to_pylist())]
        head_ids, head_n = self.encode(heads)
        at, size = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        at[rest], size[rest] = start[code], count[code]
        at[head], size[head] = len(self.ids) + np.cumsum(head_n) - head_n, head_n
        ids = np.concatenate([self.ids, head_ids])[ranges(at, size)]
        self._forget()
        return ids, np.add.reduceat(size, head)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of each distinct piece's ids in the pool, which takes up the new ones."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = True
        if len(new):
            fresh = pieces.take(pa.array(new))
            ids, n = self._encode_pieces(fresh)
            at[new] = len(self.pieces) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, n])
            self.pieces, self.met = pa.concat_arrays([self.pieces, fresh]), np.concatenate([self.met, np.zeros(len(new), bool)])
        return self.start[at], self.count[at]

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        done = [self._encode_joined(pieces.slice(i, JOINED * JOINS)) for i in range(0, len(pieces), JOINED * JOINS)]
        return np.concatenate([ids for ids, _ in done]), np.concatenate([n for _, n in done])

    def _encode_joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pieces.to_pylist()
        joined = [" " + " ".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)]
        ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        if not any(_CUT_RUN.search(t) or self.whole(t) for t in joined):
            ids, _ = self.encode(joined)
            reached = np.cumsum(self.n_bytes[ids])
            if len(ids) and reached[-1] == ends[-1]:
                last = np.searchsorted(reached, ends)
                if (reached[last] == ends).all():
                    return ids, np.diff(last + 1, prepend=0)
        if len(words) > JOINED:  # the strings apart, as only some of them may hold what can't be joined
            done = [self._encode_joined(pieces.slice(i, JOINED)) for i in range(0, len(words), JOINED)]
            return np.concatenate([ids for ids, _ in done]), np.concatenate([n for _, n in done])
        return self.encode([" " + w for w in words])

    def _forget(self) -> None:
        """Once full, the pool keeps the pieces that were met again, at most half of what it holds."""
        if len(self.pieces) <= self.most:
            return
        short = pc.binary_length(self.pieces).to_numpy(zero_copy_only=False) <= POOL_PIECE_BYTES
        keep = np.flatnonzero(self.met & short)[-(self.most // 2):]
        self.ids = self.ids[ranges(self.start[keep], self.count[keep])]
        self.pieces, self.count = self.pieces.take(pa.array(keep)), self.count[keep]
        self.start, self.met = np.cumsum(self.count) - self.count, np.zeros(len(keep), bool)
