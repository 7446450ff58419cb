"""Encoding with a public byte-level BPE tokenizer, without regular expressions.

The texts of a batch become one array of code points. A class per code point, with the classes that
follow it, gives a symbol; each symbol is a function from automaton state to automaton state, and such
functions compose, so the states at all places come from an associative scan: blocks are composed side
by side, then the blocks' starting states are chained, then all blocks run at once. A flag per state and
symbol tells where a piece starts. Pieces are sliced out and merged once each; a cache holds their ids.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_FOLDER = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"

# classes of code points
L, N, O, SPACE, WHITE = range(5)
# symbols: a class, seen with what follows; the last whitespace before other text differs from the rest
S_L, S_N, S_O, S_BLANK, S_WHITE, S_RUN, S_TWO, S_THREE = range(8)
SYMBOLS = 8
# states: the piece that is open
LETTERS, NUMBERS, OTHERS, PREFIX, RUN, ONE, LEFT1, LEFT2, DONE = range(9)
STATES = 9
# White space beside the blank (Unicode's property White_Space).
WHITES = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and piece-start flag by (symbol, state); symbols from SYMBOLS on start a text."""
    to, new = np.zeros((2 * SYMBOLS, STATES), np.uint8), np.zeros((2 * SYMBOLS, STATES), bool)
    for s in range(STATES):
        for symbol, joins, state in ((S_L, (LETTERS, PREFIX), LETTERS), (S_N, (NUMBERS, PREFIX), NUMBERS), (S_O, (OTHERS, PREFIX), OTHERS), (S_RUN, (RUN,), RUN)):
            to[symbol, s], new[symbol, s] = state, s not in joins
        if s in (LEFT1, LEFT2):  # the letters of a contraction
            to[S_L, s], new[S_L, s] = (DONE if s == LEFT1 else LEFT1), False
        to[S_BLANK, s], new[S_BLANK, s] = PREFIX, True
        to[S_WHITE, s], new[S_WHITE, s] = ONE, True
        for symbol, state in ((S_TWO, LEFT1), (S_THREE, LEFT2)):
            inside = s in (OTHERS, PREFIX)
            to[symbol, s], new[symbol, s] = (OTHERS if inside else state), not inside
    to[SYMBOLS:], new[SYMBOLS:] = to[:SYMBOLS, DONE : DONE + 1], True
    return to, new


TO, NEW = _machine()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, O, np.uint8)
    kind = {"L": L, "N": N}
    for n in range(0x110000):
        table[n] = kind.get(unicodedata.category(chr(n))[0], O)
    table[WHITES] = WHITE
    table[32] = SPACE
    return table


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol at each place of concatenated texts; ``starts`` has the first place of each text."""
    n = len(points)
    c = _classes()[points]
    first = np.zeros(n + 3, bool)
    first[starts[starts < n]] = True
    first[n:] = True
    white = c >= SPACE
    followed = np.zeros(n, bool)  # by something in the same text that isn't white space
    followed[:-1] = ~white[1:] & ~first[1:n]
    out = c.copy()
    out[white & ~followed] = S_RUN
    out[(c == WHITE) & followed] = S_WHITE
    at = np.flatnonzero(points == 39)
    if len(at):
        p = np.concatenate([points, np.zeros(3, points.dtype)])
        a, b = p[at + 1], p[at + 2]
        same1, same2 = ~first[at + 1], ~first[at + 1] & ~first[at + 2]
        two = same1 & np.isin(a, [ord(x) for x in "stmd"])
        three = same2 & ((np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        out[at[two]] = S_TWO
        out[at[three]] = S_THREE
    out[first[:n]] += SYMBOLS
    return out


def piece_starts(points: np.ndarray, starts: np.ndarray, block: int = 256) -> np.ndarray:
    """Places at which pieces start, by a scan of transition functions over blocks of places."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    sym = symbols(points, starts)
    rows = -(-n // block)
    grid = np.full(rows * block, S_RUN, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    flat = TO.ravel()
    for column in grid:  # compose the functions of every block, all blocks side by side
        whole = flat[column[:, None].astype(np.int64) * STATES + whole]
    entry = np.empty(rows, np.uint8)
    state = DONE
    for r in range(rows):
        entry[r] = state
        state = whole[r, state]
    fresh, flags = NEW.ravel(), np.empty((block, rows), bool)
    state_of = entry
    for k, column in enumerate(grid):
        index = column.astype(np.int64) * STATES + state_of
        flags[k] = fresh[index]
        state_of = flat[index]
    return np.flatnonzero(flags.T.ravel()[:n])


class ByteBPE:
    """Merges the bytes of pieces by rank; ids of pieces are cached, up to ``most`` of them."""

    def __init__(self, path: str | None = None, most: int = 500_000):
        path = path or os.path.join(TOKENIZER_FOLDER, BYTE_BPE)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.most = most
        self.cache: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.cache.get(text)
        if ids is None:
            ids = self._merge(text.encode("utf-8", "surrogatepass"))
            if len(self.cache) >= self.most:
                self.cache.clear()
            if len(text) < 64:
                self.cache[text] = ids
        return ids

    def _merge(self, data: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            if not alive[k] or (right := after[k]) >= n or end[right] != stop:
                continue
            alive[right] = False
            end[k] = stop
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get(data[k : end[after[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
            if (left := before[k]) >= 0 and (r := ranks.get(data[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[data[k : end[k]]])
            k = after[k]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """(ids, end of each piece's ids with its place) per text; see encode for the plain ids."""
        filled = [t or "" for t in texts]
        lengths = np.fromiter(map(len, filled), np.int64, len(filled))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        joined = "".join(filled)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = piece_starts(points, starts[lengths > 0])
        bounds = np.append(at, len(points)).tolist()
        cut = np.searchsorted(at, ends).tolist()
        out, k = [], 0
        piece = self.piece
        for stop, start in zip(cut, starts.tolist()):
            ids: list[int] = []
            offsets: list[int] = []
            while k < stop:
                got = piece(joined[bounds[k] : bounds[k + 1]])
                offsets += [bounds[k] - start] * len(got)
                ids += got
                k += 1
            out.append((ids, offsets))
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0][0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._bytes().__getitem__, ids)).decode("utf-8", "surrogatepass")

    @lru_cache(maxsize=1)  # noqa: B019
    def _bytes(self) -> dict[int, bytes]:
        return {v: k for k, v in self.ranks.items()}


_TOKENIZERS: dict[str, ByteBPE] = {}


def tokenizer(path: str | None = None) -> ByteBPE:
    """The tokenizer of a file, read once per process."""
    path = path or os.path.join(TOKENIZER_FOLDER, BYTE_BPE)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteBPE(path)
    return _TOKENIZERS[path]


def _parts(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most about ``most`` characters, so that arrays stay small."""
    first = size = 0
    for n, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield first, n + 1
            first, size = n + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_column(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, path: str | None = None, output: str = "ids") -> DataFrame:
    """``doc_id`` and ``ids`` (whole texts, no special tokens) of every row; other columns are left out.

    ``output``: ids, or n_tokens (their number, without the ids leaving Python), or offsets, which adds for
    each id the place in the text at which its piece starts. Null and empty texts have an empty list. The
    tokenizer's folder is a parameter (or WEFTLINE_TOKENIZERS); every worker reads the file itself.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, stop in _parts(texts, 1_000_000):
                done = bpe.encode_batch(texts[first:stop])
                columns = {"doc_id": b.column(0).slice(first, stop - first)}
                if output == "n_tokens":
                    columns["n_tokens"] = pa.array([len(ids) for ids, _ in done], pa.int64())
                else:
                    columns["ids"] = pa.array([ids for ids, _ in done], pa.list_(pa.int32()))
                    if output == "offsets":
                        columns["offsets"] = pa.array([o for _, o in done], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = {"ids": "ids array<int>", "n_tokens": "n_tokens bigint", "offsets": "ids array<int>, offsets array<int>"}
    rows = df.select(df[id_column].cast("bigint").alias("doc_id"), df[text_column].cast("string").alias("text"))
    return rows.mapInArrow(encode, f"doc_id bigint, {kinds[output]}")
