"""Operator 1: vector bin packing of tokenised examples into fixed-length sequences.

An example is a list of token ids, some of which bear loss. A sequence holds at most
`tokens` tokens, `segments` pieces of examples and `loss` loss-bearing tokens. Pieces are
placed by the dot-product heuristic: of the waiting pieces that fit, the one whose demand
vector has the largest dot product with the sequence's remaining capacity (both scaled by
the limits) goes in. When none fits whole, the piece with the largest product is cut to
what fits, since examples may be cut anywhere. Examples longer than a sequence first give
off whole sequences.

Packing is local to a partition, so there is no shuffle, and streams: a bounded window of
pieces waits, one sequence is open. What a sequence lacks is never padded: a sequence that
ends short is dealt out over sequences whose lengths are powers of two, largest first.
Memory is one Arrow batch and the window, whose pieces hold at most WINDOW sequences' worth
of ids. sequence_id is unique over all partitions
(partition number, then a count) and depends on the partitioning of the input.

Cases: a null or empty text is an example with the end id alone; a null key stays null;
ties go to the piece that came first; repeated rows are packed each; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)
WINDOW = 256  # pieces that wait to be placed at most
_LOADED: dict[str, ByteTokenizer] = {}


class ByteTokenizer:
    """Byte-level BPE ids of the vocabulary in a tokenizers JSON file.

    Texts are encoded with the file's vocabulary by rank, which is how the tokenizers
    library merges too, but several times faster (tests hold both to the same ids). A text
    that holds the string of a special token goes to that library itself, and so does one
    that the quick way can't take (runs of a million blanks), and every text where the file
    asks for another way of cutting texts up.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = _shown_bytes()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {
            bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)").search
        # the fixed pattern of the kind ByteLevel
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        cut = spec.get("pre_tokenizer") or {}
        self.usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The uint32 ids of a text."""
        if self.usual and not self.special(text):
            try:
                return self.fast.encode_to_numpy(text)
            except ValueError:  # the pattern's matcher has a limit that long runs exceed
                pass
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)


def _shown_bytes() -> dict[str, int]:
    """The printable character by which byte-level vocabularies show each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def tokenizer(path: str) -> ByteTokenizer:
    """The tokeniser of a path, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


class Packer:
    """Packs the pieces of one partition.

    Items: (key, ids that are left, loss prefix sums or None, ids before, ids of the whole).
    """

    def __init__(self, tokens: int, segments: int, loss: int, first_id: int, window: int = WINDOW):
        self.limit = np.array([tokens, segments, loss], float)
        self.tokens, self.next_id = tokens, first_id
        self.size = window
        self.items: list = []
        self.demand = np.zeros((window + 1, 3))
        self.out: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.room = self.limit.copy()
        self.held: list[tuple] = []  # (item, from, to)

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None) -> None:
        """loss: whether each id bears loss; None if all do."""
        sums = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        at, n = 0, len(ids)
        while n - at >= self.tokens and self.limit[2] >= self._loss(sums, at, at + self.tokens):
            self._emit([((key, ids, sums, 0, n), at, at + self.tokens)])
            at += self.tokens
        if at < n:
            if at:  # what has been emitted needn't stay in memory
                self._wait((key, ids[at:].copy(), None if sums is None else sums[at:].copy(), at, n), 0, n - at)
            else:
                self._wait((key, ids, sums, 0, n), 0, n)
            while len(self.items) > self.size:
                self._place()

    @staticmethod
    def _loss(sums, a: int, b: int) -> int:
        return b - a if sums is None else int(sums[b] - sums[a])

    def _wait(self, item, at: int, end: int) -> None:
        k = len(self.items)
        if k == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.items.append((item, at, end))
        self.demand[k] = (end - at, 1, self._loss(item[2], at, end))

    def _take(self, k: int) -> tuple:
        got = self.items[k]
        last = len(self.items) - 1
        # keep the order of arrival, by which ties are decided
        self.items.pop(k)
        self.demand[k:last] = self.demand[k + 1 : last + 1]
        return got

    def _place(self) -> None:
        demand = self.demand[: len(self.items)]
        product = (demand / self.limit) @ (self.room / self.limit)
        fits = (demand <= self.room).all(axis=1)
        if fits.any():
            item, a, b = self._take(int(np.where(fits, product, -1).argmax()))
            self._hold(item, a, b)
        elif self.room[0] >= 1 and self.room[1] >= 1:
            k = int(product.argmax())
            item, a, b = self.items[k]
            cut = min(b, a + int(self.room[0]))
            while cut > a and self._loss(item[2], a, cut) > self.room[2]:
                # a binary search for the longest part within the limit on loss
                cut = a + int(np.searchsorted(item[2][a + 1 : cut + 1] - item[2][a], self.room[2], side="right"))
            if cut > a:
                self._hold(item, a, cut)
                self.items[k] = (item, cut, b)
                self.demand[k] = (b - cut, 1, self._loss(item[2], cut, b))
            else:
                self._close()
        else:
            self._close()

    def _hold(self, item, a: int, b: int) -> None:
        self.held.append((item, a, b))
        self.room -= (b - a, 1, self._loss(item[2], a, b))
        if self.room[0] < 1 or self.room[1] < 1:
            self._close()

    def _close(self) -> None:
        left = sum(b - a for _, a, b in self.held)
        rest = list(self.held)
        self._open()
        while left:  # a full sequence is one of these at once
            size = self.tokens if left == self.tokens else 1 << (left.bit_length() - 1)
            room, now = size, []
            while room:
                item, a, b = rest.pop(0)
                cut = min(b, a + room)
                now.append((item, a, cut))
                room -= cut - a
                if cut < b:
                    rest.insert(0, (item, cut, b))
            self._emit(now)
            left -= size

    def _emit(self, parts: list) -> None:
        offset = 0
        for (key, ids, sums, before, whole), a, b in parts:
            crc = zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes())
            self.out.append((key, before + a, b - a, crc, whole, self.next_id, offset, self._loss(sums, a, b)))
            offset += b - a
        self.next_id += 1

    def finish(self) -> None:
        while self.items:
            self._place()
        if self.held:
            self._close()


def pack(
    df: DataFrame,
    key: str,
    examples: str,
    encode: Callable[[object], tuple[np.ndarray, np.ndarray | None]],
    tokens: int = 1024,
    segments: int = 256,
    loss: int | None = None,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    encode(value of the column examples) gives the uint32 ids of an example and which of
    them bear loss (None: all).
    """
    if tokens < 1 or tokens & (tokens - 1):
        raise ValueError("the limit on tokens must be a power of two")
    if segments < 1 or (loss is not None and loss < 1):
        raise ValueError("a sequence must have room for a segment and a loss-bearing token")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(tokens, segments, tokens if loss is None else loss, TaskContext.get().partitionId() << 40)
        kind = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True))
            packer.out = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:]],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                for k, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(k, *encode(value))
                if packer.out:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, examples).mapInArrow(work, f"`{key}` {kind}, {SCHEMA}")


def pack_texts(df: DataFrame, key: str, text: str, path: str, end_id: int = 0, **limits) -> DataFrame:
    """pack() of whole texts, each followed by end_id; every token bears loss."""

    def encode(value):
        return np.append(tokenizer(path).encode(value or ""), np.uint32(end_id)), None

    return pack(df, key, text, encode, **limits)


def pack_turns(
    df: DataFrame, key: str, turns: str, path: str, end_id: int = 0, learn: tuple[str, ...] = ("assistant",), **limits
) -> DataFrame:
    """pack() of conversations: turns is an array of structs (role, text), in order.

    The tokens of the roles in `learn`, and the end id after each of their turns, bear loss.
    """

    def encode(value):
        ids, loss = [], []
        for turn in value or []:
            part = np.append(tokenizer(path).encode((turn or {}).get("text") or ""), np.uint32(end_id))
            ids.append(part)
            loss.append(np.full(len(part), (turn or {}).get("role") in learn))
        if not ids:
            return np.array([end_id], np.uint32), np.zeros(1, bool)
        return np.concatenate(ids), np.concatenate(loss)

    return pack(df, key, turns, encode, **limits)
