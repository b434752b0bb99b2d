"""Operator 10: SentencePiece encoding and decoding with a score-ordered agenda.

A merge-type vocabulary is applied as the agenda algorithm does it: all adjacent symbol
pairs whose joined form is a piece wait on a heap, best score first and leftmost first
among ties; popping a pair that is still current merges it and adds its new neighbours.
For short chunks the agendas of thousands of chunks are rows of one array.

No piece holds the space mark after another character, and some characters (line feeds,
tabs) are in no longer piece. Merges can't cross such places, so a text is cut there into
chunks whose segmentations are independent. A bounded memo per Python worker keeps
segmented chunks; the chunks that an Arrow batch adds are checked against the
sentencepiece library, and a difference fails the job.

Cases: null text counts as empty; an empty text has no ids but the end id; texts of any
length are processed whole, in memory proportional to one Arrow batch; repeated rows each
get their row; extra columns are kept by encode_column, whose outputs replace columns of
the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
MEMO = 400_000  # chunks that a worker remembers at most
_LOADED: dict[str, PieceModel] = {}


class PieceModel:
    """One vocabulary file: pieces, scores, byte pieces, and the memo of chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {v: k for k, v in self.bytes.items()}
        self.ids = {names[i]: i for i in range(n) if not special[i] and i not in self.byte_of}
        self.score = {names[i]: lib.get_score(i) for i in self.ids.values()}
        self.text_of = {i: p for p, i in self.ids.items()}
        self.hidden = {i for i in range(n) if special[i] and not lib.is_unknown(i)}
        self.unk, self.eos = lib.unk_id(), lib.eos_id()
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the space mark after another character")
        self.prefix = lib.encode("a", out_type=str)[0].startswith(MARK)
        alone = "".join(c for c in "\n\t\v\f" if c not in inner)
        a = re.escape(alone)
        self.chunks = re.compile(f"[{a}]| *[^ {a}]+| +" if alone else " *[^ ]+| +").findall
        self.memo: dict[str, tuple[int, str, str]] = {}
        self._pairs(inner)

    def _pairs(self, inner: set[str]) -> None:
        """Every pair of symbols whose joined form is a piece: sorted keys, rank, result."""
        self.symbol = dict(self.ids)
        for c in sorted(inner - self.ids.keys()):
            self.symbol[c] = len(self.text_of) + len(self.symbol) + 1_000_000
        self.width = max(self.symbol.values()) + 1
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        found = sorted(
            (self.symbol[p[:k]] * self.width + self.symbol[p[k:]], order[self.score[p]], i)
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.symbol and p[k:] in self.symbol
        )
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*found, strict=True))

    def _offers(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Positions in keys of pairs, or -1."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def segment_many(self, chunks: list[str]) -> list[list[int]]:
        """segment() of many short chunks at a time.

        Each row of an array is the agenda of one chunk: the ranks of its adjacent pairs.
        Every round pops the first smallest rank of each row, merges that pair, and offers
        the two pairs beside it.
        """
        out: list[list[int]] = [[]] * len(chunks)
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        none = np.int64(1 << 40)
        for start in range(0, len(order), 4096):
            part = order[start : start + 4096]
            if len(chunks[part[-1]]) > 64:
                for i in part:
                    out[i] = self.segment(chunks[i])
                continue
            width = len(chunks[part[-1]])
            points = np.frombuffer("".join(chunks[i].ljust(width, "\0") for i in part).encode("utf-32-le"), np.uint32)
            distinct, back = np.unique(points, return_inverse=True)
            # a character that is in no piece stands for itself, below -1
            known = np.array([self.symbol.get(chr(c), -2 - int(c)) for c in distinct], np.int64)
            grid = known[back].reshape(len(part), width)
            size = np.array([len(chunks[i]) for i in part])
            grid[np.arange(width)[None, :] >= size[:, None]] = -1
            offers = self._offers(grid[:, :-1], grid[:, 1:])
            rank = np.where(offers >= 0, self.ranks[offers], none)
            made = self.made[offers]
            rows = np.arange(len(part))
            done: dict[int, np.ndarray] = {}
            while len(rows):
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                top = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), none)
                over = top == none
                if over.any():
                    for r, g in zip(rows[over], grid[over], strict=True):
                        done[int(r)] = g
                    live = ~over
                    rows, grid, rank, made, best = rows[live], grid[live], rank[live], made[live], best[live]
                    if not len(rows):
                        break
                n = np.arange(len(rows))
                grid[n, best] = made[n, best]
                cols = np.arange(grid.shape[1] - 1)[None, :]
                grid = np.take_along_axis(grid, cols + (cols > best[:, None]), axis=1)
                cols = cols[:, :-1]
                keep = cols + (cols >= best[:, None])
                rank, made = np.take_along_axis(rank, keep, axis=1), np.take_along_axis(made, keep, axis=1)
                for side in (best - 1, best):
                    ok = (side >= 0) & (side < rank.shape[1])
                    r, c = n[ok], side[ok]
                    offers = self._offers(grid[r, c], grid[r, c + 1])
                    rank[r, c] = np.where(offers >= 0, self.ranks[offers], none)
                    made[r, c] = self.made[offers]
            for r, g in done.items():
                ids: list[int] = []
                for s in g.tolist():
                    if s == -1:
                        break
                    if 0 <= s < 1_000_000:
                        ids.append(s)
                    else:
                        new = self._outside(chr(-2 - s) if s < 0 else self._name(s))
                        # a run of unknown characters is one unknown piece
                        ids += new if self.bytes or ids[-1:] != new else []
                out[part[r]] = ids
        return out

    def _name(self, symbol: int) -> str:
        return next(c for c, s in self.symbol.items() if s == symbol)

    def _outside(self, text: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes[b] for b in text.encode("utf-8")] if self.bytes else [self.unk]

    def segment(self, symbols: str) -> list[int]:
        """The ids of a text whose spaces are marks, by the agenda; no memo, no library."""
        score = self.score
        part: list[str] = list(symbols)
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = part[i] + part[j]
            if (s := score.get(joined)) is not None:
                heapq.heappush(agenda, (-s, i, j, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            # stale unless both symbols are still what they were when the pair was offered
            if not part[i] or not part[j] or right[i] != j or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                offer(i, k)
            if left[i] >= 0:
                offer(left[i], i)
        out: list[int] = []
        for p in part:
            if p:
                i = self.ids.get(p)
                if i is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in p.encode("utf-8")]
                elif not out or out[-1] != self.unk:
                    out.append(self.unk)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces as UTF-8 (bad bytes one by one as U+FFFD)."""
        out: list[str] = []
        run = bytearray()
        first = self.prefix

        def flush() -> None:
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()

        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if i in self.hidden:
                continue
            flush()
            piece = " ⁇ " if i == self.unk else self.text_of[i].replace(MARK, " ")
            if first and piece.startswith(" ") and i != self.unk:
                piece = piece[1:]
            first = False
            out.append(piece)
        flush()
        return "".join(out)

    def _learn(self, new: list[str]) -> None:
        """Segments chunks and checks them, in one call, against the library."""
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        own = self.segment_many([c.replace(" ", MARK) for c in new])
        # The library puts a mark before each text: take one space off, or drop that mark
        # and a line feed that keeps it apart.
        kept = self.prefix
        asked = [c[1:] if kept and c[0] == " " else "\n" + c for c in new]
        skip = len(self.lib.encode("\n"))
        text_of = self.text_of
        said = self.lib.encode(asked, num_threads=1)
        for c, mine, theirs in zip(new, own, said, strict=True):
            # (a lone space: the library would be asked for the empty text)
            if not (c == " " and kept):
                theirs = theirs if kept and c[0] == " " else theirs[skip:]
            else:
                theirs = self.lib.encode("\n \n")[skip : 1 - skip]
            if mine != theirs:
                raise RuntimeError(f"{c!r} has the ids {mine}, but the sentencepiece library says {theirs}")
            try:
                shown = "".join([text_of[i] for i in mine])
            except KeyError:  # byte pieces
                shown = "".join(
                    _utf8(bytes(self.byte_of[i] for i in g)) if k else "".join(text_of.get(i, " ⁇ ") for i in g)
                    for k, g in _runs(mine, self.byte_of)
                )
            self.memo[c] = (len(mine), " ".join(map(str, mine)), shown.replace(MARK, " "))

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids (the end id too), and SHA-256 of ids and of their text."""
        cut = []
        for text in texts:
            if text and self.prefix:
                text = " " + text
            cut.append(self.chunks(text.replace(MARK, " ")))
        out = []
        start = 0
        while start < len(cut):  # a part of the batch at a time, to keep the memo bounded
            stop, size = start, 0
            while stop < len(cut) and (stop == start or size + len(cut[stop]) < MEMO // 2):
                size += len(cut[stop])
                stop += 1
            if new := {c for c in set().union(*cut[start:stop]) if c not in self.memo}:
                if len(self.memo) + len(new) > MEMO:
                    self.memo.clear()
                    new = set().union(*cut[start:stop])
                self._learn(sorted(new))
            get = self.memo.__getitem__
            for chunks in cut[start:stop]:
                got = list(map(get, chunks))
                ids = " ".join([g[1] for g in got] + [str(self.eos)])
                shown = "".join([g[2] for g in got])
                if self.prefix and got:
                    shown = shown[1:]
                out.append(
                    (
                        sum([g[0] for g in got]) + 1,
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(shown.encode()).hexdigest(),
                    )
                )
            start = stop
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of one text and the end id."""
        if text and self.prefix:
            text = " " + text
        chunks = self.chunks(text.replace(MARK, " "))
        if new := sorted(c for c in set(chunks) if c not in self.memo):
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = sorted(set(chunks))
            self._learn(new)
        return [int(i) for c in chunks for i in self.memo[c][1].split()] + [self.eos]


def _runs(ids: list[int], bytes_: dict[int, int]) -> Iterator[tuple[bool, list[int]]]:
    group: list[int] = []
    for i in ids:
        if group and (i in bytes_) != (group[-1] in bytes_):
            yield group[-1] in bytes_, group
            group = []
        group.append(i)
    if group:
        yield group[-1] in bytes_, group


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def model(path: str) -> PieceModel:
    """The model of a path, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode_column(df: DataFrame, text: str, path: str, out: str = "piece_ids") -> DataFrame:
    """Adds an array<int> column with the ids of each text and the end id."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):
        m = model(path)
        return texts.fillna("").map(m.encode)

    return df.withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, ids: str, path: str, out: str = "piece_text") -> DataFrame:
    """Adds a string column with the text of each array of ids; a null array gives null."""

    @F.pandas_udf(T.StringType())
    def texts(column):
        m = model(path)
        return column.map(lambda x: None if x is None else m.decode([int(i) for i in x]))

    return df.withColumn(out, texts(F.col(ids)))


def digest_pieces(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row's whole text; no shuffle."""

    def work(batches):
        m = model(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            got = m.digest(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([g[1] for g in got], pa.string()),
                    pa.array([g[2] for g in got], pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(
        work, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
