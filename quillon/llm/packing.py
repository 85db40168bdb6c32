"""Packing of token sequences by non-negative least squares on a length histogram.

Each partition of documents is packed by itself, so nothing is shuffled and a
lost executor costs its own partitions only. Documents are cut into full
windows; what is left of each (a tail) goes to a pool. A full pool is packed
thus: tails are counted by length class, all combinations of at most three
classes that fill the window exactly are listed, non-negative least squares
gives how often each should repeat so that the histogram is used up, and the
counts are rounded down. Tails that no combination takes are packed greedily,
longest first. The few tokens by which the tails of a sequence fall short of
their classes are filled by cutting a residual tail. The last, unfilled tails of
a partition become sequences whose lengths are powers of two, so that no
sequence needs padding.

Nulls: a null text is empty; a null id is kept. An empty text has only the end
token and so one piece. Empty table: no rows. Repeated rows are packed as often
as they occur. Extra columns are ignored. Very long texts are tokenized in
sections cut where the tokenizer cannot join across the cut.
"""

from __future__ import annotations

import functools
import itertools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillon.llm.common import bounded

WINDOW = 2048
CLASSES = 64
POOL = 4096
#: Ids that are handed to the engine at a time: a megabyte.
HANDED = 1 << 18
#: Pieces that a task holds before it hands them on.
HELD = 256
END_ID = 1
SECTION = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_ENCODERS: dict = {}


def byte_level_encoder(path: str, added: bool = False):
    """text -> uint32 ids, for a byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary and pattern are run by ``tiktoken``, which gives the
    same ids (the order of ids is the order of merges) several times as fast.
    With ``added`` the file's added tokens are single ids wherever they occur, as
    the library has it by default; else they are text like any other.
    """
    if (path, added) not in _ENCODERS:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = {x["content"]: x["id"] for x in described["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in described["model"]["vocab"].items() if piece not in special}
        _ENCODERS[path, added] = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
    encoding = _ENCODERS[path, added]

    def encode(text: str) -> np.ndarray:
        if len(text) <= SECTION:
            return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.concatenate([encoding.encode_to_numpy(x, allowed_special="all", disallowed_special=()) for x in sections(text)])

    return encode


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """Parts of about ``size`` characters, cut before a single space between
    letters, where every split of the tokenizer's pattern has a border too and
    no added token (they hold no space) is cut."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache
def combinations(classes: int) -> tuple[tuple[int, ...], ...]:
    """Ascending tuples of at most three classes 1..classes whose sum is ``classes``."""
    return tuple(c for k in (1, 2, 3) for head in itertools.combinations_with_replacement(range(1, classes + 1), k - 1)
                 if (last := classes - sum(head)) >= max([1, *head]) for c in [(*head, last)])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| smallest, by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    gram, target = a.T @ a, a.T @ b
    for _ in range(rounds):
        slope = np.where(passive, -np.inf, target - gram @ x)
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, np.abs(target).max()):
            break
        passive[best] = True
        while True:
            on = np.flatnonzero(passive)
            trial = np.zeros(n)
            trial[on] = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=None)[0]
            if trial[on].min() > 0:
                x = trial
                break
            short = on[trial[on] <= 0]
            step = np.min(x[short] / np.maximum(x[short] - trial[short], 1e-300))
            x = x + step * (trial - x)
            x[short[x[short] <= 1e-12]] = 0
            passive &= x > 0
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of classes with their repeat counts, never above what the
    histogram holds. Long tails weigh more: they are the hardest to place."""
    classes = len(histogram) - 1
    combos = combinations(classes)
    uses = np.zeros((classes + 1, len(combos)))
    for j, c in enumerate(combos):
        np.add.at(uses[:, j], list(c), 1)
    weight = np.sqrt(np.arange(classes + 1) + 1.0)[:, None]
    counts = np.floor(nnls(uses * weight, histogram * weight[:, 0]) + 1e-6).astype(int)
    left, out = histogram.astype(int).copy(), []
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] <= 0:
            break
        times = int(min(counts[j], *(left[c] // combos[j].count(c) for c in set(combos[j]))))
        if times > 0:
            left -= (uses[:, j] * times).astype(int)
            out.append((combos[j], times))
    return out


class Packer:
    """Collects tails and emits pieces; one for each partition."""

    def __init__(self, base: int, window: int = WINDOW, classes: int = CLASSES, pool: int = POOL):
        self.base, self.window, self.classes, self.pool = base, window, classes, pool
        self.unit = -(-window // classes)
        self.next, self.tails, self.out = 0, [], deque()

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        for start in range(0, n - self.window + 1, self.window):
            self._sequence([(doc_id, start, ids[start:start + self.window], n)])
        if n % self.window:
            start = n - n % self.window
            self.tails.append((doc_id, start, ids[start:].copy(), n))
        if len(self.tails) >= self.pool:
            self._pack(last=False)

    def _sequence(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.out.append((doc_id, start, ids, n, self.base + self.next, offset))
            offset += len(ids)
        self.next += 1

    def _pack(self, last: bool) -> None:
        by_class: list[deque] = [deque() for _ in range(self.classes + 1)]
        for tail in self.tails:
            by_class[-(-len(tail[2]) // self.unit)].append(tail)
        started = []
        for combo, times in plan(np.array([len(x) for x in by_class])):
            started += [[by_class[c].popleft() for c in combo] for _ in range(times)]
        residual = deque(sorted((t for x in by_class for t in x), key=lambda t: -len(t[2])))
        for pieces in started:
            self._fill(pieces, residual)
        while residual and sum(len(t[2]) for t in residual) >= self.window:
            self._fill([residual.popleft()], residual)
        self.tails = list(residual)
        while last and self.tails:
            whole = sum(len(t[2]) for t in self.tails)
            room, pieces, rest = 1 << (whole.bit_length() - 1), [], deque(self.tails)
            self._take(pieces, rest, min(room, self.window))
            self._sequence(pieces)
            self.tails = list(rest)

    def _fill(self, pieces: list, residual: deque) -> None:
        """First whole residual tails that fit, longest first, then a cut one."""
        room = self.window - sum(len(t[2]) for t in pieces)
        if room > 4 * self.unit:
            for _ in range(min(len(residual), 64)):
                if len(residual[0][2]) <= room:
                    room -= len(residual[0][2])
                    pieces.append(residual.popleft())
                else:
                    residual.rotate(-1)
        self._take(pieces, residual, room)
        if room and not residual and sum(len(t[2]) for t in pieces) < self.window:
            residual.extend(pieces)  # nothing is left to fill it with: it waits
            return
        self._sequence(pieces)

    @staticmethod
    def _take(pieces: list, source: deque, room: int) -> None:
        while room and source:
            doc_id, start, ids, n = source.pop()
            if len(ids) > room:
                source.append((doc_id, start + room, ids[room:], n))
                ids = ids[:room]
            pieces.append((doc_id, start, ids, n))
            room -= len(ids)

    def drain(self, last: bool = False) -> Iterator[list[tuple]]:
        """The pieces so far, in lists of about HANDED ids. A piece's bytes are made
        with its list, so that a full pool that is packed at once is not held twice."""
        if last:
            self._pack(last=True)
        while self.out:
            out, held = [], 0
            while self.out and held < HANDED:
                doc_id, start, ids, n, sequence, offset = self.out.popleft()
                out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, sequence, offset))
                held += len(ids)
            yield out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, classes: int = CLASSES, pool: int = POOL, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32),
    doc_tokens (with the end token), sequence_id, offset.

    ``tokenizer`` is the path of a byte-level BPE file, which must exist on
    every worker. ``pool`` bounds the tails that a task holds at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_level_encoder(tokenizer, added=True)
        packer = Packer(TaskContext.get().partitionId() << 40, window, classes, pool)
        end = np.array([end_id], dtype=np.uint32)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            return out.astype({"doc_id": "Int64"})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                packer.add(doc_id, np.concatenate([encode(text), end]) if text else end)
                if len(packer.out) >= HELD:
                    yield from map(frame, packer.drain())
        yield from map(frame, packer.drain(last=True))

    return bounded(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)
