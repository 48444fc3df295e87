"""Order-preserving packing of tokenised documents into sequences of a fixed length.

Documents keep their order.  The token stream of a partition is cut at document
ends, sentence ends or, inside very long sentences, on a grid; dynamic
programming picks the cuts that minimise padding plus a penalty for each document
cut in two.  cost(j) = penalty(j) + min over i within one sequence length of
cost(i) + padding, and as padding falls by one with every token, the minimum is
that of cost(i) + position(i) over a sliding window, which a monotone queue keeps.

Rules.  A null text is empty and has only the closing id.  Long documents are cut
into as many pieces as they need.  Rows that repeat an id are packed as they come.
A null id is carried as it is.  An empty table gives an empty table.  Extra columns are not read.  Partitions are
packed independently, without a shuffle; the last tokens of each go into
sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fileledger.llm.kernel import Slice, ragged, slices, substring_hashes

SEQUENCE = 1024
SENTENCE_CUT = 6.0
GRID_CUT = 16.0
GRID_GAP = 48
GRID_STEP = 16
BLOCK_TOKENS = 1 << 18
CACHE_MOST = 1 << 19
#: The pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_AFTER_SPACE = np.zeros(256, bool)
_AFTER_SPACE[0x21:0x80] = True
_AFTER_SPACE[0xC3:0xF5] = True
_AFTER_SPACE[[0xE1, 0xE2, 0xE3]] = False  # may begin a Unicode space


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids of whole texts under a byte-level BPE file.

    A text may be cut before any space that a non-space follows without changing
    its ids, so each distinct stretch between such places is encoded once and
    looked up again by hash.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        special = {t.content for t in self.full.get_added_tokens_decoder().values()}
        self.special = [s.encode() for s in special]
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.full.get_vocab(with_added_tokens=False).items() if token not in special}
        self.core = tiktoken.Encoding("core", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.ends_sentence = np.zeros(max(max(ranks.values()), *self.full.get_added_tokens_decoder()) + 1, bool)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
            self.ends_sentence[i] = re.search(rb"[.!?\n]", token) is not None
        self.forget()

    def forget(self) -> None:
        """Stretches met, as sorted hashes, and where in the flat array of ids those of each begin and how many they are."""
        self.keys, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encode(self, piece: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of a slice and their bounds."""
        data, bounds = piece.data, piece.bounds
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[: len(data) - 1] = (data[:-1] == 32) & _AFTER_SPACE[data[1:]]
        inner = bounds[1:-1]
        cut[inner[inner > 0] - 1] = False  # the byte after is another document's
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        start = np.flatnonzero(cut[: len(data)])
        end = np.append(start[1:], len(data))
        of, first, which = np.unique(substring_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(of) > CACHE_MOST:
            self.forget()
        place = np.searchsorted(self.keys, of)
        new = np.ones(len(of), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != of
        if new.any():
            ids, n = self._ids(data, start[first[new]], end[first[new]])
            keys, at = np.concatenate([self.keys, of[new]]), np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
            order = np.argsort(keys)
            self.keys, self.at, self.n = keys[order], at[order], np.concatenate([self.n, n.astype(np.int32)])[order]
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.keys, of)
        n = self.n[place][which].astype(np.int64)
        ids = self.flat[ragged(self.at[place][which], n)]
        before = np.concatenate([[0], np.cumsum(n)])
        return ids, before[np.searchsorted(start, bounds)]

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of data, one after another, and how many each has."""
        size = end - start
        plain = data[start] == 32
        text = data[ragged(start, size)].tobytes()
        if any(x in text for x in self.special):
            plain &= np.array([not any(x in data[s:e].tobytes() for x in self.special) for s, e in zip(start.tolist(), end.tolist())])
        n = np.zeros(len(start), np.int64)
        ids = np.array(self.core.encode_ordinary(data[ragged(start[plain], size[plain])].tobytes().decode()), np.uint32)
        reach = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        n[plain] = np.diff(np.searchsorted(reach, np.concatenate([[0], np.cumsum(size[plain])])))
        others = [self.full.encode(data[s:e].tobytes().decode(), add_special_tokens=False).ids for s, e in zip(start[~plain].tolist(), end[~plain].tolist())]
        n[~plain] = [len(x) for x in others]
        out = np.empty(int(n.sum()), np.uint32)
        of_plain = np.repeat(plain, n)
        out[of_plain] = ids
        out[~of_plain] = [i for x in others for i in x]
        return out, n


def choose_cuts(position: list[int], penalty: list[float], limit: int) -> list[int]:
    """Indices of the chosen cuts, the last one included.  Positions rise from above 0, by at most limit."""
    best, back = [0.0], [0]
    place = [0, *position]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(place)):
        here = place[j]
        while place[queue[0][1]] < here - limit:
            queue.popleft()
        least, i = queue[0]
        cost = least + limit - here + penalty[j - 1]
        best.append(cost)
        back.append(i)
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(place) - 1
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def cut_candidates(ids: np.ndarray, doc_end: np.ndarray, ends_sentence: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut (ascending, the end of the stream last) and their penalties."""
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[sentence] = SENTENCE_CUT
    penalty[doc_end] = 0.0
    penalty[-1] = min(penalty[-1], GRID_CUT)
    at = np.flatnonzero(penalty < np.inf)
    gap = np.diff(np.concatenate([[0], at]))
    wide = np.flatnonzero(gap > min(GRID_GAP, limit))
    if len(wide):
        step = min(GRID_STEP, limit)
        begin = np.concatenate([[0], at])[wide]
        n = (gap[wide] - 1) // step
        grid = np.repeat(begin, n) + step * (ragged(np.zeros(len(n), np.int64), n) + 1)
        penalty[grid] = GRID_CUT
        at = np.flatnonzero(penalty < np.inf)
    at = at[at > 0]
    return at, penalty[at]


def _tail(n: int, limit: int) -> list[int]:
    """Lengths for the last n tokens of a partition: whole sequences of a power of two, unless a padded one is nearly full."""
    out = []
    while n:
        if n >= limit:
            take = limit
        elif limit - n <= limit // 64:
            take = n
        else:
            take = 1 << (n.bit_length() - 1)
        out.append(take)
        n -= take
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SEQUENCE, closing_id: int = 0) -> DataFrame:
    """(id, start, length, ids binary of little-endian uint32, doc_tokens, sequence_id, offset): every piece of every document."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(tokenizer_path)
        number = TaskContext.get().partitionId() << 36
        held_ids, held_docs = np.zeros(0, np.uint32), np.zeros((0, 4), np.int64)  # id's row, tokens before, tokens here, tokens in all
        names: list = []

        def pieces(ids, docs, cuts):
            nonlocal number
            ends = np.cumsum(docs[:, 2])
            bounds = np.unique(np.concatenate([[0], ends, cuts]))
            begin, end = bounds[:-1], bounds[1:]
            doc = np.searchsorted(ends, begin, side="right")
            seq = np.searchsorted(cuts, begin, side="right")
            opens = np.concatenate([[0], cuts])[seq]
            raw = ids.astype("<u4").tobytes()
            rows = [pa.array([names[k] for k in docs[doc, 0].tolist()], pa.int64()), docs[doc, 1] + begin - (ends - docs[:, 2])[doc], end - begin, pa.array([raw[4 * s : 4 * e] for s, e in zip(begin.tolist(), end.tolist())], pa.binary()), docs[doc, 3], number + seq, begin - opens]
            number += len(cuts)
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in rows], schema=schema)

        def settle(last: bool):
            nonlocal held_ids, held_docs, names
            at, penalty = cut_candidates(held_ids, np.cumsum(held_docs[:, 2]), encoder.ends_sentence, limit)
            cuts = at[choose_cuts(at.tolist(), penalty.tolist(), limit)]
            done = int(cuts[-2]) if len(cuts) > 1 else 0
            cuts = cuts[:-1]
            if last:
                cuts = np.concatenate([cuts, done + np.cumsum(_tail(len(held_ids) - done, limit))]).astype(np.int64)
                done = len(held_ids)
            ends = np.cumsum(held_docs[:, 2])
            n = int(np.searchsorted(ends, done))
            now = held_docs[: n + 1].copy() if n < len(ends) else held_docs.copy()
            left = held_docs[n:].copy() if n < len(ends) else held_docs[:0]
            if n < len(ends):
                part = done - (ends[n] - held_docs[n, 2])
                now[-1, 2] = part
                left[0, 1] += part
                left[0, 2] -= part
                if not part:
                    now = now[:-1]
                if not left[0, 2]:
                    left = left[1:]
            out = pieces(held_ids[:done], now, cuts) if len(cuts) else None
            held_ids = held_ids[done:]
            names = [names[k] for k in left[:, 0].tolist()]
            left[:, 0] = np.arange(len(left))
            held_docs = left
            return out

        for b in batches:
            keys = b.column(0).to_pylist()
            for piece in slices(b.column(1)):
                ids, bounds = encoder.encode(piece)
                n = np.diff(bounds)
                # the closing id stands after each document's own
                stream = np.full(len(ids) + len(n), closing_id, np.uint32)
                stream[ragged(bounds[:-1] + np.arange(len(n)), n)] = ids
                tokens = n + 1
                docs_ = np.stack([np.arange(len(n)), np.zeros(len(n), np.int64), tokens, tokens], axis=1)
                ends, done, at = np.cumsum(tokens), 0, 0
                while at < len(n):
                    upto = min(len(n), max(at + 1, int(np.searchsorted(ends, done + BLOCK_TOKENS))))
                    new = docs_[at:upto].copy()
                    new[:, 0] += len(names) - at
                    names += keys[piece.first + at : piece.first + upto]
                    held_docs = np.concatenate([held_docs, new])
                    held_ids = np.concatenate([held_ids, stream[done : ends[upto - 1]]])
                    done, at = int(ends[upto - 1]), upto
                    if len(held_ids) >= BLOCK_TOKENS and (out := settle(False)) is not None:
                        yield out
        if len(held_ids) and (out := settle(True)) is not None:
            yield out

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
