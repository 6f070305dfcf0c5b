"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when every two neighbours
are what BPE makes of the pair. That gives a nondeterministic transducer: read bytes
down the trie of tokens, and at a token's end start the next one if the pair holds.
``MergeTransducer`` determinises it while it reads: a state is the set of open readings,
each with the tokens it has not emitted yet, and what all readings agree on is emitted at
once. A reading stays open for at most the longest token's bytes, so the lookahead is
bounded. States and arcs are built when first needed and kept.

Defined cases: a null or empty text has no ids; repeated rows are encoded each; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.chunks import RunEncoder
from feedlens.llm.common import ragged, slices, utf8


NONE = 1 << 60                 # above every rank: no such merge


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines) if word}


class MergeTransducer:
    """``encode(piece)`` gives the ids that merging by rank gives."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 250_000):
        self.ranks, self.max_states = ranks, max_states
        self.words = {i: w for w, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple[list, list] | None] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.final: list[tuple[int, ...]] = [()]
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def steps(self, token: int) -> tuple[list, list] | None:
        """How BPE by its definition makes a token's word: its (rank, first part) and its
        (rank, last part) after each merge in turn; None if it makes something else."""
        if token not in self.made:
            word = self.words[token]
            parts = [word[i:i + 1] for i in range(len(word))]
            first, last = [(-1, parts[0])], [(-1, parts[-1])]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NONE:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                first.append((rank, parts[0]))
                last.append((rank, parts[-1]))
            self.made[token] = (first, last) if len(parts) == 1 else None
        return self.made[token]

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge joins the words of tokens a and b, which BPE makes.

        Until one does, either word merges as it does alone, the lower rank of both first
        and the left one on a tie."""
        left, right = self.steps(a)[1], self.steps(b)[0]
        i = j = 0
        while True:
            across = self.ranks.get(left[i][1] + right[j][1], NONE)
            in_left = left[i + 1][0] if i + 1 < len(left) else NONE
            in_right = right[j + 1][0] if j + 1 < len(right) else NONE
            if across < in_left and across <= in_right and across < NONE:
                return False
            if in_left == in_right == NONE:
                return True
            if in_left <= in_right:
                i += 1
            else:
                j += 1

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE keeps tokens a, b as they are (a = -1: whether it makes b at all)."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.steps(b) is not None and (a < 0 or self._apart(a, b))
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The arc of ``state`` on ``byte``: next state, tokens emitted on it."""
        readings = []
        for last, node, held in self.states[state]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            if self.child[node]:
                readings.append((last, node, held))
            token = self.token[node]
            if token >= 0 and self.follows(last, token):
                readings.append((token, 0, (*held, token)))
        first, *rest = [held for _, _, held in readings]
        n = len(first)
        for held in rest:
            n = min(n, len(held))
            while first[:n] != held[:n]:
                n -= 1
        key = tuple((last, node, held[n:]) for last, node, held in readings)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.final.append(next((held for _, node, held in key if node == 0), ()))
        arc = self.arcs[state << 8 | byte] = (to, first[:n])
        return arc

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        state, arcs = 0, self.arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte) or self._arc(state, byte)
            state, emitted = arc
            if emitted:
                out += emitted
        out += self.final[state]
        return out


def run_encoder(path: str, pattern: str) -> RunEncoder:
    """Runs of a text are cut by ``pattern``, each match read by one transducer."""
    import regex

    machine, find = MergeTransducer(read_ranks(path)), regex.compile(pattern).findall

    def distinct(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        size = np.empty(len(runs), np.int64)
        encode = machine.encode
        for k, run in enumerate(runs):
            before = len(flat)
            for piece in find(run.decode()):
                flat += encode(piece.encode())
            size[k] = len(flat) - before
        return np.array(flat, np.uint32), size

    return RunEncoder(distinct, limit=600_000)


def _utf8_table() -> np.ndarray:
    """Next state by (state, byte). States: 0 between characters, 1 to 3 that many plain
    continuation bytes to come, 4 to 7 the lead bytes whose next byte has a narrower
    range, 8 an error."""
    to = np.full((9, 256), 8, np.uint8)
    to[0, 0x00:0x80] = 0
    to[0, 0xC2:0xE0] = 1
    to[0, 0xE1:0xF0] = 2
    to[0, 0xF1:0xF4] = 3
    to[0, [0xE0, 0xED, 0xF0, 0xF4]] = [4, 5, 6, 7]
    for state in (1, 2, 3):
        to[state, 0x80:0xC0] = state - 1
    to[4, 0xA0:0xC0] = 1
    to[5, 0x80:0xA0] = 1
    to[6, 0x90:0xC0] = 2
    to[7, 0x80:0x90] = 2
    return to


UTF8_NEXT = _utf8_table()


class StreamDecoder:
    """Ids to text in any portions: bytes of an unfinished character wait for the next.

    ``feed`` returns the text that is complete so far; ``close`` gives U+FFFD for a
    character that never ended. Bytes that are no UTF-8 become U+FFFD too.
    """

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values(), default=-1) + 1
        words = [b""] * top
        for word, i in ranks.items():
            words[i] = word
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(words), np.uint8)
        self.waiting = b""

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.start[ids], self.size[ids])]

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        lead = next((k for k in range(1, min(4, len(data)) + 1) if data[-k] & 0xC0 != 0x80), 0)
        state = 0
        for byte in data[len(data) - lead:] if lead else b"":
            state = UTF8_NEXT[state, byte]
        cut = len(data) - lead if 0 < state < 8 else len(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


_MADE: dict[tuple, tuple] = {}


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, portion: int = 1 << 16,
                  with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``) of every text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, pattern)
        if key not in _MADE:
            _MADE[key] = run_encoder(vocabulary, pattern), StreamDecoder(read_ranks(vocabulary))
        runs, decoder = _MADE[key]
        for batch in slices(batches):
            ids, off = runs.texts(*utf8(batch.column("text")))
            ids = ids.astype("<u4")
            data = decoder.bytes_of(ids)
            ends = np.concatenate([[0], np.cumsum(decoder.size[ids])])[off]
            sha, back, full = [], [], []
            for d in range(batch.num_rows):
                sha.append(hashlib.sha256(ids[off[d]:off[d + 1]]).hexdigest())
                digest = hashlib.sha256()
                for k in range(ends[d], ends[d + 1], portion):
                    digest.update(decoder.feed(data[k:min(k + portion, ends[d + 1])].tobytes()).encode())
                digest.update(decoder.close().encode())
                back.append(digest.hexdigest())
                if with_ids:
                    full.append(ids[off[d]:off[d + 1]].astype(np.int32))
            out = [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(sha), pa.array(back)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(full, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
