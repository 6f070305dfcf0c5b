"""Adaptive context-mixing range coder for token ids, on many blocks side by side.

Within a block an id is predicted by its last two ids (order 2) and by its last one
(order 1). A first symbol says which prediction holds, if any, from adaptive chances in
the context of both predictions' confidence. Other ids are coded in nibbles, each from an
adaptive distribution in the context of the nibbles before it (order 0), the first nibble
from the mean of that and of a distribution in the context of the id before (order 1).
The chances drive a carryless range coder with a 64-bit low and 32-bit words.

Every block starts from the same state and has its own checksum, so each can be read
alone. Blocks are coded in lockstep, one numpy lane each; all arithmetic is on integers,
so a block's bytes do not depend on its neighbours.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 14
ONE = 1 << BITS
ORDER2, ORDER1, MIXED = 1 << 11, 1 << 10, 64      # slots of the predictions and of the mixed first nibble
RATE = 4
_TOP = np.uint64(1) << np.uint64(32)
_MASK = _TOP - np.uint64(1)
_HALF = np.uint64(32)
_EDGES = (np.arange(17) * (ONE // 16)).astype(np.int16)
_PULL = np.where(np.arange(17) <= np.arange(16)[:, None], np.arange(17) * 8,
                 ONE - (16 - np.arange(17)) * 8).astype(np.int16)
_PULL3 = np.array([[0, ONE - 64, ONE - 32, ONE], [0, 32, ONE - 32, ONE], [0, 32, 64, ONE]], np.int16)


class _Model:
    """State of all lanes; ``digits`` nibbles make an id."""

    def __init__(self, lanes: int, digits: int):
        self.lanes, self.digits = lanes, digits
        self.guess2, self.sure2 = np.zeros(lanes * ORDER2, np.int32), np.zeros(lanes * ORDER2, np.int8)
        self.guess1, self.sure1 = np.zeros(lanes * ORDER1, np.int32), np.zeros(lanes * ORDER1, np.int8)
        self.which = np.tile(np.array([0, ONE // 3, 2 * ONE // 3, ONE], np.int16), (lanes * 32, 1))
        self.contexts = 1 + 16 + 256 + 64 * max(0, digits - 3)
        self.nibble = np.tile(_EDGES, (lanes * self.contexts, 1))
        self.mixed = np.tile(_EDGES, (lanes * MIXED, 1))
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        lane = np.arange(n)
        last, before = self.last[:n], self.before[:n]
        at2 = lane * ORDER2 + (((before * 40503 + last * 60493) >> 4) & (ORDER2 - 1))
        at1 = lane * ORDER1 + (((last * 40503) >> 4) & (ORDER1 - 1))
        g2, g1 = self.guess2[at2], self.guess1[at1]
        context = lane * 32 + self.sure2[at2] * 4 + self.sure1[at1] + 16 * (g1 == g2)
        return at2, at1, g2, g1, context

    def learn(self, n: int, at2: np.ndarray, at1: np.ndarray, g2: np.ndarray, g1: np.ndarray, ids: np.ndarray) -> None:
        for at, guess, table, sure in ((at2, g2, self.guess2, self.sure2), (at1, g1, self.guess1, self.sure1)):
            s, hit = sure[at], guess == ids
            table[at] = np.where(hit | (s > 0), guess, ids)
            sure[at] = np.where(hit, np.minimum(s + 1, 3), np.maximum(s - 1, 0))
        self.before[:n] = self.last[:n]
        self.last[:n] = ids

    def place(self, lane: np.ndarray, digit: int, sofar: np.ndarray) -> np.ndarray:
        if digit < 3:
            return lane * self.contexts + (0, 1, 17)[digit] + sofar
        return lane * self.contexts + 273 + 64 * (digit - 3) + (sofar & 63)

    def chances(self, lane: np.ndarray, digit: int, at: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(edges of each lane's distribution, what ``adapt`` needs)."""
        own = self.nibble.take(at, 0)
        if digit:
            return own, ((self.nibble, at, own),)
        mix = lane * MIXED + (((self.last[lane] * 48271) >> 5) & (MIXED - 1))
        other = self.mixed.take(mix, 0)
        return (own + other) >> 1, ((self.nibble, at, own), (self.mixed, mix, other))

    @staticmethod
    def adapt(used: tuple, symbol: np.ndarray) -> None:
        pull = _PULL.take(symbol, 0)
        for table, where, row in used:
            table[where] = row + ((pull - row) >> RATE)

    def adapt3(self, at: np.ndarray, row: np.ndarray, symbol: np.ndarray) -> None:
        self.which[at] = row + ((_PULL3.take(symbol, 0) - row) >> RATE)


def _edges(rows: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.ravel()
    at = np.arange(0, len(flat), rows.shape[1]) + symbol
    low = flat.take(at)
    return low.astype(np.uint64), (flat.take(at + 1) - low).astype(np.uint64)


class _Encoder:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0), np.uint64)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, lane: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        step = self.range[lane] >> np.uint64(BITS)
        low, width = self.low[lane] + step * start, step * size
        while True:
            top = low >> _HALF
            settled = top == (low + width) >> _HALF
            move = np.flatnonzero(settled | (width < _TOP))
            if not len(move):
                break
            gone, rest = low[move], width[move]
            rest = np.where(settled[move], rest, (~gone + np.uint64(1)) & _MASK)
            self.out.append((move if isinstance(lane, slice) else lane[move], top[move].astype(np.uint32)))
            low[move] = gone << _HALF
            width[move] = rest << _HALF
        self.low[lane], self.range[lane] = low, width

    def close(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(2):
            self.out.append((every, (self.low >> _HALF).astype(np.uint32)))
            self.low <<= _HALF
        lane = np.concatenate([o[0] for o in self.out])
        words = np.concatenate([o[1] for o in self.out])
        order = np.argsort(lane, kind="stable")
        ends = np.cumsum(np.bincount(lane, minlength=len(every)))
        flat = words[order].astype("<u4")
        return [flat[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


class _Decoder:
    def __init__(self, blocks: list[bytes]):
        size = np.array([len(b) // 4 for b in blocks], np.int64)
        self.words = np.concatenate([np.frombuffer(b"".join(blocks), "<u4"), np.zeros(4, np.uint32)]).astype(np.uint64)
        self.at = np.cumsum(size) - size
        n = len(blocks)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0), np.uint64)
        self.code = (self.words[self.at] << _HALF) | self.words[self.at + 1]
        self.at = self.at + 2

    def get(self, lane: np.ndarray | slice, rows: np.ndarray) -> np.ndarray:
        """The symbol of each lane whose chances are ``rows``; the coder moves past it."""
        step = self.range[lane] >> np.uint64(BITS)
        value = np.minimum((self.code[lane] - self.low[lane]) // step, np.uint64(ONE - 1)).astype(np.int64)
        symbol = (rows[:, 1:-1] <= value[:, None]).sum(1)
        start, size = _edges(rows, symbol)
        low, width, code = self.low[lane] + step * start, step * size, self.code[lane].copy()
        while True:
            settled = low >> _HALF == (low + width) >> _HALF
            move = np.flatnonzero(settled | (width < _TOP))
            if not len(move):
                break
            gone, rest = low[move], width[move]
            rest = np.where(settled[move], rest, (~gone + np.uint64(1)) & _MASK)
            low[move] = gone << _HALF
            width[move] = rest << _HALF
            who = move if isinstance(lane, slice) else lane[move]
            code[move] = (code[move] << _HALF) | self.words[np.minimum(self.at[who], len(self.words) - 1)]
            self.at[who] += 1
        self.low[lane], self.range[lane], self.code[lane] = low, width, code
        return symbol


def _lockstep(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of lanes, longest first; number of lanes still active at each step)."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    return order, np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")


def digits_for(top: int) -> int:
    return max(3, -(-int(top).bit_length() // 4))


def encode_blocks(blocks: list[np.ndarray], digits: int) -> list[bytes]:
    """The coded bytes of every block of ids below 16 ** digits."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks])
    order, active = _lockstep(sizes)
    grid = np.zeros((len(active), len(blocks)), np.int64)
    for lane, k in enumerate(order.tolist()):
        grid[:sizes[k], lane] = blocks[k]
    model, coder = _Model(len(blocks), digits), _Encoder(len(blocks))
    for t, n in enumerate(active.tolist()):
        ids = grid[t, :n]
        at2, at1, g2, g1, context = model.predict(n)
        symbol = np.where(ids == g2, 0, np.where(ids == g1, 1, 2))
        rows = model.which.take(context, 0)
        coder.put(slice(0, n), *_edges(rows, symbol))
        model.adapt3(context, rows, symbol)
        lane = np.flatnonzero(symbol == 2)
        if len(lane):
            own = ids[lane]
            for d in range(digits):
                sofar = own >> (4 * (digits - d))
                nibble = (own >> (4 * (digits - d - 1))) & 15
                at = model.place(lane, d, sofar)
                rows, used = model.chances(lane, d, at)
                coder.put(lane, *_edges(rows, nibble))
                model.adapt(used, nibble)
        model.learn(n, at2, at1, g2, g1, ids)
    coded = coder.close()
    out = [b""] * len(blocks)
    for lane, k in enumerate(order.tolist()):
        out[k] = coded[lane]
    return out


def decode_blocks(blocks: list[bytes], sizes: np.ndarray, digits: int) -> list[np.ndarray]:
    """The ids of every coded block, ``sizes`` many each."""
    if not blocks:
        return []
    order, active = _lockstep(sizes)
    model, coder = _Model(len(blocks), digits), _Decoder([blocks[k] for k in order.tolist()])
    grid = np.zeros((len(active), len(blocks)), np.uint32)
    for t, n in enumerate(active.tolist()):
        at2, at1, g2, g1, context = model.predict(n)
        rows = model.which.take(context, 0)
        symbol = coder.get(slice(0, n), rows)
        model.adapt3(context, rows, symbol)
        ids = np.where(symbol == 0, g2, g1).astype(np.int64)
        lane = np.flatnonzero(symbol == 2)
        if len(lane):
            own = np.zeros(len(lane), np.int64)
            for d in range(digits):
                at = model.place(lane, d, own)
                rows, used = model.chances(lane, d, at)
                nibble = coder.get(lane, rows)
                model.adapt(used, nibble)
                own = own << 4 | nibble
            ids[lane] = own
        model.learn(n, at2, at1, g2, g1, ids)
        grid[t, :n] = ids
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for lane, k in enumerate(order.tolist()):
        out[k] = grid[:sizes[k], lane]
    return out


# A segment: magic, then these numbers as little-endian unsigned 32-bit: digits, documents,
# blocks, bytes of the packed directory, its crc32; the directory (zlib) with the doc_ids
# (8 bytes), their null flags (1 byte) and token counts (4 bytes); per block its tokens, bytes and
# crc32 of its ids as little-endian 32-bit; the blocks.
MAGIC = b"FLIDS1\0\0"


def write_segments(parts: list[tuple[list[int | None], np.ndarray, np.ndarray]], block: int = 4096) -> list[bytes]:
    """Segments of (doc_ids, tokens per document, ids); all their blocks are coded together."""
    cut, counts, tops = [], [], []
    for _, _, ids in parts:
        own = [ids[k:k + block] for k in range(0, len(ids), block)]
        cut += own
        counts.append(len(own))
        tops.append(int(ids.max(initial=0)))
    digits = digits_for(max(tops, default=0))
    coded, at, out = encode_blocks(cut, digits), 0, []
    for (docs, sizes, _), n in zip(parts, counts):
        directory = zlib.compress(np.array([d or 0 for d in docs], "<i8").tobytes()
                                  + np.array([d is None for d in docs], np.uint8).tobytes()
                                  + np.asarray(sizes, "<u4").tobytes(), 1)
        head = np.array([digits, len(docs), n, len(directory), zlib.crc32(directory)], "<u4").tobytes()
        table = np.array([(len(cut[k]), len(coded[k]), zlib.crc32(cut[k].astype("<u4"))) for k in range(at, at + n)],
                         "<u4").tobytes()
        out.append(MAGIC + head + directory + table + b"".join(coded[at:at + n]))
        at += n
    return out


def read_segments(segments: list[bytes]) -> list[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """What ``write_segments`` was given; a damaged segment raises."""
    heads, blocks, sizes, sums = [], [], [], []
    for data in segments:
        if data[:8] != MAGIC:
            raise ValueError("not a segment of token ids")
        digits, docs, n, long, check = np.frombuffer(data, "<u4", 5, 8).tolist()
        packed = data[28:28 + long]
        if zlib.crc32(packed) != check:
            raise ValueError("the directory of a segment is damaged")
        raw = zlib.decompress(packed)
        ids = np.frombuffer(raw, "<i8", docs).tolist()
        null = np.frombuffer(raw, np.uint8, docs, 8 * docs)
        table = np.frombuffer(data, "<u4", 3 * n, 28 + long).reshape(n, 3)
        at = 28 + long + 12 * n
        for size, length, crc in table.tolist():
            blocks.append((digits, data[at:at + length]))
            sizes.append(size)
            sums.append(crc)
            at += length
        heads.append(([None if x else d for d, x in zip(ids, null)], np.frombuffer(raw, "<u4", docs, 9 * docs), n))
    decoded: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for digits in {d for d, _ in blocks}:
        own = [k for k, (d, _) in enumerate(blocks) if d == digits]
        for k, ids in zip(own, decode_blocks([blocks[k][1] for k in own], np.array([sizes[k] for k in own]), digits)):
            decoded[k] = ids
    for ids, crc in zip(decoded, sums):
        if zlib.crc32(ids.astype("<u4")) != crc:
            raise ValueError("a block of a segment is damaged")
    out, at = [], 0
    for docs, size, n in heads:
        out.append((docs, size.astype(np.int64), np.concatenate(decoded[at:at + n]) if n else np.zeros(0, np.uint32)))
        at += n
    return out
