"""Texts as runs that byte-pair tokenizers never merge across, and a cache over them.

The public vocabularies split a text before any merge happens. White space decides most
of that split, in the same way wherever the run stands: a run of other characters takes
the one space before it, the rest of the white space stands alone. Punctuation after a
letter or digit begins a run too. So a text's ids are the ids of its runs in a row, and
each distinct run is encoded once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from feedlens.llm.common import ragged

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*b"0123456789", *range(65, 91), *range(97, 123)]] = True
# Punctuation that always begins a new piece after a letter or digit: all but the
# apostrophe, which may begin a contraction.
_CLOSING = np.zeros(256, bool)
_CLOSING[[c for c in range(33, 127) if not _ASCII_WORD[c] and c != 39]] = True
# UTF-8 forms of the other White_Space characters (fixed by Unicode).
_WIDE_SPACE = [chr(c).encode() for c in (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _wide(buf: np.ndarray, size: int) -> np.ndarray:
    """Offsets of wide white space of ``size`` bytes."""
    forms = [f for f in _WIDE_SPACE if len(f) == size]
    leads = np.zeros(256, bool)
    leads[[f[0] for f in forms]] = True
    at = np.flatnonzero(leads[buf])
    code = np.zeros(len(at), np.int64)
    for k in range(size):
        code = code << 8 | buf[at + k]
    return at[np.isin(code, [int.from_bytes(f) for f in forms])]


def space_mask(buf: np.ndarray) -> np.ndarray:
    """True at every byte of a Unicode white-space character."""
    mask = _ASCII_SPACE[buf]
    for size in (2, 3):
        at = _wide(buf, size)
        for k in range(size):
            mask[at + k] = True
    return mask


def run_starts(buf: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Sorted start offsets of all runs; ``docs`` are the texts' offsets (one more than texts)."""
    n = len(buf)
    mark = np.zeros(n + 1, bool)
    mark[docs] = True
    first = mark.copy()
    space = space_mask(buf)
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = space[:-1]
    before[first[:n]] = False
    words = np.flatnonzero(~space & before)          # a word after white space of its text
    last = words - 1
    by_space = buf[last] == 32
    mark[last[by_space]] = True
    words, last = words[~by_space], last[~by_space]
    mark[words] = True
    for _ in range(2):                               # to the first byte of that character
        last = last - ((buf[last] & 0xC0) == 0x80)
    mark[last] = True
    gaps = np.empty(n, bool)
    gaps[:1] = False
    gaps[1:] = ~space[:-1]
    mark[np.flatnonzero(space & gaps)] = True
    mark[np.flatnonzero(_CLOSING[buf[1:]] & _ASCII_WORD[buf[:-1]]) + 1] = True
    mark[n] = False
    return np.flatnonzero(mark)


class RunEncoder:
    """ids of texts, from an encoder of distinct runs.

    ``encode`` maps a list of byte strings to (their ids in a row, how many each has).
    About ``limit`` distinct runs are remembered; then those met once make room (results
    do not change).
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
                 limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)             # slices that held the run

    def _forget(self) -> None:
        keep = np.flatnonzero(self.met > 1)
        if 2 * len(keep) > self.limit:
            keep = keep[:0]
        names = list(self.known)
        self.known = {names[k]: at for at, k in enumerate(keep.tolist())}
        self.pool = self.pool[ragged(self.start[keep], self.size[keep])]
        self.size = self.size[keep]
        self.start = np.cumsum(self.size) - self.size
        self.met = np.ones(len(keep), np.int32)

    def _learn(self, runs: list[bytes]) -> None:
        flat, size = self.encode(runs)
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, flat])
        self.met = np.concatenate([self.met, np.zeros(len(runs), np.int32)])

    def texts(self, buf: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's ids)."""
        starts = run_starts(buf, docs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
        off = np.append(starts, len(buf)).astype(np.int64)
        runs = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(buf)])
        coded = runs.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > self.limit:
            self._forget()
        entry = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = len(self.known) + np.arange(len(new))
            self._learn([distinct[k] for k in new.tolist()])
        self.met[entry] += 1
        entry = entry[coded.indices.to_numpy()]
        size = self.size[entry]
        ids = self.pool[ragged(self.start[entry], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[np.searchsorted(starts, docs)]


# Letters that no normal form changes and that lower-case one to one.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_PLAIN = re.compile(f" ?[{_LETTERS}]+")


def _byte_characters() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1
    stands for itself, the others take the characters from 256 on in turn."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


def model_word(tok) -> Callable[[str], str] | None:
    """What the library makes of a run of plain letters before its model reads it, found
    by asking it; None if that is no single word of a known form."""
    table = _byte_characters()

    def form(space: bool, lower: bool) -> Callable[[str], str]:
        def word(run: str) -> str:
            run = run if space else run.lstrip(" ")
            return (run.lower() if lower else run).encode().decode("latin-1").translate(table)
        return word

    def asked(run: str) -> list[str]:
        run = tok.normalizer.normalize_str(run) if tok.normalizer else run
        return [piece for piece, _ in tok.pre_tokenizer.pre_tokenize_str(run)] if tok.pre_tokenizer else [run]

    probes = [_LETTERS, " " + _LETTERS, *_LETTERS, *[" " + c for c in _LETTERS]]
    shown = [asked(run) for run in probes]
    return next((word for word in (form(space, lower) for space in (False, True) for lower in (False, True))
                 if shown == [[word(run)] for run in probes]), None)


def library_encoder(path: str, keep_apart: tuple[str, ...], limit: int = 1_000_000) -> Callable:
    """Texts' ids by the tokenizers library: ``f(buf, docs) -> (ids, offsets)``.

    Runs of plain letters go straight to its model. Texts that spell one of the vocabulary's special tokens (``keep_apart``) are encoded
    whole, since the library cuts there before it looks at white space.
    """
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    word = model_word(tok)
    read = tok.model.tokenize

    def whole(words: list[str], block: int = 500) -> tuple[np.ndarray, np.ndarray]:
        ids, word = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), block):
            coded = tok.encode(words[k:k + block], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(coded.ids, np.uint32))
            word.append(np.array(coded.word_ids, np.int64) + k)
        return np.concatenate(ids), np.bincount(np.concatenate(word), minlength=len(words))

    def distinct(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [r.decode() for r in runs]
        if word is None:
            return whole(words)
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        other, other_size = whole([words[k] for k in np.flatnonzero(~plain).tolist()])
        flat: list[int] = []
        plain_size = []
        for k in np.flatnonzero(plain).tolist():
            own = [t.id for t in read(word(words[k]))]
            flat += own
            plain_size.append(len(own))
        size = np.empty(len(words), np.int64)
        size[~plain], size[plain] = other_size, plain_size
        is_plain = np.repeat(plain, size)
        ids = np.empty(len(is_plain), np.uint32)
        ids[~is_plain], ids[is_plain] = other, flat
        return ids, size

    runs = RunEncoder(distinct, limit)

    def texts(buf: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        hit = set()
        for word in map(str.encode, keep_apart):
            at = raw.find(word)
            while at >= 0:
                hit.add(int(np.searchsorted(docs, at, "right")) - 1)
                at = raw.find(word, at + 1)
        ids, off = runs.texts(buf, docs)
        if not hit:
            return ids, off
        parts = [np.asarray(tok.encode(raw[docs[d]:docs[d + 1]].decode(), add_special_tokens=False).ids,
                            np.uint32) if d in hit else ids[off[d]:off[d + 1]]
                 for d in range(len(docs) - 1)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    return texts


_MADE: dict[tuple, Callable] = {}


def worker_encoder(path: str, keep_apart: tuple[str, ...], limit: int = 1_000_000) -> Callable:
    """One encoder per Python worker, kept between the tasks it runs; it remembers about
    ``limit`` runs."""
    key = (path, keep_apart, limit)
    if key not in _MADE:
        _MADE[key] = library_encoder(path, keep_apart, limit)
    return _MADE[key]
