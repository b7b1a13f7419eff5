"""Exact subword ids at the speed of a table look-up.

A byte-level BPE tokenizer first cuts a text into pieces and then encodes each piece alone. A single space between two
characters that are not white space always starts a piece, so the text may be cut there; each distinct piece is encoded
by the tokenizers library once and then looked up by its 64-bit hash, a slice of texts at a time in numpy.
"""

import os
import re
from functools import lru_cache

import numpy as np

from logloom.llm.shingles import mix

_JOINED = 256  # pieces; longer texts cost the tokenizer more per piece
_SLICE = 1 << 19
_values = np.random.default_rng(20240301).integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE, _FIRST = _values[:256], _values[256]
_STEP = 0x9E3779B97F4A7C15


def _powers(n: int, step: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Table:
    """Sorted hashes with their slots: a large array, and a small one that is merged into it now and then."""

    def __init__(self):
        self.keys, self.slots = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int32)] * 2

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Slots of ascending hashes; -1 where unknown."""
        out = np.full(len(wanted), -1, np.int64)
        for keys, slots in zip(self.keys, self.slots):
            if len(keys):
                at = np.searchsorted(keys, wanted)
                at[at == len(keys)] = 0
                hit = keys[at] == wanted
                out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        self._merge(1, keys, slots)
        if len(self.keys[1]) > 65_536:
            self._merge(0, self.keys[1], self.slots[1])
            self.keys[1], self.slots[1] = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _merge(self, level: int, keys: np.ndarray, slots: np.ndarray) -> None:
        at = np.searchsorted(self.keys[level], keys)
        self.keys[level] = np.insert(self.keys[level], at, keys)
        self.slots[level] = np.insert(self.slots[level], at, slots)


class _Growing:
    """An array with room at its end."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n // 4 + len(values), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class PieceEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Strings of added tokens (``<|endoftext|>``) in a text are ordinary text; with ``special`` they become the token's id,
    as in the library unless its ``encode_special_tokens`` is set. ``max_pieces`` bounds the memory of the table: beyond it the
    less used half is forgotten. Results do not depend on it.
    """

    def __init__(self, path: str, max_pieces: int = 1_000_000, special: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = self._added_tokens() if special else None
        self.max_pieces = max_pieces
        # A vocabulary entry has one character for each byte that it stands for.
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for entry, number in vocabulary.items():
            self.id_bytes[number] = len(entry)
        self.up = _powers(2 * _SLICE, _STEP)
        self.down = _powers(2 * _SLICE, pow(_STEP, -1, 1 << 64))
        self._clear()

    def _added_tokens(self) -> re.Pattern | None:
        """A pattern of the added tokens, longest first; texts are cut there before the look-up."""
        added = self.tokenizer.get_added_tokens_decoder().values()
        for token in added:
            if token.lstrip or token.rstrip or token.single_word or (token.normalized and self.tokenizer.normalizer) or re.search(r"\s", token.content):
                raise ValueError(f"added token {token.content!r} is not matched as plain text")
        contents = sorted((t.content for t in added), key=len, reverse=True)
        return re.compile(f"({'|'.join(map(re.escape, contents))})") if contents else None

    def _stretches(self, text: str) -> list[tuple[bool, bytes]]:
        """Parts of the text to be looked up, and whether each starts a text of its own."""
        whole = [x for x in self.added.split(text) if x] if self.added and self.added.search(text) else [text]
        return [(i == 0, part) for some in whole for i, part in enumerate(_safe_parts(some))]

    def _clear(self):
        self.table = _Table()
        self.starts, self.lengths, self.uses, self.unsafe = (_Growing(d) for d in (np.int64, np.int32, np.int32, bool))
        self.pool = _Growing(np.uint32)

    def _trim(self):
        """Keep the more used half."""
        uses = self.uses.all
        keep = np.flatnonzero(uses > np.sort(uses)[-(self.max_pieces // 2)])
        number = np.full(len(uses), -1, np.int64)
        number[keep] = np.arange(len(keep))
        starts, lengths, unsafe = self.starts.all[keep], self.lengths.all[keep].astype(np.int64), self.unsafe.all[keep]
        before = np.cumsum(lengths) - lengths
        ids = self.pool.all[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]
        keys, slots = np.concatenate(self.table.keys), number[np.concatenate(self.table.slots)]
        kept = slots >= 0
        order = np.argsort(keys[kept])
        counts = uses[keep] // 2
        self._clear()
        self.table.keys[0], self.table.slots[0] = keys[kept][order], slots[kept][order]
        for column, values in ((self.starts, before), (self.lengths, lengths), (self.uses, counts), (self.unsafe, unsafe), (self.pool, ids)):
            column.extend(values)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces, each with its space if it has one, into new slots."""
        inside = [p[1:] if p[:1] == " " else p for p in pieces]
        unsafe = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in inside), bool, len(pieces))
        # Safe pieces with a space can be encoded in one text and told apart by their bytes.
        together = np.fromiter((p[:1] == " " for p in pieces), bool, len(pieces)) & ~unsafe
        ids, order, lengths = [], [], []
        group = np.flatnonzero(together)
        parts = [group[begin : begin + _JOINED] for begin in range(0, len(group), _JOINED)]
        joined = ["".join([pieces[i] for i in some]) for some in parts]
        for some, encoded in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            found = np.array(encoded.ids, np.uint32)
            ends = np.cumsum([len(pieces[i].encode()) for i in some])
            ids.append(found)
            order.append(some)
            lengths.append(np.diff(np.searchsorted(np.cumsum(self.id_bytes[found]), ends) + 1, prepend=0))
        alone = np.flatnonzero(~together)
        if len(alone):
            single = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
            ids.append(np.fromiter((i for x in single for i in x), np.uint32, sum(map(len, single))))
            order.append(alone)
            lengths.append(np.fromiter(map(len, single), np.int64, len(single)))
        sizes, places = np.concatenate(lengths), np.concatenate(order)
        starts = np.empty(len(pieces), np.int64)
        starts[places] = self.pool.n + np.cumsum(sizes) - sizes
        sizes[places] = sizes.copy()
        for column, values in ((self.starts, starts), (self.lengths, sizes), (self.uses, np.zeros(len(pieces), np.int64)), (self.unsafe, unsafe)):
            column.extend(values)
        for found in ids:
            self.pool.extend(found)

    def _look_up(self, data: bytes, begins: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Slots of the pieces data[begin:end]; ``first`` ones have no space before them."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) >= len(self.up):
            self.up, self.down = _powers(len(raw) + 1, _STEP), _powers(len(raw) + 1, pow(_STEP, -1, 1 << 64))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * self.up[: len(raw)], out=sums[1:])
        hashes = mix((sums[ends] - sums[begins]) * self.down[begins] + (ends - begins).astype(np.uint64) + first * _FIRST)
        kinds, at, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        slots = self.table.find(kinds)
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = at[new]
            lead = ["" if f else " " for f in first[where].tolist()]
            slots[new] = np.arange(self.starts.n, self.starts.n + len(new))
            self._learn([s + data[a:b].decode() for s, a, b in zip(lead, begins[where].tolist(), ends[where].tolist())])
            self.table.add(kinds[new], slots[new])
        self.uses.all[slots] += counts
        return slots[which]

    def _encode_slice(self, parts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = b" ".join(parts)
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        begins, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
        heads = np.searchsorted(begins, np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]))
        opens = np.zeros(len(begins), bool)
        opens[heads[first]] = True
        slots = self._look_up(data, begins, ends, opens)
        bad = self.unsafe.all[slots]
        if bad.any():
            # Pieces that touch white space are put together again with their neighbours.
            broken = np.concatenate([[False], bad[1:] | bad[:-1]])
            broken[heads] = False
            keep = np.flatnonzero(~broken)
            begins, ends, opens = begins[keep], ends[np.append(keep[1:] - 1, len(ends) - 1)], opens[keep]
            heads = np.searchsorted(keep, heads)
            slots = self._look_up(data, begins, ends, opens)
        lengths = self.lengths.all[slots].astype(np.int64)
        before = np.cumsum(lengths) - lengths
        ids = self.pool.all[np.repeat(self.starts.all[slots] - before, lengths) + np.arange(int(lengths.sum()))]
        return ids, np.add.reduceat(lengths, heads)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of each text)."""
        ids, lengths, owners = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
        parts, first, held = [], [], 0

        def flush():
            nonlocal parts, first, held
            if parts:
                if self.starts.n > self.max_pieces:
                    self._trim()
                found, n = self._encode_slice(parts, np.array(first, bool))
                ids.append(found)
                lengths.append(n)
            parts, first, held = [], [], 0

        for number, text in enumerate(texts):
            for opens, part in self._stretches(text):
                parts.append(part)
                first.append(opens)
                owners.append(number)
                held += len(part)
                if held >= _SLICE:
                    flush()
        flush()
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, owners, np.concatenate(lengths))
        return np.concatenate(ids), total


def _safe_parts(text: str) -> list[bytes]:
    """The text in stretches of some hundred kilobytes, cut at single spaces (left out) between characters that are not white space."""
    if len(text) <= _SLICE:
        return [text.encode()]
    parts, begin = [], 0
    while len(text) - begin > _SLICE:
        cut = text.find(" ", begin + _SLICE)
        while cut >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        parts.append(text[begin:cut].encode())
        begin = cut + 1
    return [*parts, text[begin:].encode()]


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(path, special=special)


def ended(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text."""
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32, copy=False), lengths + 1
