"""BPE encoding and decoding by a prefix-sharing trie of distinct words.

A text is cut at added tokens, normalized and pre-tokenized by the tokenizer file's own components; the words are then
encoded by the BPE model without running its merge loop per word. For every prefix ``p`` of a word the *state* is the
last token of BPE(p). A token sequence is the BPE encoding of its text exactly when every neighbouring pair ``(a, b)``
is the encoding of ``a + b`` (each pair is checked once by a merge loop over at most two tokens' symbols and
remembered), so the state of ``p`` is the one token ``t`` ending ``p`` that pairs validly with the state of
``p[:-len(t)]``. The encoding of a word is read back from the states along its path.

The distinct words of a slice of texts are walked in sorted order, which is the depth-first order of their trie: the
stack of states along the current root path is cut to the common prefix with the previous word and grown from there, so
the states of a shared prefix are computed once for all words below it. The word end (``</w>``) hangs below its last
plain prefix and is never shared.

Spark deals the texts out; every task encodes its own slices, so nothing is shuffled. A task remembers the ids of up
to a million words it has met, so the trie of a later slice holds only new words.
Null text encodes as empty (no ids, empty decoded text); a text that is only white space gives no ids; very long words
(hundreds of thousands of characters) take one stack entry per character. Rows, their order and all other columns
pass through; columns named like the outputs are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.texts import slices, texts_of


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("\u00a1"), ord("\u00ac") + 1), *range(ord("\u00ae"), ord("\u00ff") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class _FastWords:
    """The file's normalizer and pre-tokenizer, where they are of the common kinds, without the library's per-character
    alignment bookkeeping: Unicode forms, regex replacement, lower case; a regex split keeping matches; byte-level."""

    _FORMS = {"NFC", "NFD", "NFKC", "NFKD"}

    def __init__(self, steps, pattern, byte_level: bool):
        self.steps, self.pattern = steps, pattern
        self.bytes = str.maketrans({chr(b): c for b, c in _byte_chars().items()}) if byte_level else None

    @staticmethod
    def _regex(rust: str):
        import regex

        # White space in the library's patterns is Unicode's White_Space property.
        return regex.compile(re.sub(r"(?<!\\)\\s", r"\\p{White_Space}", rust))

    @classmethod
    def of(cls, spec: dict) -> "_FastWords | None":
        normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        parts = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
        steps = []
        for part in parts:
            if part["type"] in cls._FORMS:
                steps.append(("form", part["type"]))
            elif part["type"] == "Lowercase":
                steps.append(("lower", None))
            elif part["type"] == "Replace" and "Regex" in part["pattern"]:
                steps.append(("replace", (cls._regex(part["pattern"]["Regex"]), part["content"])))
            else:
                return None
        pre = spec.get("pre_tokenizer") or {"type": "Sequence", "pretokenizers": []}
        pres = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        kinds = [p["type"] for p in pres]
        if kinds != ["Split", "ByteLevel"]:
            return None
        split, level = pres
        if not (split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]) or level.get("use_regex") or level.get("add_prefix_space"):
            return None
        return cls(steps, cls._regex(split["pattern"]["Regex"]), True)

    def __call__(self, text: str) -> list[str]:
        import unicodedata

        for kind, arg in self.steps:
            if kind == "form":
                text = unicodedata.normalize(arg, text)
            elif kind == "lower":
                # Character by character, as the library does: no final sigma.
                text = text.replace("\u03a3", "\u03c3").lower()
            else:
                text = arg[0].sub(arg[1], text)
        words = self.pattern.findall(text)
        return [w if w.isascii() and w.isprintable() and " " not in w else w.encode("utf-8").decode("latin-1").translate(self.bytes) for w in words]


class TrieEncoder:
    """The BPE model of a tokenizers file, applied to words through their trie."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        # Merges are pairs, or "a b" strings in older files.
        self.ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ", 1)): r for r, pair in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.added = added
        # Leftmost match, longer strings first, as the library's added vocabulary does.
        self.cut = re.compile("|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None
        parts = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = parts.normalizer, parts.pre_tokenizer
        self._fast = _FastWords.of(spec)
        self.names = [""] * (max([*self.vocab.values(), *added.values()]) + 1)
        for table in (self.vocab, added):
            for token, i in table.items():
                self.names[i] = token
        self.lengths = {i: len(self._plain(t)) for t, i in self.vocab.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        # Tokens read backwards from their last character: one trie for plain tokens, one for word ends, so that the
        # tokens ending at a place are found by walking back only as far as some token reaches.
        self._backwards = ({}, {})
        for token, i in self.vocab.items():
            plain = self._plain(token)
            if not plain:
                continue
            node = self._backwards[plain != token]
            for ch in reversed(plain):
                node = node.setdefault(ch, {})
            node[None] = i
        self._known: dict[str, list[int]] = {}

    def _plain(self, token: str) -> str:
        return token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token

    def _symbols(self, token: str) -> list[str]:
        plain = self._plain(token)
        if plain == token or not plain:
            return list(token)
        return [*plain[:-1], plain[-1] + self.suffix]

    def _merge(self, symbols: list[str]) -> list[str]:
        """The plain merge loop: lowest rank first, leftmost among equals; used on two tokens' symbols only."""
        while len(symbols) > 1:
            best = min(((self.ranks.get((symbols[i], symbols[i + 1]), -1), i) for i in range(len(symbols) - 1)), key=lambda r: (r[0] < 0, r))
            if best[0] < 0:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _valid(self, left: int | None, token: int) -> bool:
        key = (-1 if left is None else left, token)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 4_000_000:
                self._pairs.clear()
            names = [self.names[token]] if left is None else [self.names[left], self.names[token]]
            known = self._merge([s for n in names for s in self._symbols(n)]) == names
            self._pairs[key] = known
        return known

    def _state(self, word: str, end: int, states: list[int], final: bool) -> int:
        """Last token of BPE(word[:end]); ``final`` adds the word-end suffix to the last character."""
        node = self._backwards[final]
        for begin in range(end - 1, -1, -1):
            node = node.get(word[begin])
            if node is None:
                break
            token = node.get(None)
            if token is not None and self._valid(states[begin] if begin else None, token):
                return token
        raise ValueError(f"no BPE state for {word[:end]!r}")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word; the words are walked as a trie in depth-first (sorted) order."""
        out: dict[str, list[int]] = {}
        path, states = "", [0]
        for word in sorted(set(words)):
            if not word:
                out[word] = []
                continue
            common = 0
            for a, b in zip(path, word[:-1]):
                if a != b:
                    break
                common += 1
            del states[common + 1 :]
            for end in range(common + 1, len(word)):
                states.append(self._state(word, end, states, False))
            path = word[:-1]
            ids = [self._state(word, len(word), states, bool(self.suffix))]
            at = len(word) - self.lengths[ids[0]]
            while at > 0:
                ids.append(states[at])
                at -= self.lengths[states[at]]
            out[word] = ids[::-1]
        return out

    def words(self, text: str) -> list[str | int]:
        """Pre-tokenized words of a text; added tokens found in it stand as their ids."""
        pieces: list[str | int] = []
        at = 0
        for match in self.cut.finditer(text) if self.cut else ():
            pieces += self._words(text[at : match.start()])
            pieces.append(self.added[match.group()])
            at = match.end()
        return pieces + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if self._fast:
            return self._fast(text)
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        split = self.pre_tokenizer.pre_tokenize_str(normal) if self.pre_tokenizer else [(normal, None)]
        return [w for w, _ in split if w]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the distinct words of all of them that earlier calls have not met share one trie."""
        split = [self.words(t) for t in texts]
        known = self._known
        if len(known) > 1_000_000:
            known.clear()
        known.update(self.encode_words([w for s in split for w in s if isinstance(w, str) and w not in known]))
        return [[i for w in s for i in ([w] if isinstance(w, int) else known[w])] for s in split]

    def decode(self, ids: list[int]) -> str:
        """The library's decoding without a decoder: token strings joined by one space, special tokens kept."""
        return " ".join(self.names[i] for i in ids)


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder_for(path: str) -> TrieEncoder:
    """One encoder per file and Python worker: Spark reuses workers, so pairs and words checked once serve later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Add ``ids`` (array<int>, the BPE encoding of ``text`` with no special tokens added) and, unless ``decoded`` is
    None, ``decoded`` (the text that decoding those ids gives). See the module docstring for the method and odd rows."""
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])
    kept = [f for f in df.schema.fields if f.name not in {ids, decoded}]
    schema = T.StructType(kept + new)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for part in slices(batches, "__text"):
            encoded = encoder.encode(texts_of(part, "__text"))
            columns = [part.column(n) for n in names]
            columns.append(pa.array(encoded, pa.list_(pa.field("element", pa.int32(), False))))
            if decoded:
                columns.append(pa.array([encoder.decode(e) for e in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return df.select(*names, F.col(text).alias("__text")).mapInArrow(run, schema)
