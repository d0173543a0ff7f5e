"""Token ids of whole texts by the tokenizers library, computed once per distinct chunk.

A text is cut where the tokenizer's own pre-tokenisation always cuts, and the library encodes each
distinct chunk once. Cuts are before a space, around a single line end, and between a Latin letter and
the marks that follow it up to a space. Two families of tokenizers are known to cut there and are
recognised from their files: byte-level pre-tokenisation that keeps the space before a word, and word
splitting that drops white space. Texts with longer runs of white space (first family), texts with the
separator character and all other tokenizers are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker remembers; beyond it those go that were not met again. It changes speed only.
CACHE_CHUNKS = 400_000
#: Rows that callers should give to encode() at once.
ENCODE_ROWS = 1024
#: Distinct chunks given to the library at once, chunks side by side in one text, characters worked on at once.
_ENCODE_AT_ONCE, _SIDE_BY_SIDE, _CHARS_AT_ONCE = 20_000, 1000, 2_000_000
_RUNS = re.compile(r"\s\s\s|\s\s\Z")
_TWO = re.compile(r"\s\s")
#: Stands before a chunk that has no space before it.
_GLUE = "\x1f"
#: Latin letters whose lower case and composition are letters.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_MARKS = ".,;:!?#*$%&|"
_WORD_MARKS = rf"([{_LATIN}])([{_MARKS}]+)( |\z)"
_SPACED = re.compile(rf"[^\s{_GLUE}]\S*")
_ONE_WORD = re.compile(f"[{_LATIN}]+|[{_MARKS}]+")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _family(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    pre, normal = conf.get("pre_tokenizer") or {}, conf.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
        return "kept"
    steps = pre.get("pretokenizers", [])
    if pre.get("type") == "Sequence" and [s["type"] for s in steps] == ["Split", "ByteLevel"]:
        split, level = steps
        spaces_go = split["behavior"] == "Removed" and split["invert"] and "[^\\s" in str(split["pattern"].get("Regex"))
        plain = normal is None or all(n["type"] in ("NFC", "Replace", "Lowercase") for n in normal.get("normalizers", [normal]))
        if spaces_go and plain and not level["use_regex"] and not level["add_prefix_space"]:
            return "dropped"
    return "whole"


class Encoder:
    def __init__(self, path: str, end_id: int | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.family, self.end = _family(path), end_id
        vocab = self.tok.get_vocab()
        #: By id: the token's bytes (first family), or whether it ends a word (second family).
        self.measure = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.measure[i] = len(token) if self.family == "kept" else token.endswith("</w>")
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.again = np.zeros(1 << 14, bool)

    def _forget(self) -> None:
        """Keep the chunks that were met again, if they are less than half of what is remembered."""
        kept = [(c, i) for c, i in self.slot.items() if self.again[i]]
        pool, at, size = self.pool, self.at, self.size
        self._reset()
        if kept and len(kept) < CACHE_CHUNKS // 2:
            old = np.fromiter((i for _, i in kept), np.int64, len(kept))
            n = size[old]
            upto = np.cumsum(n)
            self._keep([c for c, _ in kept], pool[np.repeat(at[old] - (upto - n), n) + np.arange(upto[-1])], n)

    def _keep(self, part: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(part) > len(self.at):
            self.at, self.size, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.again))
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(part)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(part)] = sizes
        self.slot.update(zip(part, range(self.n, self.n + len(part)), strict=True))
        self.n, self.used = self.n + len(part), self.used + len(flat)

    def _learn(self, chunks: list[str]) -> None:
        kept = self.family == "kept"
        plain = (_SPACED if kept else _ONE_WORD).fullmatch
        fits = list(map(plain, chunks))
        near = [c for c, m in zip(chunks, fits, strict=True) if m]
        rest = [c for c, m in zip(chunks, fits, strict=True) if not m]
        for i in range(0, len(near), _SIDE_BY_SIDE):
            part = near[i : i + _SIDE_BY_SIDE]
            joined = " ".join(["", *part] if kept else part)
            ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            if kept:  # the bytes of the ids add up to the bytes of the chunks and their spaces
                ends = np.cumsum(pc.binary_length(pa.array(part, pa.large_string())).to_numpy() + 1)
                upto = np.searchsorted(np.cumsum(self.measure[ids]), ends) + 1
            else:  # the last id of a word says so
                upto = np.flatnonzero(self.measure[ids]) + 1
            self._keep(part, ids, np.diff(upto, prepend=0))
        for i in range(0, len(rest), _ENCODE_AT_ONCE):
            part = rest[i : i + _ENCODE_AT_ONCE]
            real = [(c[1:] if c[:1] == _GLUE else " " + c) for c in part] if kept else part
            ids = [e.ids for e in self.tok.encode_batch_fast(real, add_special_tokens=False)]
            self._keep(part, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _whole(self, text: str) -> np.ndarray:
        ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids if self.end is None else [*ids, self.end], np.uint32)

    def _cut(self, texts: list[str], alone: set[int], double: set[int]) -> pa.Array:
        """The texts' chunks (double: texts with two white spaces in a row); a chunk without the separator has a space before it (first family)."""
        if self.family == "dropped":
            ready, with_marks = [t.replace("\n", " ") for t in texts], r"\1 \2\3"
        else:
            line = f" {_GLUE}\n {_GLUE}"
            ready = ["" if i in alone else _GLUE + (t if i in double else t.replace("\n", line)) for i, t in enumerate(texts)]
            with_marks = rf"\1 {_GLUE}\2\3"
        return pc.split_pattern(pc.replace_substring_regex(pa.array(ready, pa.large_string()), _WORD_MARKS, with_marks), " ")

    def _slots(self, texts: list[str]) -> tuple[set[int], np.ndarray, np.ndarray]:
        """The texts that are encoded as a whole, the slots of all others' chunks, and where each text's begin and end."""
        double = {i for i, t in enumerate(texts) if self.family == "kept" and _TWO.search(t)}
        alone = {i for i, t in enumerate(texts) if self.family == "kept" and (_GLUE in t or (i in double and _RUNS.search(t)))}
        parts = self._cut(texts, alone, double)
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes a scalar of each
        if len(self.slot) + len(chunks) > CACHE_CHUNKS:
            self._forget()
        known = self.n
        if new := [c for c in chunks if c not in self.slot]:
            self._learn(new)
        places = np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))
        self.again[places[places < known]] = True
        return alone, places[coded.indices.to_numpy()], bounds

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        alone, slots, bounds = self._slots(texts)
        sizes = self.size[slots]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.repeat((self.at[slots] - (upto - sizes)).astype(np.int32), sizes) + np.arange(total, dtype=np.int32)]
        ends = np.concatenate([[0], upto])[bounds]
        tail = [] if self.end is None else [np.array([self.end], np.uint32)]
        return [self._whole(texts[i]) if i in alone else np.concatenate([ids[a:b], *tail]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]

    def _count(self, texts: list[str]) -> list[int]:
        alone, slots, bounds = self._slots(texts)
        n = np.diff(np.concatenate([[0], np.cumsum(self.size[slots])])[bounds]).tolist()
        return [len(self._whole(texts[i])) if i in alone else x + (self.end is not None) for i, x in enumerate(n)]

    def _grouped(self, texts: list[str | None], work: Callable[[list[str]], list]) -> list:
        """What work makes of the texts (null: empty), some at a time."""
        out: list = []
        group: list[str] = []
        chars = 0
        for t in texts:
            group.append(t or "")
            chars += len(group[-1])
            if chars >= _CHARS_AT_ONCE:
                out += work(group)
                group, chars = [], 0
        return out + (work(group) if group else [])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: empty), the end id included, as arrays of unsigned 32-bit integers."""
        if self.family == "whole":
            return [self._whole(t or "") for t in texts]
        return self._grouped(texts, self._encode)

    def count(self, texts: list[str | None]) -> list[int]:
        """How many ids encode() gives for each text; they are not put together for it."""
        if self.family == "whole":
            return [len(self._whole(t or "")) for t in texts]
        return self._grouped(texts, self._count)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]
