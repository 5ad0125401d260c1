"""Token ids of whole texts, from the tokenizers library, with a memory of pieces already encoded.

A text is cut at places where no pre-token of the tokenizer can cross, each distinct piece is
encoded by the library once, and the ids of the pieces are joined. Two kinds of tokenizer are
known to allow this:

* byte-level BPE with the usual pattern and no normalizer: a cut goes before every single space
  that a non-space follows (a pre-token may begin with such a space, none can contain it later);
* BPE whose pre-tokenizer drops white space: a cut goes at every run of ASCII white space.

Any other tokenizer encodes each text as one piece. Special strings inside texts are left to
the library. Cutting, finding the distinct pieces of a batch and joining their ids are array
operations; Python handles each distinct piece of a batch once.

New pieces are encoded many at a time, as one text that the same cuts take apart again: by the ids
that begin with a space, by those that end a pre-token where every piece is one, or by the id of a number
sign put between the pieces (such a sign is always a pre-token of its own).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memory, trim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: A worker remembers the pieces of its latest texts, and others up to this many.
MEMORY_PIECES = 200_000
#: New pieces encoded at once, and those of letters alone.
TOGETHER, WORDS_TOGETHER = 4096, 512
#: Bytes of text that operators give to an encoder at a time.
CHARACTERS = 5 << 20

#: A space that the end or any white space follows, in RE2; the cut of such texts is left to ``re``.
_AMBIGUOUS = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"
_BEFORE_WORD = re.compile(r" (?=\S)")
_SIGNS = "½²३¼"
#: A piece that ends with marks after a letter that is lowered to one letter.
_TAIL = r"(?s)^(?P<head>.*[a-zA-ZÀ-ÖØ-öø-ÿ])(?P<tail>[,.!?;:|*$%&#]+)$"

_encoders: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """The encoder of this process for a tokenizer file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder(Memory):
    """Known pieces are an array of names, with their ids one after another and the number of ids of each."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(spec)
        self._begins = self._ends = self._sign = None
        if self.kind == "spaces kept":
            vocabulary = self.tokenizer.get_vocab()
            self._begins = np.zeros(max(vocabulary.values()) + 1, bool)
            self._begins[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True
        elif self.kind == "spaces dropped":
            single = ((x, self.tokenizer.encode(x, add_special_tokens=False).ids) for x in _SIGNS)
            self._sign = next(((x, ids[0]) for x, ids in single if len(ids) == 1), None)
            self._ends = _ends(spec, self.tokenizer.get_vocab())
        self.clear()
        trim()  # the file's text was many times the size of what is kept

    def clear(self) -> None:
        self._names, self._flat, self._sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, texts' first pieces, the piece numbers of all texts one after another, and where each text's begin (with the end).

        Where spaces are kept, a text's first piece has no space before it and is encoded each time; the others are named without theirs.
        """
        if self.kind == "whole":
            flat = texts.dictionary_encode()
            return flat.dictionary, [], flat.indices.to_numpy(), np.arange(len(texts) + 1)
        lists = pc.split_pattern(texts, " ") if self.kind == "spaces kept" else pc.ascii_split_whitespace(texts)
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        flat = lists.flatten()
        if self.kind == "spaces dropped":
            flat = flat.dictionary_encode()
            return flat.dictionary, [], flat.indices.to_numpy(), at
        odd = np.flatnonzero(pc.match_substring_regex(texts, _AMBIGUOUS).to_numpy(zero_copy_only=False))
        if len(odd):
            parts, end = [], 0
            for i in odd:
                first, *rest = _BEFORE_WORD.split(texts[int(i)].as_py())
                parts += [flat.slice(end, at[i] - end), pa.array([first, *rest], pa.string())]
                end = at[i + 1]
            sizes = np.diff(at)
            sizes[odd] = [len(x) for x in parts[1::2]]
            flat, at = pa.concat_arrays([*parts, flat.slice(end)]), np.concatenate([[0], np.cumsum(sizes)])
        first = flat.take(pa.array(at[:-1])).to_pylist()
        flat = flat.dictionary_encode()
        codes = flat.indices.to_numpy().astype(np.int64)
        codes[at[:-1]] = len(flat.dictionary) + np.arange(len(first))
        return flat.dictionary, first, codes, at

    def _sized(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of known and first pieces one after another, where each piece's begin, how many it has, and pieces and places as ``_cut`` gives them."""
        self.use()
        names, first, codes, at = self._cut(pc.fill_null(texts, ""))
        place = self._places(names, self._learn)
        flat, sizes = self._flat, self._sizes
        starts = np.cumsum(sizes) - sizes
        if first:
            more, own = self._encode_each(first)
            place = np.concatenate([place, len(sizes) + np.arange(len(first))])
            starts = np.concatenate([starts, len(flat) + np.cumsum(own) - own])
            flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, own])
        if len(self._names) > MEMORY_PIECES:
            keep = place[: len(names)]
            self._names, self._flat, self._sizes = names, flat[_runs(starts[keep], sizes[keep])], sizes[keep]
        return flat, starts, sizes, place[codes], at

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (with the end); null counts as empty."""
        flat, starts, sizes, codes, at = self._sized(texts)
        n = sizes[codes]
        return flat[_runs(starts[codes], n)], np.concatenate([[0], np.cumsum(n)])[at]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        _, _, sizes, codes, at = self._sized(texts)
        return np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[at])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        ids, at = self.flat(pa.array(list(texts), pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and how many each text has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((x for own in ids for x in own), np.uint32), np.array([len(x) for x in ids], np.int64)

    def _places(self, names: pa.Array, learn: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
        """Where distinct pieces are among the known ones, those not met before learnt."""
        place = pc.fill_null(pc.index_in(names, value_set=self._names), -1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            place[new] = learn(names.filter(pa.array(new)))
        return place

    def _remember(self, names: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Add pieces with their ids; gives their places."""
        n = len(self._names)
        self._names = pa.concat_arrays([self._names, names])
        self._flat, self._sizes = np.concatenate([self._flat, flat]), np.concatenate([self._sizes, sizes])
        return n + np.arange(len(names))

    def _learn(self, missing: pa.Array) -> np.ndarray:
        """Encode distinct pieces and remember them; gives their places."""
        if self.kind != "spaces dropped":
            return self._learn_whole(missing)
        # A pre-token ends between a letter and these marks, and ASCII letters may be lowered beforehand: fewer different pieces are encoded.
        cut = pc.extract_regex(missing, _TAIL)
        head, tail = pc.coalesce(pc.struct_field(cut, "head"), missing), pc.fill_null(pc.struct_field(cut, "tail"), "")
        head = pc.if_else(pc.and_(pc.string_is_ascii(head), pc.invert(pc.match_substring(head, "<"))), pc.ascii_lower(head), head)
        parts = pa.concat_arrays([head, tail]).dictionary_encode()
        place, tails = self._places(parts.dictionary, self._learn_whole)[parts.indices.to_numpy()].reshape(2, -1)
        made = pc.not_equal(head, missing)  # never a part of its own: heads are lowered, and end before marks
        own = made.to_numpy(zero_copy_only=False)
        both = np.stack([place[own], tails[own]], axis=1).reshape(-1)  # head and tail of each in turn
        starts = np.cumsum(self._sizes) - self._sizes
        place[own] = self._remember(missing.filter(made), self._flat[_runs(starts[both], self._sizes[both])], self._sizes[both].reshape(-1, 2).sum(axis=1))
        return place

    def _learn_whole(self, missing: pa.Array) -> np.ndarray:
        avoid = {"spaces kept": " ", "spaces dropped": self._sign and self._sign[0]}.get(self.kind)
        none = np.zeros(len(missing), bool)
        alone = pc.or_(pc.equal(missing, ""), pc.match_substring(missing, avoid)).to_numpy(zero_copy_only=False) if avoid else ~none
        words = none if self._ends is None else pc.match_substring_regex(missing, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        lead, order, flat, sizes = " " * (self.kind == "spaces kept"), [], [], []

        def each(numbers: np.ndarray, together: int, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
            """Encode these pieces; gives those that couldn't be told apart."""
            failed = [numbers[:0]]
            for i in range(0, len(numbers), together):
                part = numbers[i : i + together]
                found = encode(missing.take(pa.array(part)).to_pylist())
                if found is None:
                    failed.append(part)
                else:
                    for x, y in zip((order, flat, sizes), (part, *found), strict=True):
                        x.append(y)
            return np.concatenate(failed)

        rest = np.concatenate([each(np.flatnonzero(words), WORDS_TOGETHER, self._encode_words), np.flatnonzero(~words)])
        rest = np.concatenate([each(rest[~alone[rest]], TOGETHER, self._encode_joined), rest[alone[rest]]])
        each(rest, TOGETHER, lambda part: self._encode_each([x and lead + x for x in part]))  # the empty name is what repeated white space leaves
        order, place = np.concatenate(order), np.zeros(len(missing), np.int64)
        place[order] = self._remember(missing.take(pa.array(order)), np.concatenate(flat), np.concatenate(sizes))
        return place

    def _encode_words(self, part: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces of letters encoded as one text, and how many each has; None if some piece is more than one pre-token."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        end = np.flatnonzero(self._ends[ids])
        return (ids, np.diff(end, prepend=-1)) if len(end) == len(part) else None  # each is one at least

    def _encode_joined(self, part: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for any pieces; None if their ids can't be told apart."""
        text = " " + " ".join(part) if self.kind == "spaces kept" else f" {self._sign[0]} ".join(part)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if self.kind == "spaces kept":
            begin = np.flatnonzero(self._begins[ids])
            sizes = np.diff(np.append(begin, len(ids)))
            whole = len(begin) and not begin[0]
        else:
            sign = ids == self._sign[1]
            sizes = np.diff(np.concatenate([[-1], np.flatnonzero(sign), [len(ids)]])) - 1
            ids, whole = ids[~sign], True
        return (ids, sizes) if whole and len(sizes) == len(part) else None


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of each run in turn."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def _kind(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    simple = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    if not simple or spec.get("truncation") or spec.get("padding"):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
        return "spaces kept"
    if pre.get("type") == "Sequence" and norm:
        first = pre["pretokenizers"][0]
        steps = {(x["type"]) for x in norm.get("normalizers", [norm])}
        drops = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
        if drops and steps <= {"NFC", "Replace", "Lowercase"}:
            return "spaces dropped"
    return "whole"


def _ends(spec: dict, vocabulary: dict[str, int]) -> np.ndarray | None:
    """Which ids end a pre-token of letters, where the last id of each surely does and no other can."""
    from tokenizers.pre_tokenizers import ByteLevel

    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    bytewise = any(x["type"] == "ByteLevel" for x in spec["pre_tokenizer"]["pretokenizers"])
    if model.get("ignore_merges") or model.get("continuing_subword_prefix") or not (suffix == "</w>" and bytewise and all(x + suffix in vocabulary for x in ByteLevel.alphabet())):
        return None
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
    return ends
