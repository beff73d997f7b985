"""Token ids of whole texts by the ``tokenizers`` library, with a memory of pieces already encoded.

A byte-level BPE splits a text into words by a fixed pattern and encodes each word by itself. A word begins
at all white space with another character before it, and at its last one with another character after it,
so the ids of a text are the concatenated ids of its pieces between such places. Pieces repeat, so each
worker finds the distinct ones of many texts, asks the library for those it doesn't remember and gathers
the ids by number. Texts with characters that are white space in one of the two alone (some beyond Latin),
with the strings of added tokens, and tokenizers of another kind go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids as they are kept and hashed everywhere: little-endian unsigned 32-bit integers.
ID = np.dtype("<u4")

_UNSURE = re.compile("[^\t\n\r -~¡-ɏ]")
#: Goes between pieces; no text of sure characters has it.
_CUT = "\0"
_PLACES = re.compile(r"(?<=\S)(?=\s)|(?=\s\S)")
#: Pieces that fall apart again when joined.
_PLAIN = re.compile(r"[ \n]\S+")


def _cut(text: str) -> str:
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\t" in text or "\r" in text:
        return _PLACES.sub(_CUT, text)
    return text.replace(" ", f"{_CUT} ").replace("\n", f"{_CUT}\n")  # no white space is beside another


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, of: np.ndarray, at_once: int = 1 << 18) -> tuple[bytes, np.ndarray]:
    """The ids of the pieces numbered ``of``, one after another, and where each begins and the last one ends."""
    ends, data = np.zeros(len(of) + 1, np.int64), []
    np.cumsum(sizes[of], out=ends[1:])
    for k in range(0, len(of), at_once):
        part = of[k : k + at_once]
        data.append(ids[np.repeat(starts[part] - ends[k : k + len(part)], sizes[part]) + np.arange(ends[k], ends[k + len(part)])].tobytes())
    return b"".join(data), ends


class Encoder:
    """``encode(text)`` gives the ids as the bytes of an ``ID`` array. ``memory`` bounds the characters remembered."""

    def __init__(self, path: str, memory: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not spec.get("normalizer")
            and not spec.get("post_processor")
        )
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[k for x, k in vocabulary.items() if x[:1] in ("Ġ", "Ċ")]] = True  # how a space and a line end are written there
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, ID), np.zeros(0, np.int64)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str], at_once: int = 1 << 24) -> Iterator[bytes]:
        """Each text's ids, in order. New pieces are asked for together, for texts of ``at_once`` characters or one longer text."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= at_once:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        sure = [self.by_word and not _UNSURE.search(x) and not any(y in x for y in self.added) for x in texts]
        found = self._by_piece([_cut(x) for x, y in zip(texts, sure, strict=True) if y])
        for text, y in zip(texts, sure, strict=True):
            yield next(found) if y else self.whole(text)

    def _by_piece(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), _CUT)
        begins, coded = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        del texts, cut  # copies of all texts
        if (pc.sum(pc.binary_length(self.known)).as_py() or 0) > self.memory:
            self._forget()
        numbers = self._numbers(coded.dictionary)
        data, ends = _gather(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, numbers[coded.indices.to_numpy()])
        places = (ends[begins] * ID.itemsize).tolist()
        yield from (data[k:end] for k, end in zip(places, places[1:], strict=False))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The distinct pieces' numbers; new ones are learned."""
        number = pc.index_in(pieces, value_set=self.known)
        new = number.is_null().to_numpy(zero_copy_only=False)
        out = number.fill_null(0).to_numpy().copy()
        fresh = pieces.filter(pa.array(new))
        asked = fresh.to_pylist()
        joined = np.array([_PLAIN.fullmatch(x) is not None for x in asked], bool)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        n = int(joined.sum())
        got = [self._ask([asked[x] for x in order[k : min(k + 256, end)]], end == n) for first, end in ((0, n), (n, len(asked))) for k in range(first, end, 256)]
        out[new] = len(self.known) + np.argsort(order)
        ids, sizes = (np.concatenate(x) for x in zip((self.ids, self.sizes), *got, strict=True))
        self.known, self.ids, self.sizes = pa.concat_arrays([self.known, fresh.take(pa.array(order))]), ids, sizes
        return out

    def _ask(self, pieces: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids, and how many each has. Those with one space or line end, before the rest, are encoded together: an id that begins with one begins a piece."""
        if joined:
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, ID)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(pieces) and first[0] == 0:
                return ids, np.diff(np.append(first, len(ids)))
        found = [np.asarray(x.ids, ID) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for ``path``; Spark reuses Python workers, so it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
