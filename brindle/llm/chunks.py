"""Tokenizing by chunks between spaces, for tokenizers that drop white space.

Where no token spans white space, the ids of a text are those of its chunks, one after the other; a chunk seen before is a
lookup. The cache lives as long as its Python worker and has two generations: when the younger is full it becomes the older, and
what is still in use moves up again. Chunks of more than LONGEST characters are never kept. New words of Latin letters, with or without trailing
punctuation, go to the tokenizer's model directly, without normalizing and splitting, which leave them whole; a second cache keeps them in lower case and
without what follows them, so that each comes to the model once. Other chunks go to the tokenizer. Tokenizers that keep white space cannot be used here.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GENERATION, LONGEST = 300_000, 64  # chunks of a generation, characters of a chunk that is kept
PUNCTUATION = ".,;:!?$%&#*"  # taken apart from a word before it; no sign of a special token's string
#: Byte-level models write printable bytes of Latin-1 as themselves, the others in turn from code point 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)}
_OPEN: dict[str, Chunks] = {}


def split(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


#: Letters that neither normal form C nor a rule on capitals splits or changes but for lower case.
_LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "İ")
_WORD = re.compile(f"([{_LATIN}]+)([{re.escape(PUNCTUATION)}]*)")


def _by_word(own: dict) -> bool:
    """Whether a tokenizer (its JSON) is one that lower-cases, takes runs of letters and of punctuation apart and knows bytes: then a
    word of Latin letters is one call of the model."""
    steps = own.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [])
    lowers = [x["type"] for x in (own.get("normalizer") or {}).get("normalizers", [])]
    found = [x["pattern"].get("Regex", "").split("|") for x in steps if x["type"] == "Split"]
    split_ = [x for x in found if r"[\p{L}]+" in x and r"[^\s\p{L}\p{N}]+" in x]
    return own["model"]["type"] == "BPE" and len(steps) == 2 and len(split_) == 1 and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and "Lowercase" in lowers


class Cache:
    """What make() gives for chunks, in two generations."""

    def __init__(self, make: Callable[[list[str]], dict]):
        self.make, self.young, self.old, self.long = make, {}, {}, []

    def lookup(self, chunks: set[str]) -> Callable:
        """A function that gives what belongs to each of chunks, none of which is in a table of another tier, until the next call."""
        for w in self.long:
            del self.young[w]
        self.long = []
        young, old = self.young, self.old
        unseen = chunks.difference(young)
        if not unseen:
            return young.__getitem__
        found = {w: old[w] for w in unseen if w in old} if old else {}
        found |= self.make([w for w in unseen if w not in found])
        self.long = [w for w in found if len(w) > LONGEST] if max(map(len, found)) > LONGEST else []
        if len(young) + len(found) - len(self.long) > GENERATION:
            self.old, self.young = young, found
            return Tiers(found, young.__getitem__).__getitem__
        young.update(found)
        return young.__getitem__


class Marks(dict):
    """What a function gives, each key once."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


class Tiers(dict):
    """A table, and a function for what it lacks."""

    def __init__(self, table: dict, beyond: Callable | None = None):
        super().__init__(table)
        self.beyond = beyond

    def __missing__(self, key):
        return self.beyond(key)


class Chunks:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        own = json.loads(self.tokenizer.to_str())
        self.by_word = _by_word(own)
        if self.by_word:
            self.model = Tokenizer.from_file(path).model
            self.model._resize_cache(0)  # words come here once: the model's own cache would only cost time
            self.cores = Cache(self._of_cores)
        self.packed = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.cache = Cache(self.encode)

    def _of_cores(self, cores: list[str]) -> dict[str, bytes]:
        packed, of = self.packed, self.model.tokenize
        return {w: b"".join([packed[t.id] for t in of(w if w.isascii() else "".join(map(_BYTES.__getitem__, w.encode())))]) for w in cores}

    def encode(self, chunks: list[str]) -> dict[str, bytes]:
        """Little-endian unsigned 32-bit ids of each chunk."""
        packed = self.packed
        whole = lambda m: b"".join([packed[k] for k in self.tokenizer.encode(m, add_special_tokens=False).ids])
        out, rest, marks = {}, [], Marks(whole)
        words, cores, tails = [], [], []
        word = _WORD.fullmatch
        for w in chunks:
            if self.by_word and len(w) <= LONGEST and (m := word(w)):
                words.append(w)
                cores.append(m[1].lower())
                tails.append(m[2])
            else:
                rest.append(w)
        if words:
            known = map(self.cores.lookup(set(cores)), cores)
            out = {w: ids + marks[tail] if tail else ids for w, ids, tail in zip(words, known, tails, strict=True)}
        for k in range(0, len(rest), 1024):
            part = rest[k : k + 1024]
            out.update((w, b"".join([packed[i] for i in e.ids])) for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        return out

    def lengths(self, chunks: list[str]) -> dict[str, int]:
        """Numbers of ids of each chunk."""
        return {w: len(ids) >> 2 for w, ids in self.encode(chunks).items()}

    def ids_of(self, texts: pa.Array | Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Texts are cut into chunks, and ids laid one after the other, in Arrow; Python sees each chunk once."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string()), "")
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(list(map(self.cache.lookup(set(chunks)), chunks)), pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64)[ids.offset : ids.offset + len(ids) + 1][np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]]
        data = memoryview(data or b"")
        return [bytes(data[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def opened(path: str) -> Chunks:
    if path not in _OPEN:
        _OPEN[path] = Chunks(path)
    return _OPEN[path]
