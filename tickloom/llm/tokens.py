"""Token ids of whole texts by a public byte-level BPE tokenizer, with a bounded memory of stretches already encoded.

A tokenizer of this family cuts a text in pieces before it merges bytes, and a piece takes at most one space, at its
start. So a single space or newline between other characters always begins a piece, and the ids of a text are those of
its stretches between such places, one after the other. Stretches repeat; each is given to the library once, as long as
it is remembered. A text with any other white space, or with the string of an added token, which the library cuts out
before all else, goes to the library whole, and so does every text with a tokenizer of any other family.
"""

from __future__ import annotations

import array
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, and separators that some libraries count as such.
_BLANK = re.compile("[\t-\r\x1c-\x20\x85\xa0 ᠎ -​    　﻿]").search
#: Those that send a text to the library whole.
_ODD = "[" + "".join(rf"\x{{{c:x}}}" for c in range(0x10000) if not 0xD800 <= c < 0xE000 and c not in (10, 32) and _BLANK(chr(c))) + "]"
_FIRST = "\t"  # marks a text's first stretch; not a character of a text that is cut
_TAIL = ".,!?;:&#$%*"  # a run of these after letters is a piece of its own
_NONE, _SPACE = (pa.scalar(x, pa.large_string()) for x in ("", " "))
JOINED = 500  # stretches that go to the library as one text
_encoders: dict[int, Encoder] = {}


def cuts_at_spaces(spec: str) -> bool:
    """Whether a tokenizer's JSON says that it is of this family, with nothing done to a text before or after."""
    told = json.loads(spec)
    before = told.get("pre_tokenizer") or {}
    plain = not told.get("normalizer") and not told.get("truncation") and not told.get("padding")
    own = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return bool(plain and own and (told.get("model") or {}).get("type") == "BPE")


def encoder(spec: str, most: int, across_tasks: bool) -> Encoder:
    """One for each worker process and tokenizer, so that what it remembers outlives a task; or one for this task."""
    if not across_tasks:
        _encoders.clear()
        return Encoder(spec, most)
    key = hash((spec, most))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec, most)
    return _encoders[key]


class Encoder:
    """bytes of little-endian unsigned 32-bit ids for each text, equal to the library's own encoding of it. What is
    remembered takes about `most` bytes.

    Texts are cut, and their stretches told apart, as arrays. New stretches go to the library many in one text, as each
    begins with a space or newline, and so with an id that no other place of a stretch has.
    """

    def __init__(self, spec: str, most: int = 256 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.most = most
        self.whole = not cuts_at_spaces(spec)
        words = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(words.values(), default=0) + 1, bool)
        self.begins[[k for w, k in words.items() if w[:1] in ("\u0120", "\u010a")]] = True  # a space, a newline
        self.joins = not any(_BLANK(t) for t in self.added)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.first, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def _held(self) -> int:
        """With the table of a search."""
        return self.known.nbytes + self.flat.nbytes + 45 * len(self.known)

    def _library(self, raw: list[str]) -> list[bytes]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)]
        flat = array.array("I", itertools.chain.from_iterable(ids)).tobytes()
        cuts = [0, *itertools.accumulate([4 * len(x) for x in ids])]
        return [flat[a:b] for a, b in itertools.pairwise(cuts)]

    def _ids(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches, each after a space or with its newline, one after the other; how many each has."""
        n = len(stretches)
        if self.joins and n:
            lists = pa.LargeListArray.from_arrays(pa.array([*range(0, n, JOINED), n], pa.int64()), stretches)
            got = self.tokenizer.encode_batch_fast(_spaced(pc.binary_join(lists, _SPACE)), add_special_tokens=False)
            flat = np.concatenate([np.array(x.ids, np.uint32) for x in got])
            at = np.flatnonzero(self.begins[flat])
            if len(at) == n and at[0] == 0:
                return flat, np.diff(at, append=len(flat))
        return _flat(self._library(_spaced(stretches)))

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Ids of new stretches as they stand in a text; the place of each. A count of -1 is that of one that doesn't begin
        and end at pieces' ends."""
        size = pc.binary_length(new).to_numpy()
        marked = pc.starts_with(new, _FIRST).to_numpy(zero_copy_only=False)
        odd = (size == 0) | (size == 1) & (marked | pc.equal(new, "\n").to_numpy(zero_copy_only=False))
        alone = marked & ~odd
        order = np.concatenate([np.flatnonzero(x) for x in (~odd & ~alone, alone, odd)])
        first = [s[1:] for s in new.filter(pa.array(alone)).to_pylist()]
        parts = [self._ids(new.filter(pa.array(~odd & ~alone))), _flat(self._library(first)), (np.zeros(0, np.uint32), np.full(int(odd.sum()), -1))]
        at = np.empty(len(new), np.int64)
        at[order] = len(self.known) + np.arange(len(new))
        self._add(new.take(pa.array(order)), *map(np.concatenate, zip(*parts)))
        return at

    def _add(self, stretches: pa.Array, flat: np.ndarray, count: np.ndarray) -> None:
        held = np.maximum(count, 0)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(held) - held])
        self.count = np.concatenate([self.count, count.astype(np.int32)])
        self.used = np.concatenate([self.used, np.zeros(len(count), bool)])
        self.flat = np.concatenate([self.flat, flat])
        self.known = pa.concat_arrays([self.known, stretches])

    def _lessen(self) -> None:
        """What wasn't asked for again is forgotten, or else all."""
        keep = np.flatnonzero(self.used)
        first, count = self.first[keep], self.count[keep]
        held = np.maximum(count, 0)
        self.known = self.known.take(pa.array(keep))
        self.flat = self.flat[_spread(first, held)]
        self.first, self.count, self.used = np.cumsum(held, dtype=np.int64) - held, count, np.zeros(len(keep), bool)
        if self._held() > self.most // 2:
            self._forget()

    def _places(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different stretches: where ids begin, how many, and the ids that these are places of. Letters with a run of
        marks after them are two pieces, and remembered as such."""
        if self._held() > self.most:
            self._lessen()
        base = pc.utf8_rtrim(stretches, _TAIL)
        two = pc.and_(pc.utf8_is_alpha(base), pc.not_equal(pc.binary_length(base), pc.binary_length(stretches)))
        keys = pc.if_else(two, base, stretches).dictionary_encode()
        at = pc.index_in(keys.dictionary, value_set=self.known)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        self.used[place[place >= 0]] = True
        if at.null_count:
            place[place < 0] = self._learn(keys.dictionary.filter(at.is_null()))
        place = place[keys.indices.to_numpy()]
        first, count, which = self.first[place], self.count[place], np.flatnonzero(two.to_numpy(zero_copy_only=False))
        if not len(which):
            return first, count, self.flat
        marked, base = stretches.take(pa.array(which)), base.take(pa.array(which))
        size, long = pc.binary_length(base).to_numpy(), pc.binary_length(marked).to_numpy() - pc.binary_length(base).to_numpy()
        begin = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked)] + size
        ends = np.cumsum(np.concatenate([[0], long]))
        tails = pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(np.frombuffer(marked.buffers()[2], np.uint8)[_spread(begin, long)])]).dictionary_encode()
        ids, many = _flat(self._library(tails.dictionary.to_pylist()))
        tail, before = tails.indices.to_numpy(), np.cumsum(many) - many
        more, own = many[tail], count[which].astype(np.int64)
        both = own + more
        start = np.cumsum(both) - both
        out = np.empty(int(both.sum()), np.uint32)
        out[_spread(start, own)] = self.flat[_spread(first[which], own)]
        out[_spread(start + own, more)] = ids[_spread(before[tail], more)]
        first[which], count[which] = len(self.flat) + start, both
        return first, count, np.concatenate([self.flat, out])

    def encode(self, raw: list[str | None]) -> list[bytes]:
        if self.whole:
            return self._library([t or "" for t in raw])
        texts = pa.array([t or "" for t in raw], pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD)
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = odd.to_numpy(zero_copy_only=False)
        cut = [_FIRST + t if t and not o else "" for t, o in zip(raw, odd.tolist())]
        own = pc.split_pattern(pc.replace_substring(pa.array(cut, pa.large_string()), "\n", " \n"), " ")
        ends = own.offsets.to_numpy()
        coded = own.flatten().dictionary_encode()
        first, count, flat = self._places(coded.dictionary)
        at = coded.indices.to_numpy()
        first, count = first[at], count[at].astype(np.int64)
        # a text that is empty, or cut nowhere, is one stretch without ids
        bad = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count < 0, out=bad[1:])
        none = np.array([not t for t in cut])
        odd |= (bad[ends[1:]] > bad[ends[:-1]]) & ~none
        count = np.maximum(count, 0)
        flat = flat[_spread(first, count)]
        ends = np.concatenate([[0], np.cumsum(count)])[ends].tolist()
        out = [flat[a:b].astype("<u4").tobytes() for a, b in itertools.pairwise(ends)]
        which = np.flatnonzero(odd).tolist()
        for i, ids in zip(which, self._library([raw[i] for i in which])):
            out[i] = ids
        return out


def _spaced(stretches: pa.Array) -> list[str]:
    """With a space before each that doesn't begin with a newline."""
    return pc.replace_substring(pc.binary_join_element_wise(_NONE, stretches, _SPACE), " \n", "\n").to_pylist()


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after the other, and how many each has."""
    return np.frombuffer(b"".join(ids), "<u4").astype(np.uint32), np.array([len(x) // 4 for x in ids], np.int64)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, length of each, one after the other."""
    total = int(length.sum())
    kind = np.int32 if max(total, int(start.max(initial=0))) < 1 << 30 else np.int64
    before = np.cumsum(length) - length
    return np.repeat((start - before).astype(kind), length) + np.arange(total, dtype=kind)
