"""Token ids of whole texts by a lower-casing BPE with word ends.

Such a tokenizer drops white space and never merges across its pre-tokens (runs
of letters, single digits, contractions, runs of anything else), so a text's ids
are those of its pre-tokens in turn. Pre-tokens are found for a whole block of
texts at a time, numbered by Arrow's dictionary encoding, and each distinct one
is coded once: new ones many at a time, as one text, in which each ends at the
first id that stands for a word end.

* Cutting here is done for texts of ASCII, letters of the Latin-1 and Latin
  Extended-A blocks, and the usual signs of Latin text. These letters stay single
  letters when normalised and lower-cased (U+0130, which becomes two characters,
  is left out), so the cuts are the tokenizer's own.
* A text with any other character is cut at ASCII white space only, and its
  words go whole through the tokenizer.
* With ``added_tokens``, a text that holds the string of an added token goes
  whole through the plain tokenizer, which gives that string its single id.

Defined cases: a null or empty text has no ids; a text of any length is coded
whole.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACES, byte_column

#: Pre-tokens (and, apart, words) kept per Python worker; the cache starts anew beyond it.
CACHED = 250_000
_SPACE, _LETTER, _DIGIT, _SIGN, _HARD = range(5)


def _kind_table() -> np.ndarray:
    table = np.full(256, _HARD, np.uint8)
    table[:128] = _SIGN
    table[list(SPACES)] = _SPACE
    table[ord("0"):ord("9") + 1] = _DIGIT
    for first in b"aA":
        table[first:first + 26] = _LETTER
    return table


_KINDS = _kind_table()
#: Second bytes behind 0xC2 of signs that are no letter, digit or white space, and change in no normal form.
_C2_SIGNS = np.isin(np.arange(256), [*range(0xA1, 0xAA), 0xAB, 0xAC, 0xAD, 0xAE, 0xAF, 0xB0, 0xB1, 0xB4, 0xB6, 0xB7, 0xB8, 0xBB, 0xBF])


def _kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of every byte of ``buf`` (UTF-8, two bytes of white space at the end)."""
    kind = _KINDS[buf]
    at = np.flatnonzero(buf >= 0xC2)
    lead, second = buf[at], buf[at + 1]
    of = np.full(len(at), _HARD, np.uint8)
    of[(lead == 0xC2) & _C2_SIGNS[second]] = _SIGN
    of[(lead == 0xC3) | (lead == 0xC4) & (second != 0xB0) | (lead == 0xC5)] = _LETTER
    of[(lead == 0xC3) & ((second == 0x97) | (second == 0xB7))] = _SIGN
    third = buf[np.minimum(at + 2, len(buf) - 1)]
    of[(lead == 0xE2) & (second == 0x80) & (third >= 0x90) & (third <= 0xA7)] = _SIGN  # dashes, quotation marks, bullets
    kind[at] = of
    kind[at + 1] = of
    three = at[lead == 0xE2]
    kind[three + 2] = kind[three]
    return kind


class WordTokenizer:
    """``encode_column`` gives the ids of an Arrow column; ``path`` names the tokenizer's file."""

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words: dict[bytes, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of_worker(cls, path: str, added_tokens: bool = False) -> "WordTokenizer":
        """One per Python worker process, path and flag, kept between tasks."""
        held = sys.modules.setdefault("_ranklab_tokenizers", types.ModuleType("_ranklab_tokenizers")).__dict__
        key = f"{path} {added_tokens}"
        if key not in held:
            held[key] = cls(path, added_tokens)
        return held[key]

    def _learn(self, new: list[bytes]) -> None:
        """Code pre-tokens."""
        self.places.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        begin, size, ids, known = [self.begin], [self.size], [self.ids], len(self.ids)
        for at in range(0, len(new), 20_000):
            some = b" ".join(new[at:at + 20_000]).decode().lower()
            found = np.array(self.tokenizer.encode_batch_fast([some], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) != len(new[at:at + 20_000]):
                raise ValueError("this tokenizer does not mark the ends of words")
            size.append(np.diff(ends, prepend=0))
            begin.append(known + ends - size[-1])
            ids.append(found)
            known += len(found)
        self.begin, self.size, self.ids = map(np.concatenate, (begin, size, ids))

    def _cut(self, buf: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in lower-cased ``buf``."""
        start = np.empty(len(buf), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _DIGIT
        start &= kind != _SPACE
        # a contraction is an apostrophe that begins a run of signs, with the letters behind it
        q = np.flatnonzero((buf[:-4] == ord("'")) & start[:-4])
        q = q[kind[q + 1] == _LETTER]
        a, b = buf[q + 1], buf[q + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for found, n in ((q[one], 1), (q[two], 2)):
            start[found + 1] = False
            start[found + 1 + n] = kind[found + 1 + n] != _SPACE
        return np.flatnonzero(start)

    def _simple(self, buf: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each row) of rows that begin at ``rows`` and end in white space."""
        buf = buf | ((buf >= ord("A")) & (buf <= ord("Z"))).astype(np.uint8) << 5
        at = self._cut(buf, kind)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        ink = kind != _SPACE
        upto = np.cumsum(ink, dtype=np.int32)
        cuts = np.append(upto[at] - 1, upto[-1])
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(buf[ink])]).dictionary_encode()
        values, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.places) > CACHED:
            self._forget()
        if new := [v for v in values if v not in self.places]:
            self._learn(new)
        places = np.fromiter(map(self.places.__getitem__, values), np.int64, len(values))
        size, begin = self.size[places][codes], self.begin[places][codes]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        return ids, np.diff(upto[np.append(np.searchsorted(at, rows), len(at))])

    def _plain(self, text: str) -> np.ndarray:
        """By the plain tokenizer, which knows its added tokens."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _by_words(self, text: str) -> np.ndarray:
        if len(self.words) > CACHED:
            self.words.clear()
        words = text.encode().split()
        if new := list(set(words).difference(self.words)):
            found = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            self.words.update((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(new, found))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        plain = np.zeros(len(texts), bool)
        for a in self.added:
            plain |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        data, starts, ends = byte_column(pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
        data = np.concatenate([data[starts[0]:ends[-1]], np.frombuffer(b"\n\n\n\n", np.uint8)])
        starts, kind = starts - starts[0], _kinds(data)
        hard = np.add.reduceat(kind == _HARD, starts) > 0
        slow = plain | hard
        if not slow.any():
            return self._simple(data, kind, starts)
        ids, sizes = self.encode_column(texts.filter(pa.array(~slow)))
        apart = [self._plain(t) if whole else self._by_words(t)
                 for t, whole in zip(texts.filter(pa.array(slow)).to_pylist(), plain[slow])]
        counts = np.empty(len(texts), np.int64)
        counts[~slow], counts[slow] = sizes, [len(x) for x in apart]
        out, of_slow = np.empty(counts.sum(), np.uint32), np.repeat(slow, counts)
        out[~of_slow], out[of_slow] = ids, np.concatenate(apart)
        return out, counts

    def encode_documents(self, texts: pa.Array, end_id: int) -> tuple[bytes, np.ndarray]:
        """(ids as little-endian unsigned 32-bit numbers, ``end_id`` behind each text's, and how many each has with it)."""
        ids, sizes = self.encode_column(texts)
        return np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes(), sizes + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        ids, sizes = self.encode_column(pa.array(texts, pa.large_string()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]
