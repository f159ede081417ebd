"""Whole-text encoding with a public byte-level BPE tokenizer, memoised by unit.

The tokenizer splits a text before merging, and none of its pre-tokens spans a
change from a non-space to a white-space character.  A text can therefore be
cut at every such change, each unit encoded on its own, and the ids joined:
the result equals encoding the whole text (tests/llm checks this).  Texts that hold an added
token (as ``<|endoftext|>``) go to the tokenizer whole.  Natural
text repeats its units, so a worker has each word with the blank in front
encoded once, and looks it up by a hash of its bytes (see ``hashed_words``) for
a whole column at a time.  The worker's table is bounded: beyond ``MEMO_WORDS``
words or ``MEMO_IDS`` ids it is emptied.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from . import hashed_words

#: The Unicode White_Space characters.
SPACES = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNITS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: ASCII marks: behind a letter or digit a pre-token ends (but not always before an apostrophe).
MARKS = np.frombuffer(b".,;:!?|)$%&#*", np.uint8)
#: What stands in front of a word.
HEAD, BLANK, BREAK = 1, 2, 3
_IS_MARK = np.isin(np.arange(256), MARKS)
_IS_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_IS_SPACE = np.array([c == 0x20 or 9 <= c <= 13 for c in range(256)])
#: Bounds of a worker's table: about 50 MB and 16 MB.
MEMO_WORDS, MEMO_IDS = 1_000_000, 4_000_000
JOINED = 512
BPE_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BPE_FILE) -> str:
    """Place of a public tokenizer file (installed with the environment)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd_rows(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """Texts with a blank at the start or after a white-space character: there a word with
    its blank is not a unit."""
    before = np.where(blanks > 0, data[blanks - 1], 0) if len(blanks) else np.empty(0, np.uint8)
    bad = (before == 0x20) | (before >= 9) & (before <= 13)
    far = np.flatnonzero((before >= 0x80) & (blanks >= 3))  # ends of longer characters: look at all of it
    if len(far):
        a, b, c = (data[blanks[far] - k].astype(np.int64) for k in (3, 2, 1))
        three = a << 16 | b << 8 | c
        bad[far] |= ((b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (three >= 0xE28080) & (three <= 0xE2808A)
                     | np.isin(three, (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)))
    bad |= (before >= 0x80) & (blanks < 3)  # too near the chunk's begin to tell
    at_start = np.isin(blanks, offsets[:-1])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, blanks[bad | at_start], "right") - 1] = True
    return out


def _plain_breaks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Line breaks between two ASCII characters that are no white space."""
    at = np.flatnonzero(data[1:-1] == 0x0A) + 1
    a, b = data[at - 1], data[at + 1]
    at = at[~_IS_SPACE[a] & (a < 0x80) & ~_IS_SPACE[b] & (b < 0x80)]
    return at[~np.isin(at, offsets) & ~np.isin(at + 1, offsets)]


def _tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a word's closing marks begin, if a letter or digit stands before them; else its end."""
    at = ends.copy()
    left = np.flatnonzero(ends > starts)
    while len(left):
        left = left[_IS_MARK[data[at[left] - 1]]]
        at[left] -= 1
        left = left[at[left] > starts[left]]
    cut = np.flatnonzero(at < ends)
    bad = cut[(at[cut] == starts[cut]) | ~_IS_ALNUM[data[at[cut] - 1]]]
    at[bad] = ends[bad]
    return at


class UnitEncoder:
    """Encode texts to little-endian unsigned ids of ``width`` bytes each."""

    def __init__(self, path: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{width}")
        #: Added tokens stand for themselves wherever they are: texts that hold one are encoded whole.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        size = self.tokenizer.get_vocab_size()
        self.blank_first = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self._clear()
        self.blank, self.line = self.whole([" ", "\n"])

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts straight from the tokenizer."""
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def after_blank(self, words: list[str]) -> dict[str, bytes]:
        """Ids of ``" " + word`` for words without blanks: many are encoded as
        one text and parted where a token begins with the blank."""
        out: dict[str, bytes] = {}
        step = self.dtype.itemsize
        groups = [words[k:k + JOINED] for k in range(0, len(words), JOINED)]
        for some, raw in zip(groups, self.whole([" " + " ".join(g) for g in groups]), strict=True):
            cut = np.flatnonzero(self.blank_first[np.frombuffer(raw, self.dtype)]) * step
            out.update(zip(some, map(raw.__getitem__, map(slice, cut.tolist(), [*cut[1:].tolist(), len(raw)])), strict=True))
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and their number per text; null texts are empty."""
        if self.table.size > MEMO_WORDS or len(self.ids) > MEMO_IDS:
            self._clear()
        flat, counts = [], []
        for _, _, data, offsets in hashed_words.chunks(texts):
            ids, n = self._chunk(data, offsets)
            flat.append(ids)
            counts.append(n)
        return np.concatenate([np.empty(0, self.dtype), *flat]), np.concatenate([np.empty(0, np.int64), *counts])

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blanks = np.flatnonzero(data == 0x20)
        odd = _odd_rows(data, offsets, blanks)
        special = self._special_rows(data, offsets)
        odd[special] = True
        splits = np.sort(np.concatenate([blanks, _plain_breaks(data, offsets)]), kind="stable")
        starts, ends, words = hashed_words.cut(data, offsets, splits)
        # A word's kind is what stands in front: nothing at a text's head, a blank, or a line break.
        kind = np.where(data[starts - 1] == 0x0A, BREAK, BLANK) if len(data) else np.full(len(starts), BLANK)
        kind[np.cumsum(words) - words] = HEAD
        tails = _tails(data, starts, ends)
        mine = np.flatnonzero(tails < ends)
        key = hashed_words.hashes(data, np.concatenate([starts, tails[mine]]), np.concatenate([tails, ends[mine]]))
        kind = np.concatenate([kind, np.full(len(mine), HEAD)])
        key = hashed_words.mixed(key + kind.astype(np.uint64))
        number = self.table.find(key)
        lack = np.flatnonzero(number < 0)
        if len(lack):
            new, which, back = np.unique(key[lack], return_index=True, return_inverse=True)
            which = lack[which]
            raw = data.tobytes()
            a, e = np.concatenate([starts, tails[mine]])[which].tolist(), np.concatenate([tails, ends[mine]])[which].tolist()
            self._learn(new, [raw[x:y].decode() for x, y in zip(a, e, strict=True)], kind[which].tolist())
            number[lack] = self.table.find(new)[back]
        # Each word and, behind it, the marks cut off (number 0 stands for none).
        both = np.zeros((len(starts), 2), np.int64)
        both[:, 0] = number[:len(starts)]
        both[mine, 1] = number[len(starts):]
        size = self.size[both]
        flat = size.ravel()
        total = int(flat.sum())
        ids = self.ids[np.arange(total) + np.repeat(self.first[both.ravel()] - np.cumsum(flat) + flat, flat)]
        row = np.repeat(np.arange(len(words)), words)
        counts = np.bincount(row, size.sum(1), len(words)).astype(np.int64)
        if odd.any():
            parts, at = [], 0
            for k, n in enumerate(counts.tolist()):
                if odd[k]:
                    text = data[offsets[k]:offsets[k + 1]].tobytes().decode()
                    parts.append(np.frombuffer(b"".join(self.whole([text] if k in special else _UNITS.findall(text))), self.dtype))
                    counts[k] = len(parts[-1])
                else:
                    parts.append(ids[at:at + n])
                at += n
            ids = np.concatenate(parts)
        return ids, counts

    def _special_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that hold an added token."""
        raw, rows = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    rows.add(row)
                    at = raw.find(token, int(offsets[row + 1]))
                else:  # its bytes are parted over two texts
                    at = raw.find(token, at + 1)
        return sorted(rows)

    def _learn(self, keys: np.ndarray, words: list[str], kinds: list[int]) -> None:
        """Take new words into the table, encoded with what their kind has in front."""
        after = self.after_blank([w for w, k in zip(words, kinds, strict=True) if k == BLANK and w])
        after[""] = self.blank  # what a trailing blank leaves
        alone = list({w for w, k in zip(words, kinds, strict=True) if k != BLANK})
        bare = dict(zip(alone, self.whole(alone), strict=True))
        got = [after[w] if k == BLANK else bare[w] if k == HEAD else self.line + bare[w] for w, k in zip(words, kinds, strict=True)]
        self.table.add(keys)
        size = np.array([len(b) for b in got], np.int64) // self.dtype.itemsize
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), self.dtype)])

    def _clear(self) -> None:
        """An empty table but for number 0, which has no ids."""
        self.table = hashed_words.Table()
        self.table.add(np.zeros(1, np.uint64))
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, self.dtype)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The ids with an end id behind each text's."""
    out = np.full(len(ids) + len(counts), end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def encoder(path: str, width: int = 4) -> UnitEncoder:
    """The worker's encoder; its memo serves later tasks of the same worker."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = UnitEncoder(path, width)
    return _ENCODERS[path, width]
