"""Encoding with the tokenizers library, remembering chunks between safe boundaries.

Both vocabularies split a text before their merges, and no pre-token crosses from a non-space into a space or line
break. So a text may be cut before any space or line break that follows a non-space, each chunk encoded by itself,
and the ids joined: the result is that of the whole text. Chunks repeat, so a bounded memo saves most calls; the ids
of a batch are gathered from it in one step. A new chunk of Latin letters and ASCII marks has pre-tokens that are
known without the library's normaliser and splitter (its runs of letters and of marks), so they go to its model at
once; all others take the whole way. Tests compare with whole-text encoding.
"""

from __future__ import annotations

import os
import re

from itertools import chain, repeat

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each Spark task

from tokenizers import Tokenizer  # noqa: E402

#: Remembered chunks: packing follows other stages in the same workers, so it takes fewer.
FILES_MEMO, PACKING_MEMO = 600_000, 400_000
_encoders: dict[tuple[str, bool], ChunkEncoder] = {}
CUT = re.compile(r"(?<=\S)(?=[ \n])")
RUNS = re.compile(r"[ \n][ \n]")
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"  # without the apostrophe, which begins endings of their own
PLAIN, PART = re.compile(f"[{_LETTERS}{_MARKS}]+"), re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")
#: Characters as a byte-level vocabulary writes the bytes of their UTF-8 form: printable ones stand for themselves.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = dict.fromkeys(_SHOWN) | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
AS_BYTES = {i: "".join(chr(_BYTES[b] or b) for b in chr(i).encode()) for i in range(128, 256)}
SPACE = chr(_BYTES[32])


class ChunkEncoder:
    """Ids of texts; null counts as empty.

    ``white_space_dropped``: the vocabulary drops white space, so that chunks need no leading space. A text that holds
    the string of a special token goes to the library whole, which gives that token's id; with ``special_as_text`` such
    strings are ordinary text. The memo is emptied when it has ``memo_entries``.
    """

    LONG = 48  # longer chunks are encoded but not remembered

    def __init__(self, path: str, white_space_dropped: bool = False, memo_entries: int = FILES_MEMO, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.specials = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dropped, self.limit = white_space_dropped, memo_entries
        got = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = got[0] if len(got) == 1 else None
        self._empty()

    def _empty(self) -> None:
        self.slots: dict[str, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used, self.entries = np.zeros(1 << 18, np.uint32), 0, 0

    @classmethod
    def of(cls, path: str, white_space_dropped: bool = False) -> ChunkEncoder:
        """One for each worker process, so that its memo serves all tasks there."""
        if (path, white_space_dropped) not in _encoders:
            _encoders[path, white_space_dropped] = cls(path, white_space_dropped, PACKING_MEMO if white_space_dropped else FILES_MEMO)
        return _encoders[path, white_space_dropped]

    def _text(self, key: str) -> str:
        """A chunk of its key: a text's first chunk is marked by a zero character, a line break has no space before it."""
        if self.dropped:
            return key
        return key[1:] if key[:1] == "\x00" else key if key[:1] == "\n" else " " + key

    def _store(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places of new entries whose ids are parts of ``ids``."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.entries + len(start) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        place = np.arange(self.entries, self.entries + len(start))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[place], self.length[place] = start + self.used, length
        self.used += len(ids)
        self.entries += len(start)
        return place

    def _plain(self, key: str) -> list[int] | None:
        """The ids of a chunk whose pre-tokens are known; None for others."""
        first = key[:1]
        body = key[1:] if not self.dropped and first in ("\x00", "\n") else key
        if not PLAIN.fullmatch(body) or first == "\n" and self.line_break is None:
            return None
        out = [self.line_break] if first == "\n" and not self.dropped else []
        space = SPACE if not self.dropped and body is key else ""
        if self.dropped:
            body = body.lower()
        for part in PART.findall(body):
            out += [t.id for t in self.tokenizer.model.tokenize(space + (part if part.isascii() else part.translate(AS_BYTES)))]
            space = ""
        return out

    def _learn(self, keys: list[str]) -> np.ndarray:
        """Entries of keys that the memo lacks; a length of -1 marks a chunk after which no cut may follow."""
        got = list(map(self._plain, keys))
        odd = [i for i, x in enumerate(got) if x is None]
        texts = [self._text(keys[i]) for i in odd]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if odd else (), strict=True):
            got[i] = e.ids
        length = np.fromiter(map(len, got), np.int64, len(got))
        start = np.cumsum(length) - length
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(length.sum()))
        if not self.dropped:
            length[[i for i, t in zip(odd, texts, strict=True) if t[-1:].isspace()]] = -1
        place = self._store(ids, start, length)
        for key, at in zip(keys, place.tolist(), strict=True):
            if len(key) <= self.LONG:
                self.slots[key] = at
        return place

    def _places(self, keys: list[str]) -> np.ndarray:
        if self.entries > self.limit:
            self._empty()
        out = np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))
        holes = np.flatnonzero(out < 0).tolist()
        if holes:
            new = {k: i for i, k in enumerate(dict.fromkeys(keys[i] for i in holes))}
            out[holes] = self._learn(list(new))[[new[keys[i]] for i in holes]]
        return out

    def _alone(self, text: str) -> np.ndarray:
        """The ids of one text, with cuts only where a non-space stands before them; whole if it names a special token."""
        if any(s in text for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array([i for e in self.tokenizer.encode_batch_fast(CUT.split(text), add_special_tokens=False) for i in e.ids], np.uint32)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them)."""
        keys: list[str] = []
        rows, apart = [0], set()
        for i, text in enumerate(column.to_pylist()):
            if not text:
                pass
            elif any(x in text for x in self.specials) or not self.dropped and ("\x00" in text or RUNS.search(text)):
                apart.add(i)
            elif self.dropped:
                keys += text.replace("\n", " ").split(" ")
            else:
                keys += ("\x00" + text.replace("\n", " \n")).split(" ")
            rows.append(len(keys))
        rows = np.array(rows)
        place = self._places(keys)
        length = self.length[place]
        if (length < 0).any():
            bad = np.concatenate([[0], np.cumsum(length < 0)])
            apart |= set(np.flatnonzero(bad[rows[1:]] > bad[rows[:-1]]).tolist())
            length = np.maximum(length, 0)
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.start[place] - ends[:-1], length) + np.arange(ends[-1])]
        offsets = ends[rows]
        if apart:
            pieces = [self._alone(column[i].as_py()) if i in apart else ids[offsets[i] : offsets[i + 1]] for i in range(len(column))]
            ids, offsets = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        return ids, offsets

    def with_end(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """As above, with ``end_id`` after each text."""
        ids, offsets = self.encode_column(column)
        if end_id is None:
            return ids, offsets
        n = len(offsets) - 1
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
        return out, offsets + np.arange(n + 1)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit bytes."""
        if not texts:
            return []
        ids, offsets = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
