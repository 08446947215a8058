"""Streaming byte-level BPE.

The encoder is a transducer over blocks of text. Two bounds make its output final while it
still waits for more input:

* The pre-tokeniser looks at most ``PATTERN_AHEAD`` characters beyond a match, so a match
  that ends earlier than that before the buffer's end cannot change.
* Within a pre-token the merges look a bounded number of bytes ahead. Text to the right of a
  merge (x, y) can only prevent or change it by taking a constituent x' on the right edge of y
  into a merge (x', y') that ranks before the merge which takes x' into y, or, for x' = y,
  before (x, y) itself. Ranks fall along such a chain, so the chains are paths of a DAG, and
  the longest sum of ``len(y)`` over one is a sufficient lookahead (`MergeTable.lookahead`).

A pre-token longer than the window is encoded window by window: the tokens that end at least
``lookahead`` bytes before the window's end are emitted, and the next window starts after the
last of them, which is right because no merge of the whole crosses a boundary between two of
its final tokens. The state is one block, one window and a memo of bounded size, whatever the
length of the text.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from .frames import at_task_end

#: The pre-token pattern of the byte-level vocabulary (a fixed value of its format).
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SPACE = regex.compile(r"\p{White_Space}")
PATTERN_AHEAD = 3
BLOCK_CHARS = 1 << 16
#: Entries of each of the two generations of a memo (pieces, words); a task drops them when it ends.
MEMO_ENTRIES = 400_000
NEVER = 1 << 60
NONE = (1 << 31) - 1
#: Odd multipliers of the two places of a pair.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(shown)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Ranks(dict):
    def __missing__(self, pair):
        return NEVER


class MergeTable:
    """Vocabulary and merges of a byte-level BPE file, with or without marks of word ends.

    Encoding by windows (`pretoken`) is for files without such marks.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.ids = list(range(size))  # one int object for each id
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.base = [self.ids[vocab[c]] for c in alphabet]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last = [self.ids[vocab[c + suffix]] for c in alphabet]  # of a byte that ends a word
        self.rank: dict[tuple[int, int], int] = _Ranks()
        self.merged: list[int] = []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.rank.setdefault((self.ids[vocab[a]], self.ids[vocab[b]]), r)
            self.merged.append(self.ids[vocab[a + b]])
        self.lookahead, self._table = self._lookahead(), None
        self.window = max(4096, 4 * (self.lookahead + max(map(len, self.bytes))))

    def _lookahead(self) -> int:
        made: dict[int, tuple[int, int, int]] = {}
        by_left: dict[int, tuple[list[int], list[int]]] = {}  # ranks ascending, longest reach so far
        longest = 0
        for (x, y), r in sorted(self.rank.items(), key=lambda kv: kv[1]):
            on, part, before = 0, y, r
            while True:
                ranks, reach = by_left.get(part, ((), ()))
                if k := bisect_left(ranks, before):
                    on = max(on, reach[k - 1])
                if part not in made:
                    break
                _, right, before = made[part]
                part = right
            far = len(self.bytes[y]) + on
            ranks, reach = by_left.setdefault(x, ([], []))
            ranks.append(r)
            reach.append(max(far, reach[-1] if reach else 0))
            longest = max(longest, far)
            made.setdefault(self.merged[r], (x, y, r))
        return longest

    def merge_short(self, ids: list[int]) -> list[int]:
        rank, merged = self.rank.__getitem__, self.merged
        while len(ids) > 1:
            ranks = list(map(rank, zip(ids, ids[1:])))
            low = min(ranks)
            if low == NEVER:
                break
            at = ranks.index(low)
            ids[at : at + 2] = [merged[low]]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """All merges, lowest rank first and leftmost among equals."""
        n = len(ids)
        if n <= 48:
            return self.merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank[ids[i], ids[i + 1]]) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.rank[ids[i], ids[j]] != r:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := self.rank[ids[i], ids[k]]) != NEVER:
                    heapq.heappush(heap, (q, i))
            if (h := before[i]) >= 0 and (q := self.rank[ids[h], ids[i]]) != NEVER:
                heapq.heappush(heap, (q, h))
        return [i for i in ids if i >= 0]

    def _slots(self) -> tuple[np.ndarray, np.ndarray]:
        """Pair keys and ranks in a table that is searched at two places (cuckoo hashing)."""
        if self._table is None:
            size = 1 << max(4, (4 * len(self.rank)).bit_length())
            keys, ranks = [-1] * size, [NONE] * size
            for (a, b), r in self.rank.items():
                k, slot = a << 32 | b, 0
                for _ in range(500):
                    at = (k * MIX[slot] & (1 << 64) - 1) >> 64 - size.bit_length() + 1
                    k, keys[at], r, ranks[at] = keys[at], k, ranks[at], r
                    if k < 0:
                        break
                    slot = int(at == (k * MIX[0] & (1 << 64) - 1) >> 64 - size.bit_length() + 1)
                else:
                    raise ValueError("no place for a pair")
            self._table = np.array(keys, np.int64), np.array(ranks, np.int32)
        return self._table

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self._slots()
        k = left.astype(np.int64) << 32 | right
        shift = np.uint64(64 - (len(keys).bit_length() - 1))
        i, j = ((k.view(np.uint64) * np.uint64(m) >> shift).view(np.int64) for m in MIX)
        return np.where(keys[i] == k, ranks[i], np.where(keys[j] == k, ranks[j], NONE))

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """`merge` of many short words at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, counts = self.merge_flat(np.frombuffer(b"".join(words), np.uint8), sizes)
        return np.split(ids, np.cumsum(counts)[:-1])

    def merge_flat(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`merge` of words given by their bytes, one after the other: all ids, and how many each word has.

        Each round makes the next merge of every word.
        """
        ids, ends = np.array(self.base, np.int32)[raw], np.cumsum(sizes) - 1
        ids[ends] = np.array(self.last, np.int32)[raw[ends]]
        of, merged = np.repeat(np.arange(len(sizes)), sizes), np.array(self.merged, np.int32)
        rank = np.full(len(ids), NONE, np.int32)
        rank[:-1] = np.where(of[1:] == of[:-1], self._ranks(ids[:-1], ids[1:]), NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            low = np.minimum.reduceat(rank, starts)
            if (over := low == NONE).any():
                end = np.repeat(over, lengths)
                done.append((of[end], ids[end]))
                ids, of, rank = ids[~end], of[~end], rank[~end]
                lengths, low = lengths[~over], low[~over]
                starts = np.cumsum(lengths) - lengths
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(low, lengths))
            at = at[np.r_[True, of[at[1:]] != of[at[:-1]]]]
            ids[at] = merged[low]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, of, rank = ids[keep], of[keep], rank[keep]
            at = at - np.arange(len(at))
            for here in (at, at[at > 0] - 1):
                here_next = np.minimum(here + 1, len(ids) - 1)
                same = (of[here_next] == of[here]) & (here_next > here)
                rank[here] = np.where(same, self._ranks(ids[here], ids[here_next]), NONE)
        of, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(sizes))

    def pretoken(self, token: str) -> Iterator[int]:
        """Ids of one pre-token of any length, window by window."""
        data = token.encode()
        start, n = 0, len(data)
        while start < n:
            out = self.merge([self.base[b] for b in data[start : start + self.window]])
            if start + self.window < n:
                end, keep, safe = 0, 0, self.window - self.lookahead
                for i in out:
                    if (to := end + len(self.bytes[i])) > safe:
                        break
                    end, keep = to, keep + 1
                out = out[:keep]
                start += end
            else:
                start = n
            yield from out


class _Kept(dict):
    """A memo of two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        if (ids := self.old.get(key)) is None:
            ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def fill(self, keys: list[str], ids: list[np.ndarray], dtype: np.dtype) -> None:
        if len(self) + len(keys) > self.entries:
            self.old = dict(self)
            self.clear()
        self.update(zip(keys, (x.astype(dtype).tobytes() for x in ids)))


class Encoder:
    """Text in, ids out: ``feed`` returns what has become final; at the end of a text, the rest.

    Ids are packed as numbers of ``dtype``.
    """

    def __init__(self, table: MergeTable):
        self.table, self.rest = table, ""
        self.code = "H" if len(table.ids) <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.words = _Kept(lambda word: array(self.code, table.pretoken(word)).tobytes(), MEMO_ENTRIES)
        self.memo = _Kept(self._piece, MEMO_ENTRIES)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None
        self.ahead = PATTERN_AHEAD + max([0, *(len(s) - 1 for s in table.special)])  # a special string may have begun

    def _piece(self, piece: str) -> bytes:
        """Ids of what stands between two single spaces or line ends; KeyError if it holds other white space."""
        line = piece[:1] == "\n"
        if piece in ("", "\n") or len(piece.split()) > 1 or SPACE.search(piece, 1 if line else 0):
            raise KeyError(piece)
        piece = piece if line else " " + piece
        return self.words[piece] if piece[1:].isalpha() and not line else b"".join(map(self.words.__getitem__, PRETOKEN.findall(piece)))

    def prime(self, texts: Iterable[str]) -> None:
        """Put the short words of a batch of texts that are not yet known into the memo, merged together."""
        known, more, pieces = self.memo, self.memo.old, set()
        for text in texts:
            pieces.update(text.replace("\n", " \n").split(" "))
        words = set()
        for piece in pieces:
            if piece not in known and piece not in more and len(piece) <= 64:
                words.update((" " + piece,) if piece.isalpha() else PRETOKEN.findall(piece if piece[:1] == "\n" else " " + piece))
        known, more = self.words, self.words.old
        words = [w for w in words if w not in known and w not in more]
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            self.words.fill(some, self.table.merge_many([w.encode() for w in some]), self.dtype)

    def _exact(self, text: str, final: bool) -> tuple[bytes, int]:
        """Ids by the pattern, and how much of ``text`` they take."""
        out: list[bytes] = []
        end, safe = 0, len(text) - self.ahead
        for m in PRETOKEN.finditer(text):
            if not final and m.end() > safe:
                break
            out.append(self.words[m[0]])
            end = m.end()
        return b"".join(out), end

    def _pieces(self, text: str) -> bytes:
        """Ids of a text that ends where a pre-token must end."""
        parts = text.replace("\n", " \n").split(" ")
        try:
            if not SPACE.search(parts[0]):
                return self._exact(parts[0], True)[0] + b"".join(map(self.memo.__getitem__, parts[1:]))
        except KeyError:
            pass
        return self._exact(text, True)[0]

    def _plain(self, text: str, final: bool) -> tuple[bytes, int]:
        if final:
            return self._pieces(text), len(text)
        at = text.rfind(" ", 1, max(1, len(text) - self.ahead))
        if at > 0 and not SPACE.match(text[at - 1]) and not SPACE.match(text[at + 1]):
            return self._pieces(text[:at]), at
        return self._exact(text, False)

    def feed(self, block: str, final: bool = False) -> bytes:
        text, out = self.rest + block, b""
        start = 0
        for m in self.specials.finditer(text) if self.specials else ():
            out += self._plain(text[start : m.start()], True)[0] + array(self.code, [self.table.special[m[0]]]).tobytes()
            start = m.end()
        ids, used = self._plain(text[start:], final)
        self.rest = "" if final else text[start + used :]
        return out + ids

    def stream(self, text: str, block: int = BLOCK_CHARS) -> Iterator[np.ndarray]:
        """The ids of a whole text, an array for each block."""
        self.rest = ""
        last = max(0, -(-len(text) // block) - 1) * block
        for at in range(0, last + 1, block):
            yield np.frombuffer(self.feed(text[at : at + block], at == last), self.dtype)

    def count(self, text: str) -> int:
        return sum(map(len, self.stream(text)))


class Decoder:
    """Ids in, text out: bytes wait until they complete a character; wrong ones give U+FFFD."""

    def __init__(self, table: MergeTable):
        self.bytes = table.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)), final)

    def finish(self) -> str:
        return self.state.decode(b"", True)


_TABLES: dict[str, MergeTable] = {}


def table(path: str) -> MergeTable:
    """One table, of one path, for each worker process."""
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, of one path, for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(table(path))
    return _ENCODERS[path]


@at_task_end
def _forget() -> None:
    for e in _ENCODERS.values():
        e.words.forget()
        e.memo.forget()
