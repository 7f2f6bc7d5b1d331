"""Subword pieces of a sentencepiece model file: normalisation with alignment, merging, decoding.

The model file is read as a protocol buffer. Text is normalised by the longest prefixes that the
compiled character map knows, looked up where a prefix may begin; what stands between is taken over
at once. Each normalised byte keeps the place of the original character that it came from, so every
piece is projected back. A model with an empty map takes the same way, without lookups. Pieces are made by popping the best-ranked adjacent pair from
a heap over a linked list of symbols; many new words of a batch are merged side by side, each step
taking the best-ranked pair of every word, which gives the same symbols. Where no piece of the vocabulary runs from a letter into a
following word-start mark, the text is cut there first: no merge can cross such a cut, the result
is the same and repeated words are merged once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Put between words to split them; a text that holds it is cut by pattern.
BORDER = "\x00"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of a generation of the per-process word tables; their bound costs time but no result.
TABLE = 100_000
#: Words longer than this many characters aren't kept in a table; words up to the shorter bounds are merged side by side.
LONG, WIDTHS = 64, (6, 9, 12, 16, 24)
#: Characters of texts whose words are gathered before they are merged, and words merged in one go.
GATHERED, TOGETHER = 1 << 20, 1 << 14
#: The rank of a pair that is no piece, and the first symbol of a character without one.
NONE, BYTES = 1 << 30, 1 << 22


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; values are ints or bytes."""
    at, n = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out, at
            shift += 7

    while at < n:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over bytes, then the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.out = blob[4 + size :]
        self.first = frozenset(b for b in range(256) if self.units and self.child(self.start(), b))
        self.begins = np.isin(np.arange(256), list(self.first))

    def start(self) -> int:
        return self.offset(self.units[0])

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def child(self, at: int, byte: int) -> bool:
        return (self.units[at ^ byte] & 0x800000FF) == byte

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix at a byte position, and its length."""
        if data[at] not in self.first:
            return None
        node, found = self.start(), None
        for n in range(at, len(data)):
            byte = data[n]
            if not byte or not self.child(node, byte):
                break
            node ^= byte
            unit = self.units[node]
            node ^= self.offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = self.out[value : self.out.index(b"\0", value)], n + 1 - at
        return found


@dataclass
class Encoding:
    """Ids, and the span of original UTF-8 bytes of each: pieces of one source character share it."""

    ids: list[int]
    begins: np.ndarray
    ends: np.ndarray


class Pieces:
    """A byte-pair model of sentencepiece pieces."""

    def __init__(self, path: str):
        blob = b""
        self.dummy, self.squeeze, self.escape, kind = True, True, True, 1
        names, scores, types = [], [], []
        with open(path, "rb") as f:
            model = f.read()
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                names.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(fields(value))
                blob, self.dummy, self.squeeze, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if kind != 2 or USER in types or UNUSED in types or not self.escape:
            raise ValueError("only byte-pair models without user-defined or unused pieces are supported")
        self.map = CharMap(blob)
        self.plain = not blob and not self.squeeze
        order = {s: n for n, s in enumerate(sorted({s for s, t in zip(scores, types, strict=True) if t == NORMAL}, reverse=True))}
        self.rank = {p: order[s] for p, s, t in zip(names, scores, types, strict=True) if t == NORMAL}
        self.id = {p: n for n, (p, t) in enumerate(zip(names, types, strict=True)) if t == NORMAL}
        self.unknown = types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): n for n, (p, t) in enumerate(zip(names, types, strict=True)) if t == BYTE}
        self.end = names.index("</s>") if "</s>" in names else None
        self.surface = [p.replace(MARK, " ").encode() if t == NORMAL else bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else b"" for p, t in zip(names, types, strict=True)]
        self.leads = [t == NORMAL and p.startswith(MARK) for p, t in zip(names, types, strict=True)]
        #: Bytes of each piece in normalised text.
        self.width = np.array([len(p.encode()) if t == NORMAL else 1 for p, t in zip(names, types, strict=True)], np.int64)
        self.text = [str(n) for n in range(len(names))]
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not any(MARK in p.lstrip(MARK) for p in self.id) else re.compile(r"(?s).+")
        self.marked_words = not any(MARK in p.lstrip(MARK) for p in self.id)
        #: Adjacent characters somewhere in a piece: a cut between two others can't be crossed by a merge.
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        #: Ids as a word's bytes: a text's are joined and read as one array.
        self.kind = np.dtype("<u2" if len(names) < 1 << 16 else "<u4")
        self.words, self.sizes = _Table(self.word), _Table(self.word_count)
        self._side = None
        self.widths = {n: size for low, size in zip((0, *WIDTHS), WIDTHS, strict=False) for n in range(low + 1, size + 1)}

    # -- normalisation

    def mapped(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes after the character map, and for each the place of the character it came from; one more place is the end."""
        n = len(data)
        at = np.arange(n + 1)
        lead = np.append((data & 0xC0) != 0x80, True)
        at = np.maximum.accumulate(np.where(lead, at, 0))
        places = np.flatnonzero(self.map.begins[data] & lead[:-1]).tolist()
        if not places:
            return data, at
        raw, out, source, done = data.tobytes(), [], [], 0
        for i in places:
            if i >= done and (found := self.map.longest(raw, i)):
                put, size = found
                out += [data[done:i], np.frombuffer(put, np.uint8)]
                source += [at[done:i], np.full(len(put), i)]
                done = i + size
        return np.concatenate([*out, data[done:]]), np.concatenate([*source, at[done:]])

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each the original position; one more position closes the last."""
        out, at = self.mapped(np.frombuffer(data, np.uint8))
        blank = out == 32
        if self.squeeze and blank.any():
            # blanks at the start, after another one, or at the end go
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            last = np.flatnonzero(keep & ~blank)
            stop = int(last[-1]) + 1 if len(last) else 0
            keep[stop:] = False
            out, blank, at = out[keep], blank[keep], np.append(at[:-1][keep], at[stop])
        put, at = out.tobytes().replace(b" ", MARK_BYTES), np.repeat(at, np.append(np.where(blank, len(MARK_BYTES), 1), 1))
        if self.dummy and put:
            put, at = MARK_BYTES + put, np.concatenate((np.repeat(at[:1], len(MARK_BYTES)), at))
        return put, at

    # -- merging

    def merged(self, word: str) -> tuple[list[int], int]:
        """Ends of the symbols by their starts (0 where no symbol starts) once no adjacent pair is a piece, and their number.

        A heap entry packs a pair's rank, start and end: the lowest rank comes first, then the leftmost.
        The symbols are a linked list, an end being the next one's start; an entry whose symbols have
        grown no longer fits the list and is passed over.
        """
        n, rank = len(word), self.rank.get
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(heap)
        end, before, left = list(range(1, n + 1)), list(range(-1, n)), n
        while heap:
            top = heappop(heap)
            stop = top & mask
            i = top >> bits & mask
            middle = end[i]
            if not i < middle < stop or end[middle] != stop:
                continue
            end[middle], end[i] = 0, stop
            left -= 1
            if stop < n:
                before[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    heappush(heap, (r << bits | i) << bits | end[stop])
            if i and (r := rank(word[before[i] : stop])) is not None:
                heappush(heap, (r << bits | before[i]) << bits | stop)
        return end, left

    def symbols(self, word: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece."""
        end, _ = self.merged(word)
        out, at = [], 0
        while at < len(word):
            out.append(word[at : end[at]])
            at = end[at]
        return out

    def side(self) -> tuple[np.ndarray, np.ndarray]:
        """For merging side by side: each character's symbol, and the symbols' ids; those of bytes, from ``BYTES`` on, stand for characters without a piece.

        Pairs of symbols are kept in an open table: a pair lies at its hash, or a few places on.
        """
        if self._side is None:
            symbols = {p: n for n, p in enumerate(dict.fromkeys([*self.rank, *(c for p in self.rank for c in p)]))}
            characters = (BYTES + np.arange(0x110000)).astype(np.int32)
            for p, n in symbols.items():
                if len(p) == 1:
                    characters[ord(p)] = n
            pairs = [(symbols[p[:i]], symbols[p[i:]], r, symbols[p]) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
            bits = max(4, (4 * len(pairs)).bit_length())
            self.left, self.right = np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int32)
            self.ranks, self.made = np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
            mask, self.reach = (1 << bits) - 1, 1
            for (x, y, r, m), at in zip(pairs, self.hashed(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)).tolist(), strict=True):
                far = 0
                while self.left[(at + far) & mask] >= 0:
                    far += 1
                at = (at + far) & mask
                self.left[at], self.right[at], self.ranks[at], self.made[at] = x, y, r, m
                self.reach = max(self.reach, far + 1)
            self._side = characters, np.array([self.id.get(p, -1) for p in symbols], np.int64)
        return self._side

    def hashed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = left.astype(np.int64) * 0x9E3779B1 + right.astype(np.int64) * 0x85EBCA77
        return (mixed ^ mixed >> 17) & (len(self.left) - 1)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols, and what they make; a negative symbol pairs with none."""
        at = self.hashed(left, right)
        same = (self.left[at] == left) & (self.right[at] == right)
        for _ in range(self.reach - 1):
            lost = np.flatnonzero(~same & (self.left[at] >= 0))
            if not len(lost):
                break
            at[lost] = (at[lost] + 1) & (len(self.left) - 1)
            same[lost] = (self.left[at[lost]] == left[lost]) & (self.right[at[lost]] == right[lost])
        return np.where(same & (left >= 0), self.ranks[at], NONE), self.made[at]

    def merged_together(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length or near it: the symbols of each are a linked list, and each step merges the best pair of every word."""
        characters, ids = self.side()
        n, width = len(words), max(map(len, words)) + 1
        points = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), "<u4").reshape(n, width)
        sizes = np.array([len(w) for w in words])
        # place p of word w is number p * n + w; a closing place without a symbol ends every list
        symbols = np.where(np.arange(width)[:, None] < sizes, characters[points.T], -1).ravel()
        ranks, made = np.full(width * n, NONE, np.int32), np.zeros(width * n, np.int32)
        inside = np.flatnonzero(symbols >= 0)
        ranks[inside], made[inside] = self.pairs(symbols[inside], symbols[inside + n])
        after, before = np.arange(n, (width + 1) * n), np.arange(-n, (width - 1) * n)
        by_place, own = ranks.reshape(width, n), np.arange(n)
        while True:
            at = by_place.argmin(axis=0) * n + own
            at = at[ranks[at] < NONE]
            if not len(at):
                break
            second = after[at]
            third = after[second]
            symbols[at], symbols[second], ranks[second] = made[at], -1, NONE
            after[at], before[third] = third, at
            ranks[at], made[at] = self.pairs(symbols[at], symbols[third])
            at = at[at >= n]
            last = before[at]
            ranks[last], made[last] = self.pairs(symbols[last], symbols[at])
        return self.ids_of(symbols.reshape(width, n).T, ids)

    def ids_of(self, symbols: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Ids of rows of symbols, in which negative ones are no more; a character without a piece is its bytes."""
        there = symbols >= 0
        known = np.where(there & (symbols < BYTES), ids[np.minimum(symbols, len(ids) - 1)], -1)
        step = self.kind.itemsize
        ends = (np.cumsum(there.sum(axis=1)) * step).tolist()
        flat = known[there].astype(self.kind).tobytes()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for n in np.flatnonzero((there & (known < 0)).any(axis=1)).tolist():
            row = symbols[n][there[n]].tolist()
            out[n] = self.packed([x for s in row for x in ((ids[s],) if s < BYTES and ids[s] >= 0 else self.spelled(s))])
        return out

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def spelled(self, symbol: int) -> list[int]:
        """The bytes of a character without a piece of its own."""
        text = chr(symbol - BYTES) if symbol >= BYTES else next(c for c in {c for p in self.rank for c in p} if self._side[0][ord(c)] == symbol)
        return [self.bytes[b] for b in text.encode()]

    def learned(self, words: set[str]) -> dict[str, bytes]:
        """What each of many words becomes: the new ones are merged together and put into the table, the longest are left to the heap."""
        out: dict[str, bytes] = {}
        by: dict[int, list[str]] = {}
        now, older, widths = self.words, self.words.older, self.widths
        again: dict[str, bytes] = {}
        for w in words:
            if (found := now.get(w)) is not None:
                out[w] = found
            elif (found := older.get(w)) is not None:
                again[w] = found
            elif size := widths.get(len(w)):
                by.setdefault(size, []).append(w)
            else:
                out[w] = now[w]
        for group in by.values():
            for at in range(0, len(group), TOGETHER):
                part = group[at : at + TOGETHER]
                again.update(zip(part, self.merged_together(part), strict=True))
        now.put_all(again)
        out.update(again)
        return out

    def stem(self, word: str) -> int:
        """Where the closing characters begin that no piece joins to what stands before them."""
        n = len(word)
        while n > 1 and word[n - 2 : n] not in self.inside:
            n -= 1
        return n

    def word(self, word: str) -> bytes:
        """Ids of a word; closing characters that can't merge are looked up by themselves."""
        stem = self.stem(word)
        if stem < len(word):
            return b"".join((self.words[word[:stem]], *(self.words[c] for c in word[stem:])))
        out: list[int] = []
        for s in self.symbols(word):
            if (found := self.id.get(s)) is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return self.packed(out)

    def cut_up(self, normalised: str) -> list[str]:
        """The words of a text, each with the mark before it; marks by themselves where there are more of them."""
        if self.marked_words and normalised.startswith(MARK) and not normalised.endswith(MARK) and MARK * 2 not in normalised:
            return normalised.replace(MARK, BORDER + MARK)[1:].split(BORDER) if BORDER not in normalised else self.cut.findall(normalised)
        return self.cut.findall(normalised)

    def ids(self, normalised: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.cut_up(normalised))), self.kind)

    def count(self, text: str) -> int:
        """Pieces of a text: symbols at the start less the merges, and a piece for each byte beyond the first of an unknown character. No ids are made."""
        return sum(map(self.sizes.__getitem__, self.cut.findall(self.marked(text))))

    def word_count(self, word: str) -> int:
        """Initial symbols minus merges over the heap and the linked list."""
        stem = self.stem(word)
        if stem < len(word):
            return sum(map(self.sizes.__getitem__, word[stem:]), self.sizes[word[:stem]])
        end, left = self.merged(word)
        if not self.bytes:
            return len(self.word(word)) // self.kind.itemsize
        return left + sum(len(c.encode()) - 1 for i, c in enumerate(word) if end[i] == i + 1 and c not in self.id)

    def marked(self, text: str) -> str:
        """The normalised text; where nothing is mapped or squeezed, places aren't needed to get it."""
        if self.plain:
            return (MARK if self.dummy and text else "") + text.replace(" ", MARK)
        return self.normalise(text.encode())[0].decode()

    # -- encoding and decoding

    def encode(self, text: str) -> Encoding:
        """Ids and spans: the widths of the pieces cut the normalised bytes, whose places project them on the text."""
        norm, at = self.normalise(text.encode())
        if not self.bytes:
            return self.spanned(*self.joined_unknown(self.cut.findall(norm.decode())), at)
        ids = self.ids(norm.decode())
        return self.spanned(ids.tolist(), np.cumsum(self.width[ids]), at)

    def encode_all(self, texts: list[str]) -> Iterator[Encoding]:
        """``encode`` for many texts: the new words of a run of them are merged together first."""
        # each text's words as ids, the places and words among them that the table lacks, and the places of its bytes
        held: list[tuple[list, list[tuple[int, str]], np.ndarray]] = []
        size = 0
        for n, text in enumerate(texts, 1):
            norm, at = self.normalise(text.encode())
            words = self.cut_up(norm.decode())
            if not self.bytes:
                yield self.spanned(*self.joined_unknown(words), at)
                continue
            found = list(map(self.words.get, words))
            held.append((found, [(i, words[i]) for i, ids in enumerate(found) if ids is None], at))
            size += len(text)
            if size > GATHERED or n == len(texts):
                known = self.learned({w for _, lacking, _ in held for _, w in lacking})
                for found, lacking, at in held:
                    for i, w in lacking:
                        found[i] = known[w]
                    ids = np.frombuffer(b"".join(found), self.kind)
                    yield self.spanned(ids.tolist(), np.cumsum(self.width[ids]), at)
                held, size = [], 0

    @staticmethod
    def spanned(ids: list[int], stops: np.ndarray, at: np.ndarray) -> Encoding:
        """Ids with their spans: where each ends in the normalised bytes, projected by the places of these."""
        starts = np.concatenate(([0], stops[:-1])) if ids else stops
        return Encoding(ids, at[starts], at[stops])

    def joined_unknown(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """Ids and ends where a run of unknown characters is one id."""
        ids, ends, where = [], [], 0
        for s in (s for w in words for s in self.symbols(w)):
            where += len(s.encode())
            found = self.id.get(s, self.unknown)
            if found == self.unknown and ids and ids[-1] == found:
                ends[-1] = where
            else:
                ids.append(found)
                ends.append(where)
        return ids, np.array(ends, np.int64)

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        data = b"".join(map(surface.__getitem__, ids))
        if (self.dummy or self.squeeze) and ids:
            first = next((i for i in ids if surface[i]), None)
            if first is not None and self.leads[first]:
                data = data[1:].lstrip(b" ") if self.squeeze else data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.decode_torn(ids)

    def decode_torn(self, ids: list[int]) -> str:
        """Runs of byte pieces that aren't UTF-8: each stray byte becomes U+FFFD."""
        out, run, first = [], bytearray(), True
        kinds = {v: k for k, v in self.bytes.items()}

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        if size == 4:
                            out.append("�")
                            at += 1
            run.clear()

        for i in ids:
            if i in kinds:
                run.append(kinds[i])
                first = False
                continue
            flush()
            text = self.surface[i].decode()
            if first and text and (self.dummy or self.squeeze):
                text = text[1:] if self.leads[i] else text
                first = False
            out.append(text)
        flush()
        return "".join(out)


class _Table(dict):
    """What ``make`` gives for a word. Two bounded generations: a full one becomes the older, and words asked for again move to the newer."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= LONG:
            self.put(word, found)
        return found

    def put(self, word: str, found) -> None:
        if len(self) >= TABLE:
            self.older = dict(self)
            self.clear()
        self[word] = found

    def put_all(self, found: dict) -> None:
        if len(self) + len(found) > TABLE:
            self.older = dict(self)
            self.clear()
        self.update(found)


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """One model for each path and process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]
