"""Merge-type piece vocabularies: a score-ordered agenda of adjacent symbol pairs, encoding, decoding, counting.

A text is encoded as the sentencepiece library does for a vocabulary whose normaliser is the identity: spaces
become U+2581, one is put in front, characters are the first symbols, and the adjacent pair whose join has the
highest score (the leftmost among equals) is joined until no join is in the vocabulary.  Characters that remain
outside the vocabulary become byte pieces.

No piece holds U+2581 after another character, and some characters (such as the line feed) are in no longer
piece, so joins never cross those places.  A text therefore falls into segments that encode alone, and segments
repeat: the agenda runs once for each distinct segment of a worker's cache, which is bounded by bytes, and each
new segment of any length is checked against the library, one call an Arrow batch.  Where the vocabulary has no
line feed that stands alone, whole texts are checked instead.  Whole texts are always encoded.

The agendas of a batch's new segments run in step: segments of one length are rows of a matrix, each round takes
every row's best pair, joins it and ranks the two pairs that it changed.  Long segments have an agenda each, and
are kept no longer than their batch.

Defined cases: null counts as empty; an empty text has no pieces (begin and end ids remain where asked for); a model
whose normaliser changes texts, or whose pieces hold a space after other characters, is refused.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np

SPACE = "▁"
#: Bytes that a worker's kept segments take, about; beyond that it starts anew.
CACHE_BYTES = 48_000_000
#: Of a kept segment beside its characters and ids: a place in a table and the heads of two objects.
ENTRY_BYTES = 190
#: Longer segments have an agenda of their own and are kept for their batch only.
IN_STEP_CHARS = 64
#: Texts that a normaliser other than the identity would change.
PROBES = ("\ufb01 \uff21 a\u0301  b", " x ", "a\nb\tc\u3000d\u200b")
#: Symbol number of a character outside the vocabulary, less its code point.
OUTSIDE = 1 << 20
NONE = np.iinfo(np.int32).max


class PairTable:
    """Hash table from pairs of symbols to the rank and number of their join, read in whole arrays."""

    BITS = 20
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        size = 1 << self.BITS
        keys = np.array([(l << 32) | r for l, r in pairs], dtype=np.uint64)
        vals = np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2)
        self.key = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.rank, self.join = np.full(size, NONE, dtype=np.int32), np.zeros(size, dtype=np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.key[slot] == np.iinfo(np.uint64).max
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.key[slot[put]] = keys[left[put]]
            self.rank[slot[put]], self.join[slot[put]] = vals[left[put], 0], vals[left[put], 1]
            left = np.delete(left, put)
            self.probes += 1

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((((key * self.FACTOR) >> np.uint64(64 - self.BITS)) + np.uint64(probe)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE for no join) and join of each pair."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        rank, join = np.full(key.shape, NONE, dtype=np.int32), np.zeros(key.shape, dtype=np.int32)
        todo = np.arange(key.size)
        for probe in range(self.probes):
            slot = self._slot(key.ravel()[todo], probe)
            there = self.key[slot]
            hit = there == key.ravel()[todo]
            rank.ravel()[todo[hit]], join.ravel()[todo[hit]] = self.rank[slot[hit]], self.join[slot[hit]]
            todo = todo[~hit & (there != np.iinfo(np.uint64).max)]
            if not len(todo):
                break
        return rank, join


class _Cache(dict):
    """Segments and what was made of them, with the bytes that they take."""

    def __init__(self):
        super().__init__()
        self.bytes = 0

    def learn(self, segments: list[str], made: list) -> None:
        self.update(zip(segments, made, strict=True))
        self.bytes += sum(map(len, segments)) * 5 + ENTRY_BYTES * len(segments)  # at most 4 bytes of ids a character and 1 of its own, mostly

    def make_room(self) -> None:
        if self.bytes > CACHE_BYTES:
            self.clear()
            self.bytes = 0


class Pieces:
    """A merge-type vocabulary, read from the bytes of its model file."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk, self.check = sp.bos_id(), sp.eos_id(), sp.unk_id(), check
        if any(sp.normalize(t) != SPACE + t.replace(" ", SPACE) for t in PROBES):
            raise ValueError("the model's normaliser changes texts")
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id, self.rank, self.id, self.raw = {}, {}, {}, [b""] * n
        scored = []
        for i, p in enumerate(names):
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_id[b], self.raw[i] = i, bytes([b])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not sp.is_control(i) and not sp.is_unused(i):
                self.id[p], self.raw[i] = i, p.replace(SPACE, " ").encode()
                scored.append((-sp.get_score(i), p))
        self.cost = {p: c for c, p in scored}
        self.byte_ids = frozenset(self.byte_id.values())
        self.leads = frozenset(i for p, i in self.id.items() if p.startswith(SPACE))
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space after other characters: texts can't be split at spaces")
        joined = {c for p in self.id if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t" if c not in joined)
        alone = re.escape(self.alone)
        self.segment = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.cache = _Cache()
        self.table = self._table()
        self.char = np.arange(OUTSIDE, OUTSIDE + 0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def _table(self) -> PairTable:
        """Offline: every way to cut a piece into two symbols."""
        ranks = {c: i for i, c in enumerate(sorted(set(self.cost.values())))}
        symbol = lambda x: self.id.get(x, OUTSIDE + ord(x) if len(x) == 1 else None)
        pairs = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                l, r = symbol(p[:k]), symbol(p[k:])
                if l is not None and r is not None:
                    pairs[l, r] = (ranks[self.cost[p]], i)
        return PairTable(pairs)

    def bytes_of(self, segment: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.ids_of(segment))

    def bytes_of_many(self, segments: list[str]) -> list[bytes]:
        """bytes_of() each, with agendas that run in step."""
        out: list[bytes] = [b""] * len(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = self.char[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")]
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            self._in_step(chars[starts[own][:, None] + np.arange(size)], own, segments, out)
        return out

    def _in_step(self, sym: np.ndarray, own: np.ndarray, segments: list[str], out: list[bytes]) -> None:
        n = sym.shape[1]
        rank = self.table.find(sym[:, :-1], sym[:, 1:])[0] if n > 1 else np.zeros((len(sym), 0), np.int32)
        while True:
            if n > 1:
                best = rank.argmin(axis=1)
                more = rank[np.arange(len(sym)), best] != NONE
            else:
                more = np.zeros(len(sym), dtype=bool)
            done = ~more
            if done.any():
                ids, at = np.ascontiguousarray(sym[done], dtype="<u4"), own[done]
                raw, outside = ids.tobytes(), (ids >= OUTSIDE).any(axis=1)
                for k, (i, odd) in enumerate(zip(at.tolist(), outside.tolist(), strict=True)):
                    out[i] = self.bytes_of(segments[i]) if odd else raw[4 * n * k : 4 * n * (k + 1)]
            if not more.any():
                return
            sym, rank, best, own = sym[more], rank[more], best[more], own[more]
            row = np.arange(len(sym))
            join = self.table.find(sym[row, best], sym[row, best + 1])[1]
            n -= 1
            col = np.arange(n)
            sym = np.take_along_axis(sym, col + (col > best[:, None]), axis=1)
            sym[row, best] = join
            if n > 1:
                col = np.arange(n - 1)
                rank = np.take_along_axis(rank, col + (col > best[:, None]), axis=1)
                for side in (best - 1, best):
                    ok = (side >= 0) & (side < n - 1)
                    rank[row[ok], side[ok]] = self.table.find(sym[row[ok], side[ok]], sym[row[ok], side[ok] + 1])[0]

    def merge(self, segment: str) -> list[str]:
        """The symbols that the agenda leaves of ``segment``."""
        sym = list(segment)
        n, cost, agenda = len(sym), self.cost, []
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))

        def propose(i: int, j: int) -> None:
            both = sym[i] + sym[j]
            c = cost.get(both)
            if c is not None:
                heapq.heappush(agenda, (c, i, j, both))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != len(both) or nxt[i] != j:
                continue  # one side was joined to something else meanwhile
            sym[i], sym[j] = both, ""
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                propose(i, k)
            if prev[i] >= 0:
                propose(prev[i], i)
        return [s for s in sym if s]

    def ids_of(self, segment: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(segment):
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in s.encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def library(self, segments: list[str]) -> list[list[int]]:
        """What the library makes of each segment.  It puts a space in front, so segments without one follow a lone piece."""
        lead = [s[0] == SPACE for s in segments]
        got = self.lib.encode([s[1:] if l else "\n" + s for s, l in zip(segments, lead, strict=True)], num_threads=1)
        cut = len(self.lib.encode("\n"))
        # a lone space encodes to nothing in the library, where text must follow
        return [
            ids if l and len(s) > 1 else self.lib.encode("\n" + s)[cut:] if l else ids[cut:]
            for ids, s, l in zip(got, segments, lead, strict=True)
        ]

    def learn(self, texts: list[list[str]], cache: _Cache, make) -> dict:
        """Whatever ``make`` returns for the distinct segments of a batch; what is long is not kept in ``cache``."""
        cache.make_room()
        new = [s for s in set().union(*texts) if s not in cache]
        short = [s for s in new if len(s) <= IN_STEP_CHARS]
        cache.learn(short, make(self.checked(short)))
        long = [s for s in new if len(s) > IN_STEP_CHARS]
        return dict(zip(long, make(self.checked(long)), strict=True)) if long else {}

    def checked(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, compared with the library's where segments can stand alone there."""
        if segments and len(segments[0]) > IN_STEP_CHARS:
            ids = [self.bytes_of(s) for s in segments]
        else:
            ids = self.bytes_of_many(segments)
        if self.check and segments and "\n" in self.alone:
            theirs = self.library(segments)
            flat = np.fromiter(itertools.chain.from_iterable(theirs), "<u4")
            if b"".join(ids) != flat.tobytes() or list(map(len, theirs)) != [len(x) // 4 for x in ids]:
                bad = next(s for s, x, y in zip(segments, ids, theirs, strict=True) if np.frombuffer(x, "<u4").tolist() != list(y))
                raise ValueError(f"agenda and library differ on {bad!r}")
        return ids

    def encode_batch(self, texts: list[str], bos: bool = False, eos: bool = False) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; equal texts share one object."""
        distinct = list(dict.fromkeys(texts))
        cut = [self.segments(t) for t in distinct]
        long = self.learn(cut, self.cache, lambda ids: ids)
        head = self.bos.to_bytes(4, "little") if bos else b""
        tail = self.eos.to_bytes(4, "little") if eos else b""
        find = self.cache.__getitem__ if not long else lambda s: long[s] if s in long else self.cache[s]
        got = {}
        for t, c in zip(distinct, cut, strict=True):
            body = b"".join(map(find, c))
            self.check_whole(t, body)
            got[t] = head + body + tail
        return [got[t] for t in texts]

    def check_whole(self, text: str, ids: bytes) -> None:
        """The check of a text in one, for vocabularies whose segments can't stand alone in the library."""
        if self.check and "\n" not in self.alone and np.frombuffer(ids, "<u4").tolist() != self.lib.encode(text):
            raise ValueError(f"agenda and library differ on {text[:200]!r}")

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text: control ids vanish, one leading space goes, bad byte runs become U+FFFD."""
        first = next((i for i in ids if self.raw[i]), None)
        out = b"".join(map(self.raw.__getitem__, ids))
        if first in self.leads:
            out = out[1:]
        if first is not None and not self.byte_ids.isdisjoint(ids):
            try:
                out.decode()
            except UnicodeDecodeError:
                out = self._repaired(ids, first in self.leads)
        return out

    def _repaired(self, ids: list[int], cut: bool) -> bytes:
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.byte_ids:
                run += self.raw[i]
                continue
            while run:
                size = next((k for k in range(1, 5) if _is_char(run[:k])), 0)
                out.append(run[:size] if size else "�".encode())
                run = run[max(size, 1):]
            if i is not None:
                out.append(self.raw[i])
        text = b"".join(out)
        return text[1:] if cut else text


def _is_char(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


class Counter:
    """Counts tokens with the whole-token shortcut.

    Before any text is read, every vocabulary string that is a possible segment is encoded alone; those that give
    one token are proven single.  In texts, segments among them count one without any merge; only the rest run
    the agenda.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        alone = [p for p in pieces.id if pieces.segment.findall(p) == [p]]
        self.single = {p: 1 for p, ids in zip(alone, pieces.bytes_of_many(alone), strict=True) if len(ids) == 4}
        self.known = _Cache()
        self.known.learn(list(self.single), list(self.single.values()))

    def count_batch(self, texts: list[str]) -> list[int]:
        distinct = list(dict.fromkeys(texts))
        cut = [self.pieces.segments(t) for t in distinct]
        if self.known.bytes > CACHE_BYTES:
            self.known.make_room()
            self.known.learn(list(self.single), list(self.single.values()))
        long = self.pieces.learn(cut, self.known, lambda ids: [len(x) // 4 for x in ids])
        find = self.known.__getitem__ if not long else lambda s: long[s] if s in long else self.known[s]
        n = {t: sum(map(find, c)) for t, c in zip(distinct, cut, strict=True)}
        if self.pieces.check and "\n" not in self.pieces.alone and any(len(self.pieces.lib.encode(t)) != c for t, c in n.items()):
            raise ValueError("counts and library differ")
        return [n[t] for t in texts]
