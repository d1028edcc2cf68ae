"""BPE encoding by a merge-type prefix table, a batch of texts at a time in numpy.

Texts are cut in units that no piece crosses (a newline; a run of space marks with the characters up to the next mark or
newline: no piece holds a newline, or a mark after another character). Equal units of a batch are encoded once. For each prefix of a unit
exactly one token can end its encoding. It is found among an automaton's matches that end there: the one whose
predecessor, itself the last token of the shorter prefix, is compatible, which means that the merges of the two tokens'
joined text give these two tokens again. The ids are then read off backwards. The tables of a batch are filled for all of
its units together, one character place after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import sentencepiece

from .common import BoundedCache, RecentCache

SPACE = "▁"
#: Where a unit surely begins, and the characters that are encoded together.
BREAK, CHARS = re.compile(f"(?<!{SPACE})(?={SPACE})|(?=\n)"), 1_500_000
#: Units of more characters are encoded one at a time.
LONG = 48
#: Compatibility of so many pairs of tokens is remembered.
PAIRS = 2_000_000


class LongTable:
    """A hash table from whole numbers that aren't negative to whole numbers, for many keys at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that the table doesn't hold, each once."""
        if 4 * (self.used + len(keys)) > len(self.keys):
            full = self.keys >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self.__init__(int(np.ceil(np.log2(8 * len(keys)))))
        self.used += len(keys)
        at, mask = self._slot(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of keys that want one slot the last gets it
            got = self.keys[at] == keys
            self.values[at[got]] = values[got]
            keys, values, at = keys[~got], values[~got], (at[~got] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; -1 for those that the table doesn't hold."""
        at, mask = self._slot(keys), len(self.keys) - 1
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        other = np.flatnonzero((found != keys) & (found >= 0))
        at = at[other]
        while len(other):
            at = (at + 1) & mask
            found = self.keys[at]
            hit = found == keys[other]
            out[other[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            other, at = other[more], at[more]
        return out


class PieceAutomaton:
    """An Aho-Corasick automaton over pieces: ``ends[state]`` lists (piece's number, size) of all pieces that end there,
    longest first. The same in arrays: ``out[first[state] : first[state + 1]]``, and a hash table of the edges.
    """

    def __init__(self, pieces: dict[str, int]):
        edges: list[dict[str, int]] = [{}]
        ends: list[tuple] = [()]
        for piece, value in pieces.items():
            state = 0
            for ch in piece:
                state = edges[state].setdefault(ch, len(edges))
                if state == len(edges):
                    edges.append({})
                    ends.append(())
            ends[state] = ((value, len(piece)),)
        fail = [0] * len(edges)
        queue = list(edges[0].values())
        for state in queue:  # breadth first: a failure link leads to a shorter text, whose own list is whole
            for ch, child in edges[state].items():
                queue.append(child)
                f = fail[state]
                while f and ch not in edges[f]:
                    f = fail[f]
                fail[child] = edges[f].get(ch, 0)
                ends[child] += ends[fail[child]]
        self.edges, self.ends, self.fail_list = edges, ends, fail
        self.fail = np.array(fail, np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in ends])))
        self.out = np.array([v for x in ends for v, _ in x], np.int64)
        self.size = np.array([s for x in ends for _, s in x], np.int64)
        self.table = LongTable()
        self.table.put(np.array([s << 21 | ord(ch) for s, own in enumerate(edges) for ch in own], np.int64), np.array([t for own in edges for t in own.values()], np.int32))

    def steps(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more character each: along an edge, or that of the nearest failure link that has one."""
        out = self.table.get(state << 21 | code).astype(np.int64)
        todo = np.flatnonzero(out < 0)
        state, code = state[todo], code[todo]
        while len(todo):
            out[todo[state == 0]] = 0
            left = state > 0
            todo, state, code = todo[left], self.fail[state[left]], code[left]
            found = self.table.get(state << 21 | code)
            out[todo] = found
            left = found < 0
            todo, state, code = todo[left], state[left], code[left]
        return out

    def step(self, state: int, ch: str) -> int:
        while state and ch not in self.edges[state]:
            state = self.fail_list[state]
        return self.edges[state].get(ch, 0)


def distinct(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One unit of each set of equal units (its number), and for each unit the place of its set; units are runs of ``codes``."""
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        base = 0xD6E8FEB86659FD93
        power = np.full(int(sizes.max(initial=0)) + 1, base, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        at = np.arange(len(codes)) - np.repeat(starts, sizes)
        keys = np.add.reduceat(mixed * power[at], starts) if len(starts) else np.zeros(0, np.uint64)
        keys ^= sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    same = sizes[one][which] == sizes
    if same.all() and (codes[np.repeat(starts[one][which], sizes) + at] == codes).all():
        return one, which
    return np.arange(len(starts)), np.arange(len(starts))  # two units of one hash: each stands for itself


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 and so on of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def portions(texts: Iterable[str], at: re.Pattern) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in lists of CHARS characters or fewer, with their numbers; a longer text is cut where ``at`` matches next."""
    parts, owners, chars = [], [], 0
    for k, t in enumerate(texts):
        begin = 0
        while begin < len(t):
            cut = at.search(t, begin + CHARS) if len(t) - begin > CHARS else None
            end = cut.start() if cut else len(t)
            if parts and chars + end - begin > CHARS:
                yield parts, owners
                parts, owners, chars = [], [], 0
            parts.append(t[begin:end])
            owners.append(k)
            chars += end - begin
            begin = end
    if parts:
        yield parts, owners


class PrefixTableEncoder:
    """The ids that the library's encoder gives, for a BPE model with byte pieces.

    A character that stands in longer pieces only is a token of its own until the ids are read, and then its bytes.
    """

    def __init__(self, proto: bytes):
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(map(sp.is_unused, plain)) or not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("the model has unused pieces or no bytes")
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: sp.get_score(i) for i, p in self.piece.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = set("".join(self.id))
        if "\n" in self.chars or any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("the model has pieces across unit breaks")
        self.lone = {size + k: ch for k, ch in enumerate(sorted(self.chars - set(self.id)))}
        self.piece |= self.lone
        self.radix = size + len(self.lone)
        self.automaton = PieceAutomaton({p: i for i, p in self.piece.items()})
        self.alone = np.zeros(self.radix, bool)
        for i, p in self.piece.items():
            self.alone[i] = len(p) == 1 or self.merged(p) == [p]
        self.plain = np.zeros(0x110000, bool)  # characters that are pieces
        self.plain[[ord(ch) for ch in self.chars & set(self.id)]] = True
        self.pairs = BoundedCache(self._compatible, PAIRS)
        self.table = LongTable()
        self.units = RecentCache(self._unit, 20_000)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merges themselves: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        a, b = (self.piece[i] for i in divmod(pair, self.radix))
        return self.merged(a + b) == [a, b]

    def _compatibles(self, pairs: np.ndarray) -> np.ndarray:
        found = self.table.get(pairs)
        new = np.unique(pairs[found < 0])
        if len(new):
            if self.table.used + len(new) > PAIRS:
                self.table, new = LongTable(), np.unique(pairs)
            self.table.put(new, np.array([self._compatible(p) for p in new.tolist()], np.int32))
            found = self.table.get(pairs)
        return found > 0

    def _known(self, run: str) -> list[int]:
        """The ids of one run of characters of pieces."""
        edges, ends = self.automaton.edges, self.automaton.ends
        pairs, alone, radix = self.pairs, self.alone, self.radix
        state, last, start = 0, [0], [0]
        for j, ch in enumerate(run, 1):
            to = edges[state].get(ch)
            state = self.automaton.step(state, ch) if to is None else to
            for token, size in ends[state]:
                i = j - size
                # a first token must stand alone
                if pairs[last[i] * radix + token] if i else alone[token]:
                    last.append(token)
                    start.append(i)
                    break
        ids, j = [], len(run)
        while j:
            ids.append(last[j])
            j = start[j]
        ids.reverse()
        if self.lone and not self.lone.keys().isdisjoint(ids):
            ids = [b for i in ids for b in ([self.bytes[x] for x in self.lone[i].encode()] if i in self.lone else (i,))]
        return ids

    def _unit(self, unit: str) -> list[int]:
        ids: list[int] = []
        run = ""
        for ch in unit:
            if ch in self.chars:
                run += ch
                continue
            if run:
                ids += self._known(run)
                run = ""
            ids += [self.bytes[b] for b in ch.encode("utf-8", "surrogatepass")]
        return ids + self._known(run) if run else ids

    def _tables(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units of LONG characters at most, all of pieces, longest units first; and the number of each one's ids."""
        n, auto = len(starts), self.automaton
        longest = int(sizes.max(initial=0))
        last, start = np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int8)
        state = np.zeros(n, np.int64)
        here = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")  # units of so many characters or more
        for j in range(1, longest + 1):
            m = int(here[j])
            state = auto.steps(state[:m], codes[starts[:m] + (j - 1)].astype(np.int64))
            todo, at, end = np.arange(m), auto.first[state], auto.first[state + 1]
            while len(todo):
                if (at >= end).any():
                    raise ValueError("a prefix has no last token")
                token, i = auto.out[at], j - auto.size[at]
                ok = self.alone[token]
                inner = np.flatnonzero(i)
                ok[inner] = self._compatibles(last[i[inner], todo[inner]].astype(np.int64) * self.radix + token[inner])
                last[j, todo[ok]], start[j, todo[ok]] = token[ok], i[ok]
                more = ~ok
                todo, at, end = todo[more], at[more] + 1, end[more]
        place, backwards, owners = sizes.astype(np.int64), [], []
        todo = np.flatnonzero(place)
        counts = np.zeros(n, np.int64)
        while len(todo):
            backwards.append(last[place[todo], todo])
            owners.append(todo)
            counts[todo] += 1
            place[todo] = start[place[todo], todo]
            todo = todo[place[todo] > 0]
        ids = np.zeros(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        for k, (own, who) in enumerate(zip(backwards, owners)):
            ids[ends[who] - 1 - k] = own
        return ids, counts

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some normalized texts, cut where units begin, and the number of ids of each."""
        ids, counts, starts = self._units(parts)
        between = np.searchsorted(starts, np.cumsum([len(w) + 1 for w in parts])[:-1] - 1)
        ends = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(np.concatenate(([0], ends[between], ends[-1:])))

    def _units(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of such texts, and each unit's number of ids and start; a newline between texts is a unit of no ids."""
        codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        space, line = codes == ord(SPACE), codes == 10
        begins = line | space
        begins[1:] &= line[1:] | ~space[:-1]
        begins[1:] |= line[:-1]
        begins[:1] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(codes)))
        one, which = distinct(codes, starts, sizes)
        known = np.add.reduceat(self.plain[codes], starts, dtype=np.int64) == sizes if len(starts) else np.zeros(0, bool)
        quick = known[one] & (sizes[one] <= LONG)
        order = np.flatnonzero(quick)
        order = order[np.argsort(-sizes[one[order]], kind="stable")]
        ids, own = self._tables(codes, starts[one[order]], sizes[one[order]])
        slow = np.flatnonzero(~quick)
        found = [self.units[codes[starts[k] : starts[k] + sizes[k]].tobytes().decode("utf-32-le", "surrogatepass")] for k in one[slow]]
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.int32)])
        order = np.concatenate([order, slow])
        counts, first = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        counts[order] = np.concatenate([own, np.fromiter(map(len, found), np.int64, len(found))])
        first[order] = np.cumsum(counts[order]) - counts[order]
        counts, first = counts[which], first[which]
        between = np.searchsorted(starts, np.cumsum([len(w) + 1 for w in parts])[:-1] - 1)
        counts[between] = 0  # the newlines between texts are no units of theirs
        return ids[ranges(first, counts)], counts, starts

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the bounds of each text's ids; a null text has none. Texts are
        taken CHARS characters at a time, and a longer one in parts that begin where a unit does.
        """
        sums, ids = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        for parts, owners in portions((self.sp.normalize(t) if t else "" for t in texts), BREAK):
            found, counts = self._encode(parts)
            ids.append(found)
            np.add.at(sums, owners, counts)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(sums)))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_batch``, for many words without white space: where each is a unit, the units of one text."""
        text = SPACE + SPACE.join(words)
        if not all(words) or text.count(SPACE) != len(words) or self.sp.normalize(" ".join(words)) != text:
            return self.encode_batch(words)
        found = [self._units([t]) for (t,), _ in portions([text], BREAK)]
        ids, counts, _ = (np.concatenate(x) for x in zip(*found))
        return ids, np.concatenate(([0], np.cumsum(counts)))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(2)
def encoder(proto: bytes) -> PrefixTableEncoder:
    return PrefixTableEncoder(proto)


@lru_cache(2)
def numerals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of each id with a comma after them, in a row each, and how many characters these are."""
    text = [b"%d," % i for i in range(size)]
    lengths = np.array([len(t) for t in text])
    rows = np.zeros((size, int(lengths.max())), np.uint8)
    for i, t in enumerate(text):
        rows[i, : len(t)] = np.frombuffer(t, np.uint8)
    return rows, lengths


def joined(ids: np.ndarray, bounds: np.ndarray, size: int) -> list[memoryview]:
    """Each text's ids in decimal, joined by commas."""
    rows, lengths = numerals(size)
    own = lengths[ids]
    flat = rows[ids][np.arange(rows.shape[1]) < own[:, None]]
    ends = np.concatenate(([0], np.cumsum(own)))[bounds]
    view = memoryview(flat)
    return [view[s : max(s, e - 1)] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
