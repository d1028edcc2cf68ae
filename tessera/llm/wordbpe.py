"""BPE encoding of words by backtracking, and decoding by an offset table.

A word's tokens are the only sequence in which each token is compatible with the one before it: the merges of the two
tokens' joined text leave these two. So an encoder may go through a word from the left and take at each place the longest
token that an automaton found to begin there and that is compatible with the last one; where none is, it takes the last
token back and tries the next shorter one. A place that was left in this way lies on no border of the word's tokens and is
never entered again, so the steps grow with the word's length only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, RecentCache, table
from .pieces import PieceAutomaton, distinct, portions, ranges
from .spm import model_path

MODEL = "word_bpe_49k.json"
GAP = re.compile(r"(?=[ \t\n\r])")
#: What the vocabulary's pattern of words must be, and its endings after an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
END_OF_WORD = "</w>"
BLANK, LETTER, NUMBER, OTHER = range(4)
#: Distinct words whose ids a worker remembers (twice as many at most), and pairs of tokens.
WORDS, PAIRS = 150_000, 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(1)
def character_classes() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(starts, classes) of runs of code points of one class: the library is asked once where it splits a text of all
    characters, so the classes are of the Unicode version that it was built with.
    """
    every = "".join(chr(c) for c in chain(range(0xD800), range(0xE000, 0x110000)))
    found = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(f"[^{pattern}]+"), "removed")
        for _, (s, e) in split.pre_tokenize_str(every):
            found[s:e] = kind
    found = np.insert(found, 0xD800, np.full(0x800, OTHER, np.uint8))  # surrogates stand in no text
    cut = np.flatnonzero(np.diff(found, prepend=255))
    return tuple(cut.tolist()), tuple(found[cut].tolist())


class BacktrackingEncoder:
    """The ids that the library's encoder gives, for a byte-level BPE vocabulary of lower-case words with ends."""

    def __init__(self, path: str, classes: tuple[tuple[int, ...], tuple[int, ...]]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        splits = [p["pattern"].get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if splits != [PATTERN] or kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != END_OF_WORD or spec["decoder"]:
            raise ValueError("the vocabulary is of another kind")
        self.normalize = tokenizers.Tokenizer.from_file(path).normalizer.normalize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marked = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters, vocabulary = byte_letters(), model["vocab"]

        def symbols(token: str) -> str:
            """A token with a character for each byte, 256 higher at a word's end."""
            inner = token.removesuffix(END_OF_WORD)
            text = "".join(chr(letters[c]) for c in inner)
            return text[:-1] + chr(256 + ord(text[-1])) if inner != token else text

        self.text = {i: symbols(t) for t, i in vocabulary.items()}
        self.radix = 1 + max(self.text)
        self.rank, self.halves, self.merge = [-1] * self.radix, [(-1, -1)] * self.radix, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocabulary[a + b]
            self.merge[vocabulary[a] * self.radix + vocabulary[b]] = (r, made)
            self.rank[made], self.halves[made] = r, (vocabulary[a], vocabulary[b])
        # read from the right, the tokens that end at a place are those that begin there
        self.automaton = PieceAutomaton({t[::-1]: i for i, t in self.text.items()})
        self.symbol = {t: i for i, t in self.text.items() if len(t) == 1}
        self.alone = BoundedCache(lambda i: self.merged(self.text[i]) == [i], PAIRS)
        self.pairs = BoundedCache(self._compatible, PAIRS)
        self.units = RecentCache(self._unit, WORDS)
        starts, kinds = classes
        self.kind = np.repeat(np.array(kinds, np.uint8), np.diff((*starts, 0x110000)))
        content = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        spelled = [content.get(i, "").encode() + b" " for i in range(1 + max(content))]
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def merged(self, text: str) -> list[int]:
        """The ids of a short text by the merges themselves: the first merge of the vocabulary, leftmost among equals."""
        parts = [self.symbol[c] for c in text]
        while True:
            least = min(((self.merge[a * self.radix + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a * self.radix + b in self.merge), default=None)
            if least is None:
                return parts
            k = least[1]
            parts[k : k + 2] = [self.merge[parts[k] * self.radix + parts[k + 1]][1]]

    def _compatible(self, pair: int) -> bool:
        """Whether two tokens stay apart. Their last merges are undone one by one, latest first; at no time may the two
        pieces at the border have a merge that comes before the next merge of either.
        """
        left, right = divmod(pair, self.radix)
        if not self.alone[right]:
            return False
        before_left = before_right = len(self.merge)
        while True:
            r, _ = self.merge.get(left * self.radix + right, (None, None))
            # of equal merges the one further left comes first
            if r is not None and r < before_left and r <= before_right:
                return False
            if self.rank[left] > self.rank[right]:
                before_left, left = self.rank[left], self.halves[left][1]
            elif self.rank[right] >= 0:
                before_right, right = self.rank[right], self.halves[right][0]
            else:
                return True

    def _unit(self, unit: bytes) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit integers."""
        text = unit[:-1].decode("latin-1") + chr(256 + unit[-1])
        auto, ends, pairs, radix = self.automaton, self.automaton.ends, self.pairs, self.radix
        begin, state = [()] * len(text), 0
        for k in range(len(text) - 1, -1, -1):
            state = auto.step(state, text[k])
            begin[k] = ends[state]
        place, choice, ids, back, left = 0, 0, [], [], set()
        while place < len(text):
            for n in range(choice, len(begin[place])):
                token, size = begin[place][n]
                if place + size not in left and (pairs[ids[-1] * radix + token] if ids else self.alone[token]):
                    ids.append(token)
                    back.append((place, n + 1))
                    place, choice = place + size, 0
                    break
            else:
                left.add(place)
                place, choice = back.pop()  # the word's own tokens are never all taken back
                ids.pop()
        return np.array(ids, "<u4").tobytes()

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the words of a text of code points that ends in three blanks."""
        kind = self.kind[codes]
        before = np.concatenate(([BLANK], kind[:-1])).astype(np.uint8)
        new = (kind != before) | (kind == NUMBER)
        mark = np.flatnonzero((codes == ord("'")) & (before != OTHER))
        size = np.zeros(len(mark), np.int64)
        for ending in ENDINGS:
            hit = np.ones(len(mark), bool)
            for k, ch in enumerate(ending, 1):
                hit &= codes[mark + k] == ord(ch)
            size[hit] = 1 + len(ending)
        mark, size = mark[size > 0], size[size > 0]
        new[mark + 1] = False
        new[mark + size] = True
        border = np.flatnonzero(new)
        ends = np.append(border[1:], len(codes))
        word = kind[border] != BLANK
        return border[word], (ends - border)[word]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some normalized texts, and the number of ids of each."""
        joined = "\n".join([*parts, "\n\n"])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, sizes = self.words(codes)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.concatenate(([0], np.cumsum(width)))
        first, length = offset[starts], offset[starts + sizes] - offset[starts]
        text = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)[ranges(first, length)]
        first = np.cumsum(length) - length
        one, which = distinct(text, first, length)
        blob = text.tobytes()
        found = [self.units[blob[s:e]] for s, e in zip(first[one].tolist(), (first + length)[one].tolist())]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(counts) - counts
        ids = np.frombuffer(b"".join(found), "<u4")
        own = counts[which]
        ends = np.concatenate(([0], np.cumsum(own)))
        bounds = ends[np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))]
        return ids[ranges(begin[which], own)], np.diff(np.concatenate(([0], bounds)))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the bounds of each text's ids; a null text has none. A special
        token's own spelling is that token; what is before and after it are texts of their own.
        """
        runs, owners, tails = [], [], []
        for k, text in enumerate(texts):
            cut = self.marked.split(text) if text and "<" in text else [text or ""]
            runs += [t.lower() if t.isascii() else self.normalize(t) for t in cut[::2]]
            owners += [k] * len(cut[::2])
            tails += [*(self.special[t] for t in cut[1::2]), -1]
        counts, ids = np.zeros(len(runs), np.int64), [np.zeros(0, "<u4")]
        for parts, of in portions(runs, GAP):
            found, own = self._encode(parts)
            ids.append(found)
            np.add.at(counts, of, own)
        ids, tails = np.concatenate(ids), np.array(tails, np.int64)
        after = tails >= 0
        ids = np.insert(ids, np.cumsum(counts)[after], tails[after])
        sums = np.bincount(owners, counts + after, len(texts)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(sums)))

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The text of each run of ids in UTF-8: its tokens with a space between."""
        sizes = np.diff(self.offsets)[ids]
        text = memoryview(self.spelled[ranges(self.offsets[ids], sizes)])
        at = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        return [text[s : max(s, e - 1)] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(2)
def encoder(path: str, classes: tuple) -> BacktrackingEncoder:
    return BacktrackingEncoder(path, classes)


def token_ids(text: Column, path: str | None = None) -> Column:
    """The ids of a text column as array<int>; null and empty texts give an empty array."""
    path = path or model_path(MODEL)
    classes = character_classes()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, classes)
        for texts in batches:
            found, bounds = enc.encode_batch(list(texts))
            yield pd.Series([found[s:e].astype(np.int32) for s, e in zip(bounds[:-1], bounds[1:])], dtype=object)

    return ids(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an array<int> column of ids; null gives empty text, null ids are left out."""
    path = path or model_path(MODEL)
    classes = character_classes()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, classes)
        for col in batches:
            rows = [[i for i in (x if x is not None else ()) if i is not None] for x in col]
            bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
            flat = np.fromiter(chain.from_iterable(rows), np.int64, int(bounds[-1]))
            yield pd.Series([bytes(t).decode() for t in enc.decode_batch(flat, bounds)])

    return text(ids)


def encoding(text: Column, path: str | None = None) -> Column:
    """A struct column (n_tokens, ids_sha256, decoded_sha256) of a text column; null text counts as empty."""
    path = path or model_path(MODEL)
    classes = character_classes()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, classes)
        for texts in batches:
            ids, bounds = enc.encode_batch(list(texts))
            view = memoryview(ids.astype("<u4", copy=False))
            own = [hashlib.sha256(view[s:e]).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pd.DataFrame({"n_tokens": np.diff(bounds), "ids_sha256": own, "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in enc.decode_batch(ids, bounds)]})

    return digest(text)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again. Null and empty texts, and texts of white space, give no
    ids and the digests of empty strings; repeated rows give repeated results, so there are no ties; very long texts are
    encoded in portions cut at white space; other columns, of whatever names, are not read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", encoding(F.col("text")).alias("e"))
    return docs.select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256")
