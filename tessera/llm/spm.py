"""SentencePiece encoding by a merge-type prefix table, and unigram token counts by trie-shared dynamic programming."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .pieces import LONG, SPACE, PieceAutomaton, distinct, encoder, joined, portions, ranges

#: Where a long text may be cut between pre-tokens: before white space.
GAP = re.compile(r"(?=[\s\x1c-\x1f\x85])")
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(text: Column, path: str | None = None) -> Column:
    """A struct column (ids_sha256, decoded_sha256, n_tokens) of a text column; null text counts as empty."""
    proto = model_bytes(path or model_path())

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(proto)
        for texts in batches:
            ids, bounds = enc.encode_batch(list(texts))
            decimal = [hashlib.sha256(x).hexdigest() for x in joined(ids, bounds, enc.sp.get_piece_size())]
            text = [hashlib.sha256(enc.decode(ids[s:e].tolist()).encode()).hexdigest() for s, e in zip(bounds[:-1], bounds[1:])]
            yield pd.DataFrame({"n_tokens": np.diff(bounds), "ids_sha256": decimal, "decoded_sha256": text})

    return digest(text)


def token_ids(text: Column, path: str | None = None) -> Column:
    """The ids of a text column as array<int>; null text gives an empty array."""
    proto = model_bytes(path or model_path())

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(proto)
        for texts in batches:
            found, bounds = enc.encode_batch(list(texts))
            yield pd.Series([found[s:e] for s, e in zip(bounds[:-1], bounds[1:])], dtype=object)

    return ids(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an array<int> column, by the library's decode; null gives empty text."""
    proto = model_bytes(path or model_path())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = encoder(proto).sp
        for col in batches:
            yield pd.Series([sp.decode([int(i) for i in x]) if x is not None else "" for x in col])

    return text(ids)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again. Null and empty texts give no ids and the digests of
    empty strings; repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", encoding(F.col("text")).alias("e"))
    return docs.select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of every document, with ``n_tokens`` and the digests ``ids_sha256`` and ``decoded_sha256``; an input
    column of one of these names is replaced. Null and empty texts give no ids and the digests of empty strings; repeated
    rows give repeated results, so there are no ties; an empty table gives no rows; other nulls and columns stay as they are.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in docs.columns if c.lower() not in new]
    coded = fresh(docs, "coded")
    return docs.withColumn(coded, encoding(F.col("text"))).select(*kept, *[F.col(f"{coded}.{c}").alias(c) for c in new])


# --- unigram token counts -------------------------------------------------------------------------------------------


def unigram_scores(proto: bytes) -> tuple[dict[str, float], float]:
    """A unigram log score for each piece of a vocabulary, by its rank r: -log(r + 2), the harmonic law that ordered
    vocabularies follow. Tokenizers aren't trained here, so no score comes from a corpus, and a text's count depends on
    nothing but the text. Also the score of one byte of a character that no piece holds.
    """
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    scores = {sp.id_to_piece(i): -float(np.log(r + 2)) for r, i in enumerate(plain)}
    return scores, min(scores.values()) - 1.0


class TrieCounter:
    """Token counts of pre-tokens under the best unigram segmentation.

    The distinct pre-tokens of a block of texts are inserted in a trie, one level after the other. A node keeps the best
    forward score of its prefix and the tokens on that path, found once for all pre-tokens that share it, from the
    ancestors at which the pieces that end there begin. A pre-token's count is the one of the node where it ends. Equal
    scores go to the fewer tokens, then the longer last piece. A character that is no piece counts a token a byte.
    """

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.byte_score, self.value = byte_score, np.array(list(scores.values()))
        self.automaton = PieceAutomaton({p: k for k, p in enumerate(scores)})
        self.longest = max(map(len, scores), default=1)
        self.plain = np.zeros(0x110000, bool)
        self.plain[[ord(p) for p in scores if len(p) == 1]] = True
        self.space = np.zeros(0x110000, bool)
        self.space[[c for c in range(0x3001) if chr(c).isspace()]] = True
        self.nodes = 0

    def long(self, word: str) -> int:
        """The count of one word that is too long for a trie: a path of its own."""
        auto, state = self.automaton, 0
        best, tokens = [0.0], [0]
        for end, ch in enumerate(word, 1):
            state, found, used = auto.step(state, ch), None, 0
            for piece, size in auto.ends[state]:
                s, n = best[end - size] + float(self.value[piece]), tokens[end - size] + 1
                if found is None or s > found or (s == found and n < used):
                    found, used = s, n
            if not self.plain[ord(ch)]:
                size = len(ch.encode("utf-8", "surrogatepass"))
                s, n = best[end - 1] + size * self.byte_score, tokens[end - 1] + size
                if found is None or s > found:
                    found, used = s, n
            best.append(found)
            tokens.append(used)
        return tokens[-1]

    def trie(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The counts of words of LONG characters at most, longest first; words are runs of ``codes``."""
        auto, room = self.automaton, int(sizes.sum()) + 1
        best, tokens, state = np.zeros(room), np.zeros(room, np.int64), np.zeros(room, np.int64)
        up = np.zeros((room, self.longest), np.int32)
        node, nodes = np.zeros(len(starts), np.int64), 1
        longest = int(sizes.max(initial=0))
        here = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")
        for j in range(1, longest + 1):
            m = int(here[j])
            keys, which = np.unique(node[:m] << 21 | codes[starts[:m] + (j - 1)].astype(np.int64), return_inverse=True)
            parent, code = keys >> 21, keys & 0x1FFFFF
            new = np.arange(nodes, nodes + len(keys))
            state[new] = auto.steps(state[parent], code)
            up[new, 0] = parent
            up[new, 1:] = up[parent, :-1]
            score, used = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
            todo, at, end = np.arange(len(keys)), auto.first[state[new]], auto.first[state[new] + 1]
            while True:
                more = at < end
                todo, at, end = todo[more], at[more], end[more]
                if not len(todo):
                    break
                before = up[new[todo], auto.size[at] - 1]
                s, n = best[before] + self.value[auto.out[at]], tokens[before] + 1
                better = (s > score[todo]) | ((s == score[todo]) & (n < used[todo]))
                score[todo[better]], used[todo[better]] = s[better], n[better]
                at = at + 1
            other = np.flatnonzero(~self.plain[code])
            size = 1 + (code[other] > 0x7F) + (code[other] > 0x7FF) + (code[other] > 0xFFFF)
            s = best[parent[other]] + size * self.byte_score
            better = s > score[other]
            score[other[better]], used[other[better]] = s[better], (tokens[parent[other]] + size)[better]
            best[new], tokens[new] = score, used
            node[:m] = new[which]
            nodes += len(keys)
        self.nodes += nodes - 1
        return tokens[node]

    def count_units(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The count of each word; equal words are counted once."""
        if not len(starts):
            return np.zeros(0, np.int64)
        at = ranges(starts, sizes)
        one, which = distinct(codes[at], np.cumsum(sizes) - sizes, sizes)
        out, short = np.zeros(len(one), np.int64), np.flatnonzero(sizes[one] <= LONG)
        short = short[np.argsort(-sizes[one[short]], kind="stable")]
        out[short] = self.trie(codes, starts[one[short]], sizes[one[short]])
        for k in np.flatnonzero(sizes[one] > LONG):
            s = starts[one[k]]
            out[k] = self.long(codes[s : s + sizes[one[k]]].tobytes().decode("utf-32-le", "surrogatepass"))
        return out[which]

    def count(self, words: list[str]) -> dict[str, int]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        full = np.flatnonzero(sizes)
        counts = np.zeros(len(words), np.int64)
        counts[full] = self.count_units(codes, (np.cumsum(sizes) - sizes)[full], sizes[full])
        return dict(zip(words, counts.tolist()))

    def count_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of pre-tokens of each text, and of tokens."""
        words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for parts, owners in portions((" " + t if t else "" for t in texts), GAP):
            codes = np.frombuffer(" ".join(parts + [""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            gap = self.space[codes]
            starts = np.flatnonzero(gap[:-1] & ~gap[1:])
            sizes = np.flatnonzero(~gap[:-1] & gap[1:]) + 1 - starts
            codes[starts] = ord(SPACE)  # the mark takes the place of the white space before the word
            counts = self.count_units(codes, starts, sizes)
            owner = np.array(owners)[np.searchsorted(np.cumsum([len(x) + 1 for x in parts]), starts, side="right")]
            np.add.at(words, owner, 1)
            np.add.at(tokens, owner, counts)
        return words, tokens


def token_counts(text: Column, path: str | None = None) -> Column:
    """A struct column (n_pretokens, n_tokens). Pre-tokens are the runs between white space, each with a space mark before it."""
    scores, byte_score = unigram_scores(model_bytes(path or model_path()))

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = TrieCounter(scores, byte_score)
        for texts in batches:
            words, tokens = counter.count_texts(list(texts))
            yield pd.DataFrame({"n_pretokens": words, "n_tokens": tokens})

    return counts(text)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every whole text of ``documents``. Null and empty texts count zero; repeated
    rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", token_counts(F.col("text")).alias("c"))
    return docs.select("doc_id", "c.n_pretokens", "c.n_tokens")
