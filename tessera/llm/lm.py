"""LM scoring: a causal self-attention model trained in numpy on subword ids, and base scores by word counts.

A text is its lower-cased words, spelled in ids of a public subword vocabulary, and one end. The model reads windows of
ids and gives each next id's probability in three factors: its group and its leaf in the group by self-attention over the
ids before it, and its share of the leaf by its count. Leaves come of a balanced tree over the vocabulary, from the
neighbours that the ids have in all training words. Windows overlap, and each id is scored once.

Counts and neighbours cover every training word, and the gradient sees every id of every training text once: weights are
trained on each partition and averaged, in ROUNDS rounds over different texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, saved, table, words_of
from .pieces import SPACE, encoder, ranges
from .spm import model_bytes, model_path

HELD_OUT, MODULUS = 2, 7
WINDOW, STRIDE = 40, 32
LEAD = WINDOW - STRIDE
#: Which places of a window each of its last STRIDE places sees: none after itself.
CAUSAL = np.tri(STRIDE, WINDOW, LEAD, dtype=np.float32)
ONES = np.ones(WINDOW, np.float32)
WIDTH = 24
#: Groups, and leaves of a group: powers of two.
GROUPS = 64
LEAVES = GROUPS * GROUPS
#: Numbers by which an id's neighbours are told: half for those before it, half for those after it.
TRAITS = 32
ROUNDS, BATCH, RATE = 6, 256, 0.02
#: Windows that are scored together, and those whose attention is computed at once in training.
HELD, PART = 1024, 64
#: Words whose counts are sent to every task; all others meet their counts in a join, with the same results.
KNOWN_WORDS = 50_000
#: Other words whose ids a task remembers.
MET = 300_000


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words of a table's ``text``. A partition adds counts up before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sums() -> Iterator[pd.DataFrame]:
            words, counts = [w.decode("utf-8", "replace") for w in total], np.fromiter(total.values(), np.int64, len(total))
            for k in range(0, len(words), 20_000):
                yield pd.DataFrame({"word": words[k : k + 20_000], "c": counts[k : k + 20_000]})

        total = Counter()
        for b in batches:
            for t in b["text"]:
                total.update(words_of(t))
            if len(total) > 300_000:
                yield from sums()
                total = Counter()
        yield from sums()

    return texts.select("text").where("text is not null").mapInPandas(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the most frequent words, ``most`` of them or fewer: those of whole classes of counts, a 32nd of a power of
    two wide. Only the classes' sizes meet on the driver, not each partition's best rows.
    """
    grade = F.floor(F.log2(F.col("c").cast("double")) * 32).cast("int")
    least, left = None, most
    for r in sorted(counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["grade"]):  # 2,048 rows at most
        if r["n"] > left:
            break
        least, left = r["grade"], left - r["n"]
    return counts.where(F.lit(False) if least is None else grade >= least)


# --- the model --------------------------------------------------------------------------------------------------------


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, list[tuple[int, slice]]]]]:
    """Places in the order of their groups, and blocks of this order, of PART windows or one group: (first, end, the
    groups met, each with its part of the block).
    """
    order = np.argsort(group.astype(np.uint8), kind="stable")
    bounds, blocks = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist(), []
    for g, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
        if s == e:
            continue
        if not blocks or e - blocks[-1][0] > PART * STRIDE:
            blocks.append([s, e, []])
        blocks[-1][1] = e
        blocks[-1][2].append((g, slice(s - blocks[-1][0], e - blocks[-1][0])))
    return order, blocks


class Room(dict):
    """Arrays by name whose memory is used again by the next call: on fresh pages the kernels take up to twice the time."""

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = prod(shape)
        if name not in self or self[name].size < size:
            self[name] = np.empty(size, np.float32)
        return self[name][:size].reshape(shape)


@dataclass
class Attention:
    """One layer of causal self-attention over leaves with a residual, a softmax over groups, and one over a group's leaves."""

    embed: np.ndarray  # LEAVES + 1 x width; the last row stands before a text's first id
    place: np.ndarray  # WINDOW x width
    qkv: np.ndarray  # width x 3 width
    out: np.ndarray  # width x GROUPS
    bias: np.ndarray  # GROUPS
    leaf_out: np.ndarray  # GROUPS x width x GROUPS
    leaf_bias: np.ndarray  # GROUPS x GROUPS
    room: Room = field(default_factory=Room, repr=False, compare=False)

    @classmethod
    def new(cls, mass: np.ndarray, width: int = WIDTH, seed: int = 11) -> Attention:
        """Random weights, and the biases that give each leaf its ``mass``."""
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        m = np.maximum(mass / max(mass.sum(), 1e-9), 1e-13).reshape(GROUPS, GROUPS)
        bias, leaf_bias = np.log(m.sum(1)).astype(np.float32), np.log(m / m.sum(1, keepdims=True)).astype(np.float32)
        return cls(f(LEAVES + 1, width), f(WINDOW, width) * np.float32(0.3), f(width, 3 * width), f(width, GROUPS), bias, f(GROUPS, width, GROUPS), leaf_bias)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.qkv, self.out, self.bias, self.leaf_out, self.leaf_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unflat(self, values: np.ndarray) -> Attention:
        ends = np.cumsum([0] + [p.size for p in self.parts()])
        return Attention(*(values[s:e].reshape(p.shape).astype(np.float32) for p, s, e in zip(self.parts(), ends[:-1], ends[1:])))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean loss of the leaves ``y`` that follow, in nats, and its gradients; ``weight`` is 0 for what doesn't count.

        Exponents are cut at 80 as in ``scorer``. PART windows at a time go through the attention, and so many ids through
        the softmax over leaves, so they stay in the processor's cache. The biases are the last rows of the weights.
        """
        d = self.embed.shape[1]
        scale = np.float32(d**-0.5)
        qkv = self.qkv.copy()
        qkv[:, :d] *= scale
        leaf = y.ravel()
        w = (weight.ravel() / max(float(weight.sum()), 1.0)).astype(np.float32)
        group, rest = np.divmod(leaf, GROUPS)
        rows, ones = np.arange(len(leaf)), np.ones(GROUPS, np.float32)

        def softmax(p: np.ndarray, target: np.ndarray, w: np.ndarray) -> float:
            """The loss of logits ``p``, which become its gradient."""
            np.clip(p, -80, 80, out=p)
            at = rows[: len(p)], target
            own = p[at]
            np.exp(p, out=p)
            total = p @ ones
            p *= (w / total)[:, None]
            p[at] -= w
            return float(((np.log(total) - own) * w).sum())

        loss, kept = 0.0, []
        room = self.room
        z, g_z = room("z", len(leaf), d + 1), room("g_z", len(leaf), d)
        z[:, d] = 1
        out = np.concatenate([self.out, self.bias[None]])
        g_out = np.zeros_like(out)
        for first in range(0, len(x), PART):
            own = slice(first * STRIDE, (first + PART) * STRIDE)
            n = len(x[first : first + PART])
            h, t = (room(f"{name} {first}", n, WINDOW, m) for name, m in (("h", d), ("qkv", 3 * d)))
            self.embed.take(x[first : first + PART], 0, out=h, mode="clip")
            h += self.place
            np.matmul(h.reshape(-1, d), qkv, out=t.reshape(-1, 3 * d))
            q, k, v = t[:, LEAD:, :d], t[:, :, d : 2 * d], t[:, :, 2 * d :]
            a = np.matmul(q, k.transpose(0, 2, 1), out=room(f"a {first}", n, STRIDE, WINDOW))
            np.clip(a, -80, 80, out=a)
            np.exp(a, out=a)
            a *= CAUSAL
            a /= (a @ ONES)[:, :, None]
            seen = np.matmul(a, v, out=room(f"seen {first}", n, STRIDE, d))
            np.add(h[:, LEAD:], seen, out=z[own].reshape(n, STRIDE, d + 1)[:, :, :d])
            p = np.matmul(z[own], out, out=room("p", n * STRIDE, GROUPS))
            loss += softmax(p, group[own], w[own])
            g_out += z[own].T @ p
            np.matmul(p, self.out.T, out=g_z[own])
            kept.append((own, h, q, k, v, a, seen))
        leaf_out = np.concatenate([self.leaf_out, self.leaf_bias[:, None]], axis=1)
        g_leaf_out = np.zeros_like(leaf_out)
        order, blocks = _by_group(group)
        by_group, more = z.take(order, 0, out=room("by_group", *z.shape), mode="clip"), room("more", *g_z.shape)
        rest, w = rest[order], w[order]
        for begin, end, met in blocks:
            own = slice(begin, end)
            p = room("p", end - begin, GROUPS)
            for g, part in met:
                np.matmul(by_group[own][part], leaf_out[g], out=p[part])
            loss += softmax(p, rest[own], w[own])
            for g, part in met:
                np.matmul(by_group[own][part].T, p[part], out=g_leaf_out[g])
                np.matmul(p[part], self.leaf_out[g].T, out=more[own][part])
        back = np.empty_like(order)
        back[order] = rows
        g_z += more.take(back, 0, out=room("z", *more.shape), mode="clip")
        g_h, g_qkv = room("g_h", len(x), WINDOW, d), np.zeros_like(qkv)
        for k0, (own, h, q, k, v, a, seen) in enumerate(kept):
            n = len(h)
            g = g_z[own].reshape(n, STRIDE, d)
            g_s = np.matmul(g, v.transpose(0, 2, 1), out=room("g_s", n, STRIDE, WINDOW))
            g_s -= np.einsum("ijk,ijk->ij", g, seen)[:, :, None]  # the mean of g_s under a
            g_s *= a
            t = room("g_qkv", n, WINDOW, 3 * d)
            t[:, :LEAD, :d] = 0
            np.matmul(g_s, k, out=t[:, LEAD:, :d])
            np.matmul(g_s.transpose(0, 2, 1), q, out=t[:, :, d : 2 * d])
            np.matmul(a.transpose(0, 2, 1), g, out=t[:, :, 2 * d :])
            flat, made = t.reshape(-1, 3 * d), g_h[k0 * PART : k0 * PART + n]
            g_qkv += h.reshape(-1, d).T @ flat
            np.matmul(flat, qkv.T, out=made.reshape(-1, d))
            made[:, LEAD:] += g
        g_qkv[:, :d] *= scale
        g_embed, seen = np.zeros_like(self.embed), x.ravel().astype(np.int16)
        order = np.argsort(seen, kind="stable")
        heads = np.flatnonzero(np.diff(seen[order], prepend=-1))
        g_embed[seen[order[heads]]] = np.add.reduceat(g_h.reshape(-1, d).take(order, 0, out=room("g_h in order", len(order), d), mode="clip"), heads)
        return loss, [g_embed, g_h.sum(0), g_qkv, g_out[:d], g_out[d], g_leaf_out[:, :d], g_leaf_out[:, d]]

    def scorer(self):
        """A function of (x, y) that gives the natural log of the chance of each leaf of y [n, STRIDE].

        The same numbers as in ``gradients``, in fewer passes: the projections are looked up in tables by leaf and place.
        """
        d = self.embed.shape[1]
        scale = np.float32(d**-0.5)
        kv = (self.embed @ self.qkv[:, d:]).astype(np.float32), (self.place @ self.qkv[:, d:]).astype(np.float32)
        qh = np.concatenate([self.embed @ self.qkv[:, :d] * scale, self.embed], axis=1), np.concatenate([self.place @ self.qkv[:, :d] * scale, self.place], axis=1)[LEAD:]

        ones, room = np.ones(GROUPS, np.float32), self.room
        group_out, leaf_out = np.concatenate([self.out, self.bias[None]]), np.concatenate([self.leaf_out, self.leaf_bias[:, None]], axis=1)

        def log_chance(p: np.ndarray, target: np.ndarray) -> np.ndarray:
            np.minimum(p, 80, out=p)
            own = p[np.arange(len(p)), target]
            np.exp(p, out=p)
            return own - np.log(p @ ones)

        def hidden(x: np.ndarray, z: np.ndarray) -> None:
            """Fills ``z`` [n, STRIDE, d]."""
            n = len(x)
            left = kv[0].take(x, 0, out=room("left", n, WINDOW, 2 * d), mode="clip")
            left += kv[1]
            right = qh[0].take(x[:, LEAD:], 0, out=room("right", n, STRIDE, 2 * d), mode="clip")
            right += qh[1]
            a = np.matmul(right[:, :, :d], left[:, :, :d].transpose(0, 2, 1), out=room("a", n, STRIDE, WINDOW))
            np.clip(a, -80, 80, out=a)
            np.exp(a, out=a)
            a *= CAUSAL
            seen = np.matmul(a, left[:, :, d:], out=room("seen", n, STRIDE, d))
            seen /= (a @ ONES)[:, :, None]
            np.add(seen, right[:, :, d:], out=z)

        def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            group, rest = np.divmod(y.ravel(), GROUPS)
            z, out = room("z", len(group), d + 1), np.empty(len(group), np.float32)
            z[:, d] = 1  # meets the biases
            for k in range(0, len(x), PART):  # so few windows stay in the processor's cache
                own = slice(k * STRIDE, (k + PART) * STRIDE)
                hidden(x[k : k + PART], z[own].reshape(-1, STRIDE, d + 1)[:, :, :d])
                out[own] = log_chance(np.matmul(z[own], group_out, out=room("p", len(group[own]), GROUPS)), group[own])
            order, blocks = _by_group(group)
            z, rest = z.take(order, 0, out=room("by_group", *z.shape), mode="clip"), rest[order]
            for begin, end, met in blocks:
                own = slice(begin, end)
                p = room("p", end - begin, GROUPS)
                for g, part in met:
                    np.matmul(z[own][part], leaf_out[g], out=p[part])
                out[order[own]] += log_chance(p, rest[own])
            return out

        return score


def windows(ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows of one sequence: inputs [n, WINDOW] and targets [n, STRIDE].

    A window scores the ids that follow its last STRIDE places, and the LEAD places before are context, so each id is
    scored just once. ``start`` stands before the first id; what is past the end is padded, and cut off by the caller.
    """
    n = len(ids)
    count = -(-n // STRIDE)
    before = np.full(LEAD + 1 + count * STRIDE, start, np.int64)
    before[LEAD + 1 : LEAD + 1 + n] = ids
    at = np.arange(count)[:, None] * STRIDE
    return before[at + np.arange(WINDOW)[None, :]], before[at + np.arange(LEAD + 1, WINDOW + 1)[None, :]]


class Trainer:
    """Adam steps over batches of windows."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.steps = model, rate, 0
        self.m, self.s, self.room = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()], Room()

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        self.steps += 1
        loss, grads = self.model.gradients(x, y, weight)
        rate = self.rate * min(1.0, self.steps / 10)
        for p, g, m, s in zip(self.model.parts(), grads, self.m, self.s):
            t = np.subtract(g, m, out=self.room("t", *g.shape))
            t *= 0.1
            m += t
            np.multiply(g, g, out=t)
            t -= s
            t *= 0.01
            s += t
            np.divide(s, 1 - 0.99**self.steps, out=t)
            np.sqrt(t, out=t)
            t += 1e-8
            np.divide(m, t, out=t)
            t *= rate / (1 - 0.9**self.steps)
            p -= t
        return loss


def leaves_of(traits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The leaf of each id: a balanced tree halves the counts along the main direction of the ids' traits."""
    out = np.zeros(len(counts), np.int64)
    weight = counts.astype(np.float64)

    def split(ids: np.ndarray, first: int, size: int) -> None:
        if size == 1 or not len(ids):
            out[ids] = first
            return
        w = weight[ids] / weight[ids].sum()
        x = traits[ids] - w @ traits[ids]
        main = np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
        main *= np.sign(main[np.abs(main).argmax()])
        order = ids[np.argsort(x @ main, kind="stable")]
        cut = int(np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2)) + 1
        cut = max(min(cut, len(order) - 1), 1) if len(order) > 1 else 1
        split(order[:cut], first, size // 2)
        split(order[cut:], first + size // 2, size // 2)

    split(np.arange(len(counts)), 0, LEAVES)
    return out


@dataclass
class Model:
    """Ids are those of the vocabulary, and one more for the end."""

    proto: bytes
    attention: Attention
    leaf: np.ndarray  # of each id
    share: np.ndarray  # natural log of the id's share of its leaf

    def score(self, sequences: list[np.ndarray], scorer) -> np.ndarray:
        """log10 of the probability of each sequence of ids, its end included, in windows by the batch."""
        out, parts, held = [], [], 0
        end = len(self.leaf) - 1

        def flush() -> None:
            x, y = (np.concatenate([p[k] for p, _ in parts]) for k in range(2))
            y = np.minimum(y, LEAVES - 1)
            chance = scorer(x, y).astype(np.float64)
            ends = np.cumsum([p[0].shape[0] for p, _ in parts]) * STRIDE
            sizes = np.array([n for _, n in parts])
            starts = ends - np.array([p[0].shape[0] for p, _ in parts]) * STRIDE
            total = np.concatenate(([0], np.cumsum(chance)))
            out.extend(total[starts + sizes] - total[starts])

        owners = []
        for k, ids in enumerate(sequences):
            x, y = windows(self.leaf[np.append(ids, end)], LEAVES)
            n = len(ids) + 1
            for at in range(0, len(x), HELD):
                own = slice(at, at + HELD)
                parts.append(((x[own], y[own]), min(n - at * STRIDE, HELD * STRIDE)))
                owners.append(k)
                held += len(x[own])
                if held >= HELD:
                    flush()
                    parts, held = [], 0
        if parts:
            flush()
        sums = np.bincount(owners, out, len(sequences)) if owners else np.zeros(len(sequences))
        shares = np.array([self.share[ids].sum() + self.share[end] for ids in sequences])
        return (sums + shares) / np.log(10)


# --- training and scoring over tables ---------------------------------------------------------------------------------


def id_kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.int32


class Speller:
    """The words of texts and their ids. Those of ``known`` words are at hand, and a task remembers up to MET others."""

    def __init__(self, known: list[str], proto: bytes):
        self.known, self.proto = [w.encode() for w in known], proto
        self.ids, self.bounds = encoder(proto).encode_batch(known)

    def reader(self):
        """A function of texts that gives the words one after the other, the texts' bounds in them, each word's place in
        ``known`` (-1: none), and each text's ids.
        """
        enc, mark = encoder(self.proto), SPACE.encode()
        kind = id_kind(enc.sp.get_piece_size())
        place: dict[bytes, int] = {}
        pool, starts = self.ids.astype(kind), self.bounds

        def read(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
            nonlocal place, pool, starts
            parts = [words_of(t) for t in texts]
            words = list(chain.from_iterable(parts))
            bounds = np.concatenate(([0], np.cumsum([len(w) for w in parts], dtype=np.int64)))
            if not place or len(place) > len(self.known) + MET:
                place, pool, starts = {w: k for k, w in enumerate(self.known)}, self.ids.astype(kind), self.bounds
            at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
            other = np.flatnonzero(at < 0)
            others = [words[k] for k in other.tolist()]
            new = list(dict.fromkeys(w for w in others if mark not in w))
            ids, ends = enc.encode_words([w.decode("utf-8", "replace") for w in new])
            place |= zip(new, range(len(place), len(place) + len(new)))
            pool, starts = np.concatenate([pool, ids.astype(kind)]), np.concatenate([starts, ends[1:] + len(pool)])
            at[other] = np.fromiter(map(place.get, others, repeat(len(place))), np.int64, len(others))
            sizes = np.append(np.diff(starts), 0)[at]  # none of a word that has the mark of a space in it
            own, ends = pool[ranges(starts[at], sizes)], np.concatenate(([0], np.cumsum(sizes)))[bounds]
            found = [own[s:e] for s, e in zip(ends[:-1], ends[1:])]
            for k, t in enumerate(texts):
                if t and SPACE in t:  # ids can span words
                    found[k] = enc.encode_batch([b" ".join(parts[k]).decode("utf-8", "replace")])[0].astype(kind)
            return words, bounds, np.where(at < len(self.known), at, -1), found

        return read


def encoded(docs: DataFrame, proto: bytes, known: dict[str, float], end_base: float) -> DataFrame:
    """Each row's number, id (as text, which keeps nulls and large numbers whole), tokens, the base score of its ``known``
    words and end and their number, its other words, and its ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Speller(list(known), proto), np.array(list(known.values()))))  # KNOWN_WORDS words: bounded
    schema = "row long, doc_id string, held_out boolean, round int, n_tokens long, n_known long, base double, tail string, ids binary"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller, logs = shared.value
        read = speller.reader()
        for b in batches:
            words, bounds, at, ids = read(list(b["text"]))
            there, owner = at >= 0, np.repeat(np.arange(len(b)), np.diff(bounds))
            known = 1 + np.bincount(owner[there], minlength=len(b))
            base = end_base + np.bincount(owner[there], logs[at[there]], len(b))
            others = [words[k] for k in np.flatnonzero(~there).tolist()]
            ends = np.concatenate(([0], np.cumsum(~there)))[bounds].tolist()
            tails = [b"\n".join(others[s:e]).decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:])]
            yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"], "held_out": b["held_out"], "round": b["round"], "n_tokens": np.diff(bounds) + 1, "n_known": known, "base": base, "tail": tails, "ids": [i.tobytes() for i in ids]})

    number = F.monotonically_increasing_id()
    numbered = docs.select(number.alias("row"), F.col("doc_id").cast("string").alias("doc_id"), (crc_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "text")
    dealt = numbered.withColumn("round", F.pmod(F.xxhash64("text", F.lit(29)), F.lit(ROUNDS)).cast("int"))
    return saved(dealt.select("row", "doc_id", "held_out", "round", "text").mapInPandas(encode, schema), "lm-rows")  # from here on a row keeps its number


def statistics(counts: DataFrame, proto: bytes, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all ids, and the traits of their neighbours, from the counts of all training words."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(proto)
        size = enc.sp.get_piece_size()
        signs = np.random.default_rng(19).standard_normal((size + 1, TRAITS // 2)).astype(np.float32)
        count, traits = np.zeros(size + 1), np.zeros((size + 1, TRAITS))

        def add(words: list[str], times: np.ndarray) -> None:
            nonlocal count
            ids, bounds = enc.encode_words(words)
            c = np.repeat(times.astype(np.float64), np.diff(bounds))
            if not len(ids):
                return
            before, after = np.concatenate(([size], ids[:-1])), np.concatenate((ids[1:], [size]))
            before[bounds[:-1][np.diff(bounds) > 0]] = size  # a word's first piece follows the break between words
            after[bounds[1:][np.diff(bounds) > 0] - 1] = size
            count += np.bincount(ids, c, size + 1)
            order = np.argsort(ids, kind="stable")
            heads = np.flatnonzero(np.diff(ids[order], prepend=-1))
            met = ids[order[heads]]
            weight = c[order, None]
            traits[met, : TRAITS // 2] += np.add.reduceat(signs[before[order]] * weight, heads)
            traits[met, TRAITS // 2 :] += np.add.reduceat(signs[after[order]] * weight, heads)

        words, times = [], []
        for b in batches:
            words += list(b["word"])
            times.append(b["c"].to_numpy())
            if len(words) >= 50_000:
                add(words, np.concatenate(times))
                words, times = [], []
        if words:
            add(words, np.concatenate(times))
        there = np.flatnonzero(count)
        if len(there):
            yield pd.DataFrame({"id": there, "c": count[there], "traits": list(traits[there])})

    partial = counts.mapInPandas(sums, "id long, c double, traits array<double>")
    total = partial.groupBy("id").agg(F.sum("c").alias("c"), *[F.sum(F.col("traits")[k]).alias(f"t{k}") for k in range(TRAITS)])
    rows = total.collect()  # a row for each id of the vocabulary at most
    size = encoder(proto).sp.get_piece_size()
    count, traits = np.zeros(size + 1), np.zeros((size + 1, TRAITS))
    for r in rows:
        count[r["id"]], traits[r["id"]] = r["c"], [r[f"t{k}"] for k in range(TRAITS)]
    count[size] = n_docs
    return count, traits


def trained(rows: DataFrame, leaf: np.ndarray, model: Attention) -> Attention:
    """ROUNDS rounds: each partition trains on all windows of the round's texts, and the weights are averaged by steps.

    Each id of a text, its end included, is a target once. Weights are averaged where they meet in a shuffle, a block at a
    time; the driver receives one set of them a round.
    """
    block, end, kind = 4096, len(leaf) - 1, id_kind(len(leaf) - 1)
    for k in range(ROUNDS):
        rate = RATE * (1 - 0.9 * k / max(ROUNDS - 1, 1))
        start = model.flat()

        def train(batches: Iterator[pd.DataFrame], start=start, rate=rate, model=model) -> Iterator[pd.DataFrame]:
            trainer = Trainer(model.unflat(start), rate)
            x, y = np.zeros((0, WINDOW), np.int16), np.zeros((0, STRIDE), np.int16)
            small = leaf.astype(np.int16)

            def step(own: slice) -> None:
                targets = y[own].astype(np.int64)
                # past the end stands what stands before the text: no target
                trainer.step(x[own].astype(np.int64), np.where(targets < LEAVES, targets, 0), (targets < LEAVES).astype(np.float32))

            for b in batches:
                for at in range(0, len(b), HELD):
                    found = [windows(small[np.append(np.frombuffer(i, kind), end)], LEAVES) for i in b["ids"].iloc[at : at + HELD]]
                    x, y = (np.concatenate([rest, *(f[j] for f in found)], dtype=np.int16) for j, rest in enumerate((x, y)))
                    order = np.random.default_rng(len(x)).permutation(len(x))
                    x, y = x[order], y[order]
                    full = max(len(x) // BATCH - 1, 0) * BATCH  # the rest is mixed with what comes
                    for first in range(0, full, BATCH):
                        step(slice(first, first + BATCH))
                    x, y = x[full:], y[full:]
            for first in range(0, len(x), BATCH):
                step(slice(first, first + BATCH))
            if trainer.steps:
                values = trainer.model.flat().astype(np.float64) * trainer.steps
                yield pd.DataFrame({"block": range(0, len(values), block), "steps": trainer.steps, "values": [values[s : s + block].tobytes() for s in range(0, len(values), block)]})

        def averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, list] = {}
            for b in batches:
                for at, steps, values in zip(b["block"], b["steps"], b["values"]):
                    own = total.setdefault(at, [0, 0.0])
                    own[0] += steps
                    own[1] = own[1] + np.frombuffer(values)
            if total:
                yield pd.DataFrame({"block": list(total), "values": [(v / n).tobytes() for n, v in total.values()]})

        own = rows.where((F.col("round") == k) & ~F.col("held_out")).select("ids")
        means = own.mapInPandas(train, "block int, steps long, values binary").repartition("block").mapInPandas(averaged, "block int, values binary").collect()
        if means:
            model = model.unflat(np.concatenate([np.frombuffer(r["values"]) for r in sorted(means, key=lambda r: r["block"])]))
    return model


def scored(docs: DataFrame, proto: bytes) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    Texts are read twice, for the counts and for their ids. Of the words only those beyond KNOWN_WORDS are shuffled, once
    for each text that holds them.
    """
    train = docs.where(crc_remainder("doc_id", MODULUS) != HELD_OUT)
    counts = saved(word_counts(train), "words")
    n_docs = train.count()
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = int(total["n"]) + n_docs, int(total["v"]) + (n_docs > 0)
    base = lambda c: float(np.log10((c + 1) / (n + v + 1)))
    top = frequent(counts, KNOWN_WORDS).collect()  # KNOWN_WORDS rows at most
    rows = encoded(docs, proto, {r["word"]: base(r["c"]) for r in top}, base(n_docs))
    known_end = int(n_docs > 0)

    count, traits = statistics(counts, proto, n_docs)
    leaf = leaves_of(traits / (count + 5)[:, None], count + 0.5)
    mass = np.bincount(leaf, count + 0.5, LEAVES)
    attention = trained(rows, leaf, Attention.new(mass))
    model = Model(proto, attention, leaf, np.log((count + 0.5) / mass[leaf]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary and the weights: bounded

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scorer, kind = m.attention.scorer(), id_kind(len(m.leaf) - 1)
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "score": m.score([np.frombuffer(x, kind).astype(np.int64) for x in b["ids"]], scorer)})

    scores = rows.select("row", "ids").mapInPandas(score, "row long, score double")
    tail = rows.where("tail <> ''").select("row", F.explode(F.split("tail", "\n")).alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    c = F.coalesce("c", F.lit(0))
    met = tail.join(counts, "word", "left").select("row", F.when(c > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("base"))
    sums = met.groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    joined = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base").join(scores, "row").join(sums, "row", "left")
    id_type = docs.schema["doc_id"].dataType
    return joined.select(F.col("doc_id").cast(id_type).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") - 1 + known_end + zero(F.col("k"))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero(F.col("b"))).alias("base_score"), "score")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``. A null, empty or blank text is one end token. A null id counts as
    empty text in the split; repeated rows give repeated results; equally frequent words have equal results; other columns
    are not read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, model_bytes(model_path()))
