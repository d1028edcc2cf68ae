"""The radix trie and the divergence of sources against plain counting."""

import random
import re
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from oracle import same
from tessera.llm import audit


@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b))))
def test_trie_walks_in_byte_order(terms):
    trie = audit.RadixTrie()
    leaves = trie.leaves(terms)
    assert trie.leaves(terms) == leaves
    walked, order = trie.walk()
    assert walked == sorted(set(terms))
    assert dict(zip(walked, order)) == dict(zip(terms, leaves)) and len(trie) == len(set(terms)) == len(set(order))


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x90, exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs"]))))
def test_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [t.decode() for t in audit.terms_of(text) if t] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


@given(st.integers(0, 10**15), st.integers(1, 10**15))
def test_share_is_exact(count, more):
    import numpy as np

    whole = count + more
    assert int(audit.share(np.array([count]), whole)[0]) == 1 + 1_000_000_000 * (count + 2) // whole


def brute(docs):
    """The contract in plain Python, on (lang, source, text)."""
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        documents[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in documents[lang].items() if n >= 10]

        def shares(group):
            whole = sum(counts[group][t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[group][t] + 2) // whole for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        mine, every = shares((lang, source)), shares((lang, None))
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            theirs = shares((lang, other))
            pairs.append((-sum(f(mine[t], theirs[t]) for t in kept), other.encode(), other))
        marks = [(-f(mine[t], every[t]), t.encode(), t) for t in kept if counts[lang, source][t] and mine[t] > every[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(marks)[:10])):
            out += [(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_against_plain_counting(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "The", "of", "été", "straße", "漢", "a", "ab", "abc", "abd", "x'y", "z1z", "😀"]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ß", None, "s10"]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(400)]
    docs += [("en", "hot", "the of " * 3000)] * 30 + [("xx", "lone", "rare"), ("xx", "other", None), ("yy", "alone", "")] + docs[:40]
    monkeypatch.setattr(audit, "BLOCK", 2)  # several blocks of sources
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    found = sorted(tuple(r) for r in audit.source_divergence(df).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == brute(docs)


def test_small_tries_and_pieces(monkeypatch):
    """Tries that are sent on early and merged again give the same leaves."""
    import pyarrow as pa

    rng = random.Random(6)
    docs = [("en", rng.choice("ab"), " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(30))) for _ in range(200)]
    batches = [pa.record_batch([list(c) for c in zip(*docs[k : k + 20])], names=["lang", "source", "text"]) for k in range(0, 200, 20)]

    def run():
        leaves = sorted((r for b in audit._leaves(iter(batches)) for r in b.to_pylist()), key=lambda r: r["term"])
        schema = [("lang", pa.string()), ("term", pa.binary()), ("documents", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
        one = pa.RecordBatch.from_pylist(leaves, pa.schema(schema))
        rows = [r for b in audit._merged(iter([one])) for r in b.to_pylist()]
        out = {}
        for r in rows:
            at = 0
            for t, n in zip(r["terms"], r["sizes"]):
                out[t] = dict(zip(r["sources"][at : at + n], r["counts"][at : at + n]))
                at += n
        return out, len(leaves), len(rows)

    whole, many, _ = run()
    monkeypatch.setattr(audit, "LEAVES", 30)
    monkeypatch.setattr(audit, "PIECE_TERMS", 7)
    parted, more, pieces = run()
    assert parted == whole and more > many and pieces > 5


def test_query_equals_sql(spark, sf):
    same(audit.op13_source_divergence(spark, sf), sf, audit.SQL)
