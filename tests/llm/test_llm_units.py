"""The operators' kernels against brute force, without Spark."""

import html as entities
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tessera.llm import common, decontam, embedding, html, langid, lm, pieces, quality, simhash, spm, toxicity


@pytest.fixture(scope="module")
def encoder():
    return spm.encoder(spm.model_bytes(spm.model_path()))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_library(text):
    enc = spm.encoder(spm.model_bytes(spm.model_path()))
    ids = enc.encode(text)
    assert ids == enc.sp.encode(text) and enc.decode(ids) == enc.sp.decode(enc.sp.encode(text))


def test_encoding_of_a_batch(encoder, monkeypatch):
    """Whole batches equal the library's ids, however a batch and its texts are cut; long units go one at a time."""
    texts = ["a b", None, "", "\n", "x\n\ny ", " lead", "the the the", "q" * 200, "日本語 😀\x00 end", "▁▁ a▁b", "tail  \n "]
    texts += [" ".join(t or "" for t in texts) * 3]
    for chars in (1_000_000, 40, 1):
        monkeypatch.setattr(pieces, "CHARS", chars)
        ids, bounds = encoder.encode_batch(texts)
        assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == [encoder.sp.encode(t or "") for t in texts]
        assert [bytes(x).decode() for x in pieces.joined(ids, bounds, 32_000)] == [",".join(map(str, encoder.sp.encode(t or ""))) for t in texts]
    assert encoder.encode_batch([])[0].tolist() == [] and encoder.encode_batch([None])[1].tolist() == [0, 0]
    monkeypatch.setattr(pieces, "CHARS", 10_000)
    monkeypatch.setattr(pieces, "PAIRS", 50)  # the table of pairs is emptied now and then
    assert encoder.encode(texts[-1]) == encoder.sp.encode(texts[-1])


def test_automaton_steps():
    auto = pieces.PieceAutomaton({p: i for i, p in enumerate(["a", "b", "ab", "bab", "abba", "ü"])})
    text = "abbababüxab"
    state, one = np.zeros(1, np.int64), 0
    for k, ch in enumerate(text):
        state, one = auto.steps(state, np.array([ord(ch)])), auto.step(one, ch)
        assert state[0] == one
        assert sorted(s for _, s in auto.ends[one]) == sorted(len(p) for p in ("a", "b", "ab", "bab", "abba", "ü") if text[: k + 1].endswith(p))


def test_encoding_of_joined_pieces(encoder):
    rng = np.random.default_rng(3)
    every = list(encoder.piece.values())
    for _ in range(300):
        t = "".join(every[i].replace(pieces.SPACE, " ") for i in rng.integers(0, len(every), 8))
        assert encoder.encode(t) == encoder.sp.encode(t)
    assert encoder.encode(None) == encoder.encode("") == []


def test_trie_counts_are_optimal():
    scores, byte_score = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -1.2, "c": -3.0, "bc": -1.1}, -5.0

    def brute(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            options = [(best[s][0] + scores[w[s:e]], -(best[s][1] + 1)) for s in range(e) if w[s:e] in scores]
            if w[e - 1] not in scores:
                size = len(w[e - 1].encode())
                options.append((best[e - 1][0] + size * byte_score, -(best[e - 1][1] + size)))
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    words = ["abc", "ab", "abcab", "bca", "éa", "", "aé", "abcbc"]
    counter = spm.TrieCounter(scores, byte_score)
    assert counter.count(words) == {w: brute(w) for w in words}
    assert counter.nodes == len({w[:k] for w in words for k in range(1, len(w) + 1)})  # a shared prefix is one node
    assert [counter.long(w) for w in words if w] == [brute(w) for w in words if w]


def test_counts_of_texts(monkeypatch):
    scores, byte_score = spm.unigram_scores(spm.model_bytes(spm.model_path()))
    counter = spm.TrieCounter(scores, byte_score)
    texts = ["the garden  of\tthe house", None, "", " \n ", "Ünïcode\x1cspace\u3000日本語 😀", "z" * 300 + " end", "\x85a "]
    want = [(len((t or "").split()), sum(counter.long(pieces.SPACE + w) for w in (t or "").split())) for t in texts]
    for chars in (1_000_000, 10, 1):
        monkeypatch.setattr(pieces, "CHARS", chars)
        words, tokens = counter.count_texts(texts)
        assert list(zip(words.tolist(), tokens.tolist())) == want


def test_unigram_counts_equal_tokenizers_library():
    from tokenizers import Tokenizer, models

    scores, byte_score = spm.unigram_scores(spm.model_bytes(spm.model_path()))
    vocabulary = [("<unk>", -100.0)] + [(p, s) for p, s in scores.items() if len(p) <= 16]
    tok = Tokenizer(models.Unigram(vocabulary, 0, False))
    words = [spm.SPACE + w for w in "the of thndlytion hereinafter Schulung ciónmente eauxque".split()]
    assert spm.TrieCounter(scores, byte_score).count(words) == {w: len(tok.encode(w, add_special_tokens=False).ids) for w in words}


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ABé \n\tcd", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_pigeonring_finds_all_links():
    """Every pair within 3 bits meets in a bucket and holds a chain; no other pair is linked."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 3, 4, 5)], dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ f for f in flips]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    met = np.zeros_like(near)
    for i in range(4):
        ok = simhash.linked(fps, fps, i)
        first = fps >> np.uint64(16 * i) & np.uint64(0xFFFF)
        second = fps >> np.uint64(16 * ((i + 1) % 4)) & np.uint64(0xFFFF)
        for half in (0, 8):
            key = first << np.uint64(8) | (second >> np.uint64(half) & np.uint64(0xFF))
            met |= ok & (key[:, None] == key[None, :])
    assert (met == near).all()


def test_spanning_connects_like_the_matrix():
    rng = np.random.default_rng(1)
    a = rng.random((60, 60)) < 0.02
    a |= a.T
    np.fill_diagonal(a, False)

    def label(edges):
        p = list(range(60))
        for x, y in edges:
            while p[x] != x:
                x = p[x]
            while p[y] != y:
                y = p[y]
            p[max(x, y)] = min(x, y)
        out = []
        for i in range(60):
            while p[i] != i:
                i = p[i]
            out.append(i)
        return out

    stars = common.spanning(a)
    assert label(stars) == label(np.argwhere(a)) and len(stars) < 60


def test_near_links_are_exact():
    """The links connect just the sets that brute force connects, a hair under and over the threshold."""
    rng = np.random.default_rng(14)
    sets = []
    for n in (5, 40, 300):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (1, 0.9, 0.82, 0.8, 0.79, 0.75, 0.7):
            sets.append(np.unique(base[: int(np.ceil(n * share))]))
        sets.append(np.unique(np.concatenate([base[: n - n // 9], rng.integers(0, 2**63, n // 9, dtype=np.uint64)])))
    near = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets] for a in sets])
    links = np.zeros_like(near)
    for a, b in simhash.near_links(sets, 0.8):
        assert near[a, b]
        links[a, b] = links[b, a] = True

    def reach(m):
        m = (m | np.eye(len(m), dtype=bool)).astype(int)
        for _ in range(6):
            m = ((m @ m) > 0).astype(int)
        return m

    assert (reach(links) == reach(near)).all()
    assert simhash.near_links([np.arange(80, dtype=np.uint64), np.arange(100, dtype=np.uint64)], 0.8)
    assert not simhash.near_links([np.arange(79, dtype=np.uint64), np.arange(100, dtype=np.uint64)], 0.8)


def test_hadamard_keeps_lengths_and_probes_differ():
    x = np.random.default_rng(2).standard_normal((5, 64))
    assert np.allclose(np.linalg.norm(embedding.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    keys = embedding.bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert keys.shape == (5, embedding.TABLES, 1 + embedding.HASHES) and all(len(np.unique(k)) == 1 + embedding.HASHES for k in keys[:, 0])
    for bad in (None, [], [0.0, 0.0], [1.0, None], [np.inf, 1.0], [np.nan, 1.0]):
        assert embedding.unit(bad) is None


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((2000, 64))
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * noise
    a, b = embedding.bucket_keys(x).reshape(2000, -1), embedding.bucket_keys(y).reshape(2000, -1)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.95


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        item, text = rng.integers(1, 5, rng.integers(1, 9)), rng.integers(0, 5, rng.integers(1, 14))
        h = np.zeros((len(item) + 1, len(text) + 1), int)
        for i in range(1, len(item) + 1):
            for j in range(1, len(text) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        best, first, last = decontam.align(item, text)
        assert best == h.max() and 0 <= first <= last <= len(text)


def rare_seeds(items, frequent=()):
    index = decontam.SeedIndex(items)
    frequency = np.zeros(len(index.keys), int)
    for a, b in frequent:
        frequency[index.keys == index.numbers[a] * index.base + index.numbers[b]] = 10_000
    return decontam.RareSeeds(index, index.rare(frequency))


def test_leaks_with_edits_and_common_seeds():
    words = [f"w{i}" for i in range(40)]
    common = "of the and that"
    items = [(7, " ".join(words)), (8, "short item"), (9, None), (10, common + " " + " ".join(f"z{i}" for i in range(30)))]
    seeds = rare_seeds(items, [("of", "the"), ("the", "and"), ("and", "that")])
    assert not {("of", "the"), ("the", "and"), ("and", "that")} & {(a, b) for a in common.split() for b in common.split() if seeds.index.numbers[a] * seeds.index.base + seeds.index.numbers[b] in seeds.keys}
    edited = list(words)
    edited[5:7], edited[20] = ["x"], "y"
    found, none, empty = seeds.matches(["before it " + " ".join(edited) + " after, and a Short Item.", "nothing of the and that here", ""])
    assert [m[0] for m in found] == [7, 8] and found[0][1] > 0.85 and found[0][2] == 2
    assert none == [] and empty == []


@pytest.mark.parametrize("every", [2, 3, 4, 5])
def test_copies_with_replaced_words(every):
    """One word in three, four or five replaced: every copy whose alignment reaches the threshold is found."""
    rng = np.random.default_rng(every)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words, 40))) for i in range(40)]
    seeds = rare_seeds(items)
    hits = 0
    for k, (i, text) in enumerate(items):
        copy = " ".join(rng.choice(words, 60)) + " " + " ".join(w if j % every else f"new{j}" for j, w in enumerate(text.split())) + " " + " ".join(rng.choice(words, 60))
        share = decontam.align(seeds.index.items[k], seeds.index.numbered(copy))[0] / 80
        named = {m[0]: m[1] for m in seeds.matches([copy])[0]}
        assert (share >= decontam.MIN_SCORE) == (i in named) and named.get(i, share) == share
        hits += i in named
    assert hits == 40 if every > 2 else hits == 0


def test_leaks_equal_all_pairs_under_random_edits():
    """Replaced, lost and put-in words in small vocabularies, where scores lie near the threshold: equal to aligning every pair."""
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(words, rng.integers(8, 30)))) for i in range(30)]
    seeds = rare_seeds(items, [("v1", "v2"), ("v3", "v4"), ("v5", "v6")])
    texts = []
    for _ in range(300):
        out = list(rng.choice(words, rng.integers(0, 40)))
        for w in items[rng.integers(30)][1].split():
            u = rng.random()
            out += [] if u < 0.15 else [str(rng.choice(words))] if u < 0.3 else [w, "zz"] if u < 0.5 else [w]
        texts.append(" ".join([*out, *rng.choice(words, rng.integers(0, 40))]))
    pairs = 0
    for text, found in zip(texts, seeds.matches(texts)):
        shares = {i: decontam.align(seeds.index.items[k], seeds.index.numbered(text))[0] / (2 * seeds.index.sizes[k]) for k, (i, _) in enumerate(items)}
        assert {m[0]: m[1] for m in found} == {i: s for i, s in shares.items() if s >= decontam.MIN_SCORE}
        pairs += len(found)
    assert pairs > 100


def test_window_reaches_the_earliest_start():
    """An item that repeats a 4-gram: a hit of the later place begins before the window of the first."""
    item = "a b c d " + " ".join(f"w{i}" for i in range(26)) + " a b c d"
    seeds = rare_seeds([(1, item)])
    words = item.split()
    text = " ".join(w for i, w in enumerate(words) if i > 29 or i % 4 != 1)  # of its 4-grams only the repeated one stays unbroken
    text = " ".join(["q", *text.split()[3:]])  # the first place is gone: the one hit is the item's end
    share = decontam.align(seeds.index.items[0], seeds.index.numbered(text))[0] / (2 * len(words))
    assert share >= decontam.MIN_SCORE and [m[:2] for m in seeds.matches([text])[0]] == [(1, share)]


def test_html():
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>n</a></nav><div class='ad'>buy</div><article><header><h1>A &amp; b</h1></header><p>c<b>d</b>\n e<br>f</p><section class='comments'>no</section></article><footer>&copy;</footer></body></html>"
    classes = {t: 1 for t in html.Page(page).tokens()}
    for known in ({}, classes):
        assert html.extract(page, known) == "A & b cd e f"
    assert html.extract(None, {}) == html.extract("", {}) == html.extract("<article></article>", {}) == ""
    plain = "<p>one<p>two &lt;x&gt; <div id=sidebar>s</div>"
    assert html.extract(plain, {}) == "one two " + entities.unescape("&lt;x&gt;")


def test_template_decides_what_is_furniture():
    """A slot that is fixed on the host goes, though no name tells; classes that cross or don't nest are no template."""
    page = "<body><div class=qx><p>same on every page</p></div><div class=zz><p>own text</p></div></body>"
    classes = {t: k for k, t in enumerate(html.Page(page).tokens())}
    slots = {key: [t for _, t in own if t] for key, own in html.cut(html.Page(page).events, classes)}
    fixed = {key: 0 for key, own in slots.items() if own == ["same on every page"]}
    assert html.extract(page, {}) == html.extract(page, classes) == "same on every page own text"
    assert len(fixed) == 1 and html.extract(page, classes | fixed) == "own text"
    assert html._nests(["<div", "/div<p", "<" "/div"]) and not html._nests(["<" "/div", "<div"])
    events = [(t, "", "") for t in ("<ul", "<ol", "<li", "<dl")]
    assert html._valid(events, {"<ul": 1, "<li": 1, "<ol": 2, "<dl": 2}) == {"<ul", "<li"}


def test_languages_by_cosine():
    space = langid.NgramSpace()
    texts = {"en": "the thing and the other thing there", "es": "ción que los años de la niña mañana"}
    proto = {k: space.bundle(v) / np.linalg.norm(space.bundle(v)) for k, v in texts.items()}
    for k, t in {"en": "and there the thing", "es": "los niños que mañana"}.items():
        v = space.bundle(t)
        assert max(proto, key=lambda n: proto[n] @ v) == k
    assert space.bundle("12 !?") is None
    ids = space.ids("abca")
    assert np.allclose(space.bundle("abca"), space.of(ids).sum(0))


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(7)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = quality.BoostedTrees.fit(x, y, np.ones(600))
    assert ((m.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = m.base
        for t in range(len(m.feature)):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + 1 + int(row[m.feature[t, node]] > m.threshold[t, node])
            total += m.leaf[t, node - m.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.score(x[:20]), [walk(r) for r in x[:20]])
    assert np.isfinite(quality.BoostedTrees.fit(x[:0], y[:0], np.ones(0)).score(x[:2])).all()
    classes = quality.class_table()
    for t in ("", " ", "\n", "é", "a b c\n" * 50, "!!!"):
        assert len(quality.statistics(t, classes)) == len(quality.FEATURES) and np.isfinite(quality.statistics(t, classes)).all()


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(8)
    word = lambda i: "abcdefghij"[i % 10] * 3 + "klmnopqrst"[i // 10 % 10] * 2 + "uvwxyz"[i // 100] * 2
    texts, y = [], []
    for k in range(600):
        t = [word(i) for i in rng.integers(0, 400, 40)]
        if k % 3 == 0:
            t[5] = "vilewordhere"
        texts.append(" ".join(t))
        y.append(int(k % 3 == 0))
    at, w, bias = toxicity.fit(texts, y, {0: 1.0, 1: 1.0})
    assert len(at) < 2000
    dense = np.zeros(1 << toxicity.BITS)
    dense[at] = w
    f = toxicity.Features()
    score = lambda t: bias + dense[np.unique(np.concatenate(f.of(t)))].sum()
    assert all((score(t) > 0) == bool(v) for t, v in zip(texts, y))
    assert f.of("") == [] and f.of("123 !!") == []


def small_attention(monkeypatch, groups=4):
    monkeypatch.setattr(lm, "GROUPS", groups)
    monkeypatch.setattr(lm, "LEAVES", groups**2)
    return lm.Attention.new(np.arange(1.0, groups**2 + 1), 6)


def test_attention_gradients(monkeypatch):
    m = small_attention(monkeypatch)
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 17, (3, lm.WINDOW)), rng.integers(0, 16, (3, lm.STRIDE))
    w = (rng.random((3, lm.STRIDE)) < 0.8).astype(np.float32)
    _, grads = m.gradients(x, y, w)
    for p, g in zip(m.parts(), grads):
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p.shape)
            kept, step = p[at], 1e-2
            p[at] = kept + step
            up, _ = m.gradients(x, y, w)
            p[at] = kept - step
            down, _ = m.gradients(x, y, w)
            p[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3 + 0.05 * abs(g[at])
    assert np.array_equal(m.unflat(m.flat()).leaf_out, m.leaf_out)


def test_attention_gradients_in_parts(monkeypatch):
    """However many windows go through the attention at once, the gradients are the same, also of very unlikely leaves."""
    m = small_attention(monkeypatch)
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 17, (7, lm.WINDOW)), rng.integers(0, 16, (7, lm.STRIDE))
    w = (rng.random((7, lm.STRIDE)) < 0.8).astype(np.float32)
    m.bias[0] = -60  # the loss isn't cut where a chance is under 1e-12
    found = []
    for part in (64, 3):
        monkeypatch.setattr(lm, "PART", part)
        found.append(m.gradients(x, y, w))
    assert found[0][0] > 60 * (w * (y < 4)).sum() / w.sum() - 5 and abs(found[0][0] - found[1][0]) < 1e-4
    for a, b in zip(found[0][1], found[1][1]):
        assert np.allclose(a, b, atol=1e-6)


def test_attention_uses_its_memory_again(monkeypatch):
    """Steps of one size take no new arrays for their work, and what a call gave stays as it was."""
    m = small_attention(monkeypatch)
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 17, (2, 70, lm.WINDOW)), rng.integers(0, 16, (2, 70, lm.STRIDE))
    w = np.ones((70, lm.STRIDE), np.float32)
    score = m.scorer()
    first, chances = m.gradients(x[0], y[0], w), score(x[0], y[0])
    kept, copies, own = {k: id(v) for k, v in m.room.items()}, [g.copy() for g in first[1]], chances.copy()
    m.gradients(x[1], y[1], w)
    score(x[1], y[1])
    assert kept and kept == {k: id(v) for k, v in m.room.items()}
    assert all(np.array_equal(a, b) for a, b in zip(first[1], copies)) and np.array_equal(chances, own)
    again = m.gradients(x[0], y[0], w)
    assert first[0] == again[0] and all(np.array_equal(a, b) for a, b in zip(copies, again[1])) and np.array_equal(own, score(x[0], y[0]))
    assert np.isclose(-chances.mean(), first[0], rtol=1e-5)


def test_ids_of_words_are_those_of_texts(monkeypatch):
    """Looked up, remembered or encoded, words give the ids of their whole text, also where a mark of a space stands in it."""
    proto = spm.model_bytes(spm.model_path())
    enc = pieces.encoder(proto)
    texts = ["The cat sat", "▁ a ▁▁b c▁ d", None, "", " \n ", "a　b 　 The", "x" * 3000 + " \x00y 😀😀 cat cat", "▁", "sat b▁ The", "newer older newer"]
    for met in (lm.MET, 2):
        monkeypatch.setattr(lm, "MET", met)
        for known in ([], ["the", "cat", "▁", "b▁"]):
            read = lm.Speller(known, proto).reader()
            for _ in range(3):
                words, bounds, at, ids = read(texts)
                for k, t in enumerate(texts):
                    own = common.words_of(t)
                    assert words[bounds[k] : bounds[k + 1]] == own
                    assert ids[k].tolist() == enc.encode(b" ".join(own).decode())
                    assert at[bounds[k] : bounds[k + 1]].tolist() == [known.index(w.decode()) if w.decode() in known else -1 for w in own]
    for words in ([], ["a"], ["cat", "▁x"], ["a　", "b"], ["one", "", "two"], ["dog"] * 3):
        assert [x.tolist() for x in enc.encode_words(words)] == [x.tolist() for x in enc.encode_batch(words)]


def plain_score(model, ids):
    """log10 of a sequence's probability by a forward pass of its own for each token, in double precision."""
    a, end, groups = model.attention, len(model.leaf) - 1, lm.GROUPS
    embed, place, qkv = a.embed.astype(float), a.place.astype(float), a.qkv.astype(float)
    d = embed.shape[1]
    line, total = [*ids, end], 0.0
    for t, target in enumerate(line):
        begin = t // lm.STRIDE * lm.STRIDE - lm.LEAD  # where the window of this token begins; its places run from there
        leaves = [model.leaf[line[p - 1]] if p >= 1 else lm.LEAVES for p in range(begin, t + 1)]
        h = embed[leaves] + place[: len(leaves)]
        q, k, v = np.split(h @ qkv, 3, axis=1)
        s = k @ q[-1] / d**0.5
        s = np.exp(s - s.max())
        z = h[-1] + (s / s.sum()) @ v
        group, rest = divmod(int(model.leaf[target]), groups)
        for logits, at in ((z @ a.out + a.bias, group), (z @ a.leaf_out[group] + a.leaf_bias[group], rest)):
            total += logits[at] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        total += model.share[target]
    return total / np.log(10)


def test_scores_equal_a_plain_forward_pass(monkeypatch):
    m = small_attention(monkeypatch)
    rng = np.random.default_rng(10)
    leaf, count = rng.integers(0, 16, 31), rng.integers(1, 9, 31)
    leaf[:16] = range(16)
    model = lm.Model(b"", m, leaf, np.log(count / np.bincount(leaf, count, 16)[leaf]))
    sequences = [rng.integers(0, 30, n) for n in (0, 1, 7, 8, 31, 32, 33, 64, 200, 9000, 3)]
    found = model.score(sequences, m.scorer())
    assert np.allclose(found[:9], [plain_score(model, s) for s in sequences[:9]], rtol=1e-4) and np.isclose(found[10], plain_score(model, sequences[10]), rtol=1e-4)
    assert np.isclose(found[9], plain_score(model, sequences[9]), rtol=1e-4)  # more windows than one batch holds
    every = sum(10 ** model.score([np.array([i])], m.scorer())[0] for i in range(30))
    one = 10 ** model.score([np.zeros(0, int)], m.scorer())[0]
    assert 0 < one < 1 and 0 < every < 1 - one  # chances of different texts add up to less than 1


def test_words_are_those_of_the_pattern():
    for t in ("A Bc\x0bd\x0c\re\tÉ\x1cÄ\x85\xa0\u3000Z\n", "", None, "\x00 \x1f", "ONE"):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        assert [w.decode() for w in common.words_of(t)] == re.findall("[^\x20\x09-\x0D]+", low)


def test_long_table():
    rng = np.random.default_rng(15)
    table, known = pieces.LongTable(4), {}
    for _ in range(30):
        keys = np.setdiff1d(rng.integers(0, 1 << 40, 50), np.array(list(known), np.int64))
        known |= {int(k): int(k) % 97 for k in keys}
        table.put(keys, (keys % 97).astype(np.int32))
    asked = np.concatenate([np.array(list(known)), rng.integers(0, 1 << 40, 500)])
    assert table.get(asked).tolist() == [known.get(int(k), -1) for k in asked] and table.used == len(known)


def test_leaves_are_balanced():
    rng = np.random.default_rng(11)
    counts = rng.integers(1, 100, 9000).astype(float)
    leaf = lm.leaves_of(rng.standard_normal((9000, 4)), counts)
    mass = np.bincount(leaf, counts, lm.LEAVES)
    assert leaf.max() < lm.LEAVES and (mass > 0).mean() > 0.9 and mass.max() < 8 * counts.sum() / lm.LEAVES
    assert (lm.leaves_of(np.zeros((3, 4)), np.ones(3)) < lm.LEAVES).all()


def test_training_lowers_the_loss(monkeypatch):
    m = small_attention(monkeypatch)
    rng = np.random.default_rng(12)
    seq = np.tile(rng.permutation(16), 40)  # each leaf tells the next
    x, y = lm.windows(seq, 16)
    trainer = lm.Trainer(m, 0.02)
    losses = [trainer.step(x, y, np.ones(y.shape, np.float32)) for _ in range(150)]
    assert losses[-1] < 0.4 * losses[0]


def test_windows_score_each_id_once():
    for n in (1, 31, 32, 33, 100):
        ids = np.arange(n)
        x, y = lm.windows(ids, -1)
        assert (y.ravel()[:n] == ids).all() and x.shape == (-(-n // lm.STRIDE), lm.WINDOW)
        assert (x[:, -1].ravel()[: n // lm.STRIDE] == ids[lm.STRIDE - 2 :: lm.STRIDE][: n // lm.STRIDE]).all()
