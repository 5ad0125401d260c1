"""Parts of the operators without Spark, against brute force."""

import itertools
import random
import sys
import time
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeset.llm import dac, ngram_join, packing, quality, substring_dedup, suffixes, toxicity, warc
from citeset.llm.tokens import PieceEncoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_library_ids(name):
    enc, r = PieceEncoder(public_tokenizers.path(name)), random.Random(5)
    odd = ["a", "B", "é", "Σ", "ß", "'s", ",", ".", "!!", " ", "\n", "\t", " \n", "  ", "1", "²", "<|endoftext|>", "\xa0", "İ", "ǅ", "̇", "\x1c", "　"]
    texts = ["", " lead", "trail ", "x<|endoftext|> y", *("".join(r.choice(odd) for _ in range(r.randint(1, 25))) for _ in range(3000)), "z" * 5000]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    assert enc.encode([None]) == [b""]


class _Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.characters = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.characters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_go_to_the_library_with_one_space_between():
    enc, r = PieceEncoder(public_tokenizers.path(FILES[1])), random.Random(7)
    words = list({"".join(r.choice("aeioustrnäüñж") for _ in range(r.randint(2, 9))) for _ in range(6000)})
    enc.tokenizer = counted = _Counted(enc.tokenizer)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    got = enc.encode(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in counted.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert counted.characters <= sum(map(len, words)) + len(words)


def test_letters_of_every_script_give_the_library_ids():
    """Some are several pre-tokens once they are normalised or lowered, so that whole groups must be told apart otherwise."""
    enc = PieceEncoder(public_tokenizers.path(FILES[1]))
    letters = [x for x in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(x)[0] == "L"]
    texts = [" ".join(f"{x} {x}a b{x}" for x in letters[i : i + 100]) for i in range(0, len(letters), 100)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    assert enc.encode(["क़ a", "İstanbul ½ b", "a</w> b"]) == [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch_fast(["क़ a", "İstanbul ½ b", "a</w> b"], add_special_tokens=False)]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 5000), max_size=1500), st.data())
@settings(max_examples=30, deadline=None)
def test_codes_round_trip(tmp_path_factory, ids, data):
    path = str(tmp_path_factory.mktemp("dac") / "x.dac")
    with open(path, "wb") as f:
        f.writelines(dac.encode([7, None], [len(ids), 0], np.array(ids, np.uint32)))
    r = dac.Reader(path)
    assert r.documents()[0] == [7, None]
    assert r.slice(0, len(ids)).tolist() == ids
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        e = data.draw(st.integers(i, len(ids)))
        assert r.token(i) == ids[i]
        assert r.slice(i, e).tolist() == ids[i:e]


def test_deep_shallow_sorts():
    for seed in range(120):
        r = random.Random(seed)
        base = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 60))) for _ in range(4)]
        strings = [r.choice(base) + bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 60))]
        group = np.array(sorted(r.randint(0, 3) for _ in strings))
        order, lcp = suffixes.deep_shallow(strings, group)
        assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings, strict=True))
        for k, (a, b) in enumerate(itertools.pairwise(order), 1):
            same = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(strings[a], strings[b], strict=False)))
            assert lcp[k] == (same if group[a] == group[b] else -1)


def test_packing_plan_uses_every_piece():
    r = random.Random(1)
    for size in (8, 40, 300):
        lengths = [r.randint(1, size) for _ in range(400)]
        counts = np.bincount(lengths, minlength=size + 1)
        plan = packing.plan(counts, size)
        used = Counter()
        for pattern, n in plan:
            assert sum(pattern) <= size
            for x in pattern:
                used[x] += n
        assert used == Counter(lengths)
        assert sum(n for _, n in plan) <= 1.05 * -(-sum(lengths) // size) + 2
    assert packing.plan(np.zeros(9, np.int64), 8) == []


def test_triple_sums_fill_gaps():
    counts = np.zeros(101, np.int64)
    counts[[50, 10, 17, 23]] = 4
    assert packing.plan(counts, 100)[0] == ((50, 50), 2)
    counts[50] = 1
    assert packing.plan(counts, 100)[0] == ((50, 23, 17, 10), 1)


def test_sums_are_those_of_a_plain_search():
    for seed in range(40):
        r = random.Random(seed)
        left = np.bincount([r.randint(1, 30) for _ in range(r.randint(1, 25))], minlength=41)
        sums = packing._Sums(left)
        while left.any():
            gap = r.randint(1, 40)
            available = np.repeat(np.arange(41), left).tolist()
            found = sums.fill(gap)
            least = next((k for k in (1, 2, 3) if any(sum(c) == gap for c in set(itertools.combinations(available, k)))), None)
            assert (found and len(found)) == least
            if found:
                assert sum(found) == gap
                assert not Counter(found) - Counter(available)
            for x in found or available[:1]:
                left[x] -= 1


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    raw = bytes(np.random.default_rng(2).integers(97, 101, 5000, np.uint8))
    places, hashes = substring_dedup.anchors(raw)
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    again = substring_dedup.anchors(raw)
    assert places.tolist() == again[0].tolist()
    assert hashes.tolist() == again[1].tolist()


def test_toxicity_score_equals_a_plain_convolution():
    r, words = random.Random(3), ["alpha", "beta", "Gamma!", "delta", "stone", "river"]
    texts = ["", "one", *(" ".join(r.choice(words) for _ in range(n)) for n in (2, 5, 40))]
    m = toxicity.Model()
    for text in texts:
        vectors = [m.e[ids[ids != toxicity._NONE]].sum(axis=0) / np.sqrt(max(1, (ids != toxicity._NONE).sum())) for ids in map(toxicity._hashes, text.split())]
        vectors += [np.zeros(toxicity.DIM)] * toxicity.PAD
        best = []
        for w, c, k in zip(m.w, m.c, toxicity.WIDTHS, strict=True):
            for f in range(toxicity.FILTERS):
                seen = [c[f]] + [c[f] + sum(vectors[i + j] @ w[j][:, f] for j in range(k)) for i in range(len(vectors) - toxicity.PAD)]
                best.append(max(0.0, *seen))
        want = 1 / (1 + np.exp(-(np.array(best) @ m.v + m.b[0])))
        got = toxicity._sigmoid(m.logit(toxicity._pool_words(toxicity._Table(m), [text])))[0]
        assert got == pytest.approx(want, abs=1e-4)


def test_thresholds_are_exact():
    t = ngram_join.Threshold(85, 100)
    for m in range(1, 40):
        for n in range(m, 40):
            least = next((c for c in range(m + 1) if 100 * c >= 85 * (m + n - c)), None)
            assert (least is not None) == (n in t.partners(m)) == (m in t.partners(n))
            if least is not None:
                assert t.shared(m, n) == least
                assert least in t.subset_sizes(m, 40)
                assert least in t.subset_sizes(n, 40)
                assert len(t.partners(n)) and t.prefix(n) > n - least


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100), (60, 100)])
def test_linked_sets_share_a_list(num, den):
    """Any pair at the threshold meets in a list, with one spelling of the signatures for every size."""
    t, r = ngram_join.Threshold(num, den), np.random.default_rng(4)
    for n in [*range(1, 60), 100, 257, 1000, 4000]:
        for m in {t.partners(n)[0], n, t.partners(n)[-1]}:
            c = t.shared(m, n)
            if c > min(m, n):
                continue
            x = r.integers(0, 1 << 64, m + n - c, np.uint64)
            pair = [np.unique(x[:n]), np.unique(x[n - c :])]
            for share in (0, 0.1, 0.6, 0.9, 1):  # of shingles that are frequent
                some = x[r.random(len(x)) < share]
                names, who = ngram_join.signatures(pair, t, ngram_join.Frequent(some, r.integers(8, 12, len(some))))
                assert set(names[who == 0].tolist()) & set(names[who == 1].tolist()), (m, n, share)


def test_boundary_follows_the_lists():
    t = ngram_join.Threshold(85, 100)
    most = t.most()
    assert 10 < most < 20
    counts = dict.fromkeys(range(1, most + 1), 1000)
    assert ngram_join.boundary(counts, {n: 8000 for n in counts}, t) < most
    assert ngram_join.boundary(counts, {n: 800_000 for n in counts}, t) == most
    assert ngram_join.boundary(counts, {}, t) == 0


def test_members_equal_brute_force():
    t = ngram_join.Threshold(80, 100)
    for seed in range(60):
        r = random.Random(seed)
        sets = []
        for _ in range(r.randint(1, 30)):
            s = set(r.sample(range(40), r.randint(1, 25))) if not sets or r.random() < 0.4 else set(r.choice(sets)) ^ set(r.sample(range(40), 2))
            sets.append(s or {1})
        root = list(range(len(sets)))
        for _ in sets:
            for i, j in itertools.combinations(range(len(sets)), 2):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        assert ngram_join._members([np.array(sorted(s), np.uint64) for s in sets], t) == root


def test_members_of_a_large_group_are_few_comparisons():
    """Half of a group are too far from all others: they share frequent shingles only, and aren't compared with the whole group."""
    r, base, sets = np.random.default_rng(1), np.arange(400), []
    for i in range(2500):
        x, k = base.copy(), r.random(400) < (0.01, 0.3)[i % 2]
        x[k] = r.integers(1000, 10**9, k.sum())
        sets.append(np.unique(x).astype(np.uint64))
    began = time.process_time()
    root = np.array(ngram_join._members(sets, ngram_join.Threshold(80, 100)))
    assert time.process_time() - began < 8
    assert (root[::2] == 0).all() and (root[1::2] == np.arange(1, 2500, 2)).all()


def test_records_round_trip():
    for args in ((5, "http://a/ü b\r\n", "é<p>".encode() * 50, "d", None, False), (None, None, b"", "d", 3, True), (7, "http://a/b%41c?x=%2520", b"x", "d", None, False, "1.0.99")):
        head, http, payload = warc.parse(warc.record(*args))
        assert int(http["Content-Length"]) == len(args[2])
        assert payload == (b"" if args[5] else args[2])
        assert warc._page(head["WARC-Record-ID"]) == args[0]


def test_classifiers_learn():
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "stone", "river"]
    texts = [" ".join(r.choice(words) for _ in range(30)) + (" vile" if i % 2 else "") for i in range(300)]
    y = np.arange(300) % 2
    model = toxicity.train([toxicity._rows(x) for x in texts[:200]], y[:200])
    p = toxicity._sigmoid(model.logit(toxicity.pool(model, [toxicity._rows(x) for x in texts[200:]])))
    assert ((p >= 0.5) == y[200:]).all()
    table = toxicity._Table(model)
    q = toxicity._sigmoid(model.logit(toxicity._pool_words(table, texts[200:], block=64)))
    assert np.allclose(p, q, atol=1e-5)
    shout = [" ".join(w.upper() + "!!" if i % 2 else w for w in (r.choice(words) for _ in range(20))) for i in range(200)]
    flat, at = quality.features(shout)
    rows = []
    for i in range(200):
        ids, n = np.unique(flat[at[i] : at[i + 1]], return_counts=True)
        rows.append((ids, n * quality.SCALE / (at[i + 1] - at[i]), i % 2))
    w = quality.train(rows[:150])
    assert all((w[i] @ v + w[-1] >= 0) == bool(label) for i, v, label in rows[150:])
