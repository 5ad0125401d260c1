"""The operators on small tables with hard cases, against brute force; the queries against their SQL."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from citeset import staging
from citeset.llm import (
    decontaminate,
    exact_dedup,
    ngram_join,
    packing,
    quality,
    samples,
    substring_dedup,
    token_counts,
    token_output,
    toxicity,
    warc,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, node long, hash long, key long, label string"
BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    base = [" ".join(word() for _ in range(n)) for n in (1, 2, 5, 40, 90, 200)]
    texts = [*base, *base, None, None, "", " \n\t", "É " + base[3], base[4].upper(), base[5] + " tail one", "head " + base[5], base[3] + base[5], "x" * 900, "ab" * 300]
    texts += [" ".join(w if r.random() > 0.02 else word() for w in base[5].split()) for _ in range(12)]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, (3, base[3]), (3, base[3]), (None, base[4]), (None, "only null")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, None, 1, 2, 3, "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *names):
    return sorted((tuple(x[n] for n in names) for x in df.collect()), key=repr)


def ids_of(path, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output(docs, rows, none):
    out = token_output.token_output(docs, BYTES, 2).collect()
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in out) == Counter((i, len(k), crc(k)) for i, t in rows for k in [ids_of(BYTES, t, 2)])
    out.sort(key=lambda x: x["start"])
    ids = [x["doc_id"] for x in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for x in out:
        assert x["start"] == at
        at += x["n_tokens"]
    assert token_output.token_output(none, BYTES, 2).count() == 0


def test_token_counts(docs, rows, none):
    counts, fresh = token_counts.token_counts(docs, BYTES, 100)
    want = sorted(((i, len((t or "").encode()), len(k), len(k) > 100) for i, t in rows for k in [ids_of(BYTES, t, 2)[:-1]]), key=repr)
    assert got(counts, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    again, more = token_counts.token_counts(docs, BYTES, 100, cache=fresh)
    assert more.count() == 0
    assert got(again, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(none, BYTES, 1)[0].count() == 0


def test_exact_groups(docs, rows, none):
    norm = lambda t: (t or "").encode().translate(None, exact_dedup.BLANKS)
    best, size = {}, Counter(norm(t) for _, t in rows)
    for i, t in rows:
        k = (-len(t or ""), i is not None, i)
        best[norm(t)] = min(best.get(norm(t), k), k)
    want = sorted(((i, best[norm(t)][2], size[norm(t)], hashlib.sha256(norm(t)).hexdigest()) for i, t in rows), key=repr)
    out = exact_dedup.exact_groups(docs, digest_all=True)
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert out.where("kept").count() == len(size)
    assert exact_dedup.exact_groups(none).count() == 0


def test_substrings(docs, rows, none):
    for length in (substring_dedup.LENGTH, 80):
        seen = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
        want = []
        for i, t in rows:
            raw = (t or "").encode()
            on = np.zeros(len(raw) + 1, bool)
            for p in range(len(raw) - length + 1):
                if seen[raw[p : p + length]] > 1:
                    on[p : p + length] = True
            kept = bytes(c for c, x in zip(raw, on[:-1], strict=True) if not x)
            want.append((i, len(raw), int(on.sum()), int((np.diff(on.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
        assert got(substring_dedup.substring_dedup(docs, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(none).count() == 0


@pytest.mark.parametrize(("length", "largest"), [(80, 1), (200, 3)])
def test_substrings_in_large_groups(docs, monkeypatch, length, largest):
    """Groups split down to one string, and all joins by shuffles."""
    names = ("doc_id", "n_removed", "n_spans", "kept_sha256")
    want = got(substring_dedup.substring_dedup(docs, length), *names)
    monkeypatch.setattr(substring_dedup, "LARGEST", largest)
    monkeypatch.setattr(staging, "BROADCAST", -1)
    assert got(substring_dedup.substring_dedup(docs, length), *names) == want


def _jaccard(rows, k, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if s[i] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                    root[i] = root[j] = min(root[i], root[j])
    name = {}
    for (i, _), r in zip(rows, root, strict=True):
        name[r] = i if name.get(r) is None else name[r] if i is None else min(name[r], i)
    return sorted(((i, len(x), name[r]) for (i, _), x, r in zip(rows, s, root, strict=True)), key=repr)


@pytest.mark.parametrize(("k", "num", "largest"), [(4, 85, None), (5, 80, None), (2, 60, None), (4, 85, 300), (2, 60, 400)])
def test_jaccard(docs, rows, none, monkeypatch, k, num, largest):
    """With a small ``largest``, components are verified in blocks, and all joins are shuffles."""
    if largest:
        monkeypatch.setattr(ngram_join, "LARGEST", largest)
        monkeypatch.setattr(staging, "BROADCAST", -1)
    assert got(ngram_join.jaccard_components(docs, k, num, 100), "doc_id", "n_shingles", "component_id") == _jaccard(rows, k, num, 100)
    if largest is None:
        assert ngram_join.jaccard_components(none, k, num, 100).count() == 0


def test_large_candidate_components_are_parted(spark, monkeypatch):
    """Half of a group are copies of one text, the others too far from all."""
    r, staged, write = random.Random(4), [], ngram_join.stage
    monkeypatch.setattr(ngram_join, "LARGEST", 3000)
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: staged.append(name) or write(df, name))
    base, texts = [f"w{r.randrange(900)}" for _ in range(200)], []
    for i in range(200):
        texts.append(" ".join(f"w{r.randrange(900)}" if r.random() < (0.008, 0.05)[i % 2] else w for w in base))
    sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (t.split() for t in texts)]
    want = list(range(200))
    for _ in range(4):
        for i, j in itertools.combinations(range(200), 2):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want[i] = want[j] = min(want[i], want[j])
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 5, 80, 100).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(want))
    assert len(set(want)) > 80
    assert "fine-candidates" in staged


def test_contamination(spark, docs, none):
    text = {x["doc_id"]: x["text"] for x in docs.collect()}
    long = text[5].split()
    items = [(1, " ".join(long[20:50])), (2, " ".join(long[20:50])), (10, "É, " + " ".join(long[:3])), (3, None), (4, "..."), (5, long[7]), (6, "never seen words at all")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, window string")
    out = {(x["doc_id"], x["hash"]): x for x in decontaminate.contamination(docs, bench).collect()}
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 13]): set() for _, t in items for w in [words(t)] if w for i in range(max(1, len(w) - 12))}
    for n, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[i : i + 13])].add(n)
    seen = 0
    for x in docs.collect():
        w = words(x["text"])
        hit, own = set(), set()
        for q, names in windows.items():
            for i in range(len(w) - len(q) + 1):
                if tuple(w[i : i + len(q)]) == q:
                    hit |= set(range(i, i + len(q)))
                    own |= names
        want = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        match = [v for (i, _), v in out.items() if i == x["doc_id"] and tuple(v)[1:6] == want]
        assert match, (x["doc_id"], want)
        seen += bool(hit)
    assert seen > 5
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_warc(spark):
    big = "<p>é</p>" * 30
    pages = [(5, "http://x/1", big), (2, None, big), (9, "u", big), (4, "a b\n", "short"), (3, "v", "short"), (8, "http://a/b%41c?x=%2520", None), (None, "ü %7A", big), (2, None, big)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    out = warc.warc_round_trip(df)
    assert got(out, "page_id", "record_type", "refers_to") == sorted([(5, "revisit", 2), (2, "response", None), (9, "revisit", 2), (4, "response", None), (3, "response", None), (8, "response", None), (None, "revisit", 2), (2, "response", None)], key=repr)
    assert {(x["page_id"], x["url"], x["payload_bytes"]) for x in out.collect()} == {(i, u, len((h or "").encode())) for i, u, h in pages}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_packing(docs, rows, none):
    out = packing.best_fit_packing(docs, WORDS, 1, 64).collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(WORDS, t, 1)
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), crc(ids[k : k + 64])] += 1
    assert Counter(tuple(x)[:5] for x in out) == want
    by = {}
    for x in out:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.best_fit_packing(none, WORDS, 1, 64).count() == 0


def test_classifiers(spark, docs, none):
    d, lab = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    for run, modulus, held in ((quality.quality_scores, 3, 1), (toxicity.toxicity_scores, 5, 0)):
        out = run(d, lab).collect()
        assert len(out) == d.count()
        assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) and x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % modulus == held) for x in out)
        odd = run(docs, lab.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], lab.schema)))
        assert odd.count() == docs.count()
        assert {x["score"] for x in run(docs, lab.limit(0)).collect()} == {0.5}
        assert run(none, lab).count() == 0
    names = {x["doc_id"]: (x["quality"], x["predicted"]) for x in quality.quality_scores(d, lab).join(lab, "doc_id").collect()}
    assert np.mean([a == b for a, b in names.values()]) > 0.9


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only a few rows have, and a text of over 50,000 characters, count whatever ``rows`` is."""
    r = random.Random(3)
    plain = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "stone"]) for _ in range(n))
    texts = [(i, plain(9000 if i % 50 == 1 else 12) + (" vile" if i % 2 else ""), "en") for i in range(400)]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, i % 2) for i, _, _ in texts], "doc_id long, toxic int")
    seen = []
    whole = toxicity._learn

    def learn(rows, *start):
        seen.append((rows.count(), rows.agg(F.max(F.length("words"))).first()[0]))
        return whole(rows, *start)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "_learn", learn)
        m, limits = toxicity.fit(d, lab, F.lit(True), rows=20)
    assert len(seen) == 2 and 280 < seen[1][0] < 360 and seen[1][1] > 9000 * 12
    assert set(limits) == {None, "en"}
    got = toxicity.score(d, m).collect()
    assert np.mean([(x["score"] >= 0.5) == bool(x["doc_id"] % 2) for x in got]) > 0.9


def test_classifiers_on_held_out_labels(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    for run, label in ((quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        held = run(d, lab).where("held_out").join(lab, "doc_id").select("predicted", label).collect()
        assert len(held) > 50
        assert np.mean([x["predicted"] == x[label] for x in held]) > 0.93


def test_samples_are_bounded(spark):
    """An id that many rows repeat, null languages beside others, and a text too long to learn from."""
    rows = [(1, "good words here", None)] * 300 + [(1, "good words here", "en"), (2, "bad vile words", None), (3, "x " * samples.LONGEST, "en"), (4, "other good words", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 1), (4, 0, 0)], "doc_id long, toxic int, quality int")
    got = samples.labelled(d, lab, "toxic", F.lit(True), 10, ("lang",)).collect()
    assert Counter(x["label"] for x in got) == {0: 10, 1: 1}
    assert toxicity.toxicity_scores(d, lab, rows=10).count() == len(rows)
    assert quality.quality_scores(d, lab, rows=10).count() == len(rows)


def test_long_texts(spark, monkeypatch):
    """Texts beyond every block: of files, reads, slices, anchors and ranges."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, None), (4, "head " + long[:200_000]), (5, long[100_000:100_300]), (6, "short text of its own")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(token_output, "FILE_TOKENS", 1000)
    monkeypatch.setattr(token_output, "READ_TOKENS", 500)
    out = sorted(token_output.token_output(d, BYTES, 2).collect(), key=lambda x: x["start"])
    assert [(x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in out] == [(i, len(k), crc(k)) for i, t in rows for k in [ids_of(BYTES, t, 2)]]
    assert got(token_counts.token_counts(d, BYTES, 100)[0], "doc_id", "n_tokens") == [(i, len(ids_of(BYTES, t, 2)) - 1) for i, t in rows]
    pieces = packing.best_fit_packing(d, WORDS, 1, 4096).collect()
    assert Counter(x["doc_id"] for x in pieces) == Counter({i: -(-len(ids_of(WORDS, t, 1)) // 4096) for i, t in rows})
    assert got(ngram_join.jaccard_components(d, 4, 85, 100), "doc_id", "n_shingles", "component_id") == _jaccard(rows, 4, 85, 100)
    norm = lambda t: (t or "").encode().translate(None, exact_dedup.BLANKS)
    assert got(exact_dedup.exact_groups(d, digest_all=True), "doc_id", "text_sha256") == [(i, hashlib.sha256(norm(t)).hexdigest()) for i, t in rows]
    cut = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in substring_dedup.substring_dedup(d).collect()}
    assert cut == {1: (len(long),) * 2 + (1,), 2: (len(long) + 4, len(long), 1), 3: (0, 0, 0), 4: (200_005, 200_000, 1), 5: (300, 300, 1), 6: (21, 0, 0)}
    bench = spark.createDataFrame([(9, long[150_000:150_400].partition(" ")[2].rpartition(" ")[0])], "item_id long, text string")
    found = {x["doc_id"]: x["n_items"] for x in decontaminate.contamination(d, bench).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    monkeypatch.setattr(warc, "RANGE", 50_000)
    monkeypatch.setattr(warc, "GAP", 0)
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in [*rows, (7, long)]], "page_id long, url string, html string")
    back = {x["page_id"]: (x["record_type"], x["payload_bytes"], x["refers_to"]) for x in warc.warc_round_trip(pages).collect()}
    assert back == {i: ("response", len(t or ""), None) for i, t in rows} | {7: ("revisit", len(long), 1)}
    lab = spark.createDataFrame([(5, 0, 0), (6, 1, 1)], "doc_id long, toxic int, quality int")
    for run in (lambda: toxicity.toxicity_scores(d, lab, lang=None), lambda: quality.quality_scores(d, lab)):
        assert all(0 <= x["score"] <= 1 for x in run().collect())


def test_joins_by_shuffle_only(spark, docs, monkeypatch):
    """The far side of every broadcast that is bounded by size."""
    bench = spark.createDataFrame([(1, " ".join(docs.where("doc_id = 5").first()["text"].split()[20:50]))], "item_id long, text string")
    html = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    runs = [
        lambda: got(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "items_sha256"),
        lambda: got(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept"),
        lambda: got(token_counts.token_counts(docs, BYTES, 100)[0], "doc_id", "n_tokens"),
        lambda: got(warc.warc_round_trip(html), "page_id", "record_type", "refers_to", "payload_digest"),
        lambda: got(ngram_join.jaccard_components(docs, 4, 85, 100), "doc_id", "component_id"),
        lambda: got(substring_dedup.substring_dedup(docs, 80), "doc_id", "kept_sha256"),
    ]
    want = [run() for run in runs]
    monkeypatch.setattr(staging, "BROADCAST", -1)
    assert [run() for run in runs] == want


def test_light_sets_are_linked_by_subsets(spark, monkeypatch):
    """All links come from the light side when lists are made to look long, all from the heavy side when short."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(n)] for n in range(8, 17) for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w[1:])) for i, w in enumerate(base)] + [(200 + i, " ".join([*w[:-1], word()])) for i, w in enumerate(base)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = _jaccard(rows, 4, 85, 100)
    for light in (0, 9, ngram_join.Threshold(85, 100).most()):
        monkeypatch.setattr(ngram_join, "boundary", lambda *_, light=light: light)
        assert got(ngram_join.jaccard_components(d, 4, 85, 100), "doc_id", "n_shingles", "component_id") == want
    assert sum(i != c for i, _, c in want) > 20
    monkeypatch.setattr(ngram_join, "verified_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    found = got(ngram_join.jaccard_components(d, 4, 85, 100), "doc_id", "n_shingles", "component_id")
    assert [x for x in found if x[1] <= 13] == [x for x in want if x[1] <= 13]


def test_token_counts_reads_its_cache(spark, monkeypatch):
    run = entry.queries()["op5_token_counts"]
    want = got(run(spark, SF), "doc_id", "n_bytes", "n_tokens", "over_limit", "text_digest")

    def no_misses(tokenizer):
        def run(batches):
            for batch in batches:
                assert not batch.num_rows
                yield batch

        return run

    monkeypatch.setattr(token_counts, "_count", no_misses)
    assert got(run(spark, SF), "doc_id", "n_bytes", "n_tokens", "over_limit", "text_digest") == want


def test_pipeline_decides_by_row(spark, tmp_path):
    """Ids that are null, or repeat with other texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(7))
    a, b, c, d, e, leak = (" ".join(word() for _ in range(60)) for _ in range(6))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda step, rows: got(step(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)), "doc_id", "text")
    key = lambda rows: sorted(rows, key=repr)
    rows = [(None, a), (None, leak), (None, b), (7, leak), (7, c), (8, d), (None, None)]
    assert run(corpus_pipeline.benchmark, rows) == key([(None, a), (None, b), (7, c), (8, d), (None, None)])
    rows = [(1, a), (7, a), (7, b), (None, c), (9, c), (None, d), (3, d + " "), (4, e), (4, e), (5, leak), (5, " " + leak)]
    assert run(corpus_pipeline.exact, rows) == key([(1, a), (7, b), (None, c), (3, d + " "), (4, e), (5, " " + leak)])
    rows = [(1, a), (7, a + " x"), (7, b), (None, b + " x"), (None, c), (None, c + " x"), (None, d), (4, e), (4, e), (5, leak), (5, leak + " x"), (None, None), (None, None)]
    out = run(corpus_pipeline.near, rows)
    assert len(out) == 8
    assert [x for x in out if not (x[1] or "").startswith((c, leak))] == key([(1, a), (7, b), (None, d), (4, e), (None, None), (None, None)])
    assert {(i, t.removesuffix(" x")) for i, t in out if t and t.startswith((c, leak))} == {(None, c), (5, leak)}


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, ours = con.execute(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(ours.columns)
    norm = lambda v: None if v is None or v != v else v if isinstance(v, str | bool) else float(v)
    rows = lambda df: sorted((tuple(map(norm, r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False)), key=repr)
    assert rows(ours) == rows(want)
