"""Every stage of the pipeline against brute force, on rows with null and repeated ids, clashing names and no rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from citeset.llm import quality
from citeset.llm.samples import fold, hash32

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, hash string, key int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and benchmark passages with the hard cases; labels as they are."""
    out, r = str(tmp_path_factory.mktemp("sf")), random.Random(8)
    docs = [(x["doc_id"], x["text"], x["lang"], x["source"], x["n_chars"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [x["text"] for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [t for _, t, *_ in docs if t and 400 < len(t) < 3000][:6]
    a, b, c, d, *_ = clean
    leak = a + " " + items[0]
    hard = [(None, b), (None, leak), (None, c + " tail"), (7, d), (7, leak), (5, a), (5, a), (5, a + " "), (None, None), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, c.replace(" ", "  ", 3)), (905, "x" * 70_000)]
    rows = docs + [(i, t, None, "s", 1) for i, t in hard]
    r.shuffle(rows)
    spark.createDataFrame([(*x, 0.1, "h", 1) for x in rows], COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate([*items, None, ""])], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def pairs(df):
    return Counter((x["doc_id"], x["text"]) for x in df.collect())


def plain_score(text, weights):
    """The dot product, word by word."""
    tokens = []
    for word in (text or "").split():
        before, core, after = re.match(r"(?s)^(\W*)(.*?)(\W*)$", word).groups()
        tokens += ["^mark " + before[:4]] * bool(before) + [core.lower()] * bool(core) + ["^upper"] * (len(core) > 1 and core.isupper()) + ["^mark " + after[:4]] * bool(after)
    h = [hash32(x) for x in tokens]
    both = h + [hash32("^repeat") if x == y else ((x * 0x9E3779B1) & 0xFFFFFFFF) ^ ((y + 0x7F4A7C15) & 0xFFFFFFFF) for x, y in zip(h, h[1:], strict=False)]
    total = sum(float(weights[(x ^ (x >> 15)) & ((1 << quality.BITS) - 1)]) for x in both)
    return 1 / (1 + np.exp(-(float(weights[-1]) + quality.SCALE * total / max(1, len(both)))))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    step = lambda name, df: corpus_pipeline.stage(stages[name](spark, df, folder), name)

    weights = quality.fit(docs, corpus_pipeline.table(spark, folder, "labels"), fold(3) != 1)
    good = step("quality", docs)
    assert good.columns == columns
    assert pairs(good) == Counter({x: n for x, n in pairs(docs).items() if plain_score(x[1], weights) >= 0.5})
    assert 100 < good.count() < docs.count()

    # On all documents, so that every hard row is met.
    exact = step("exact", docs)
    assert exact.columns == columns
    groups = {}
    for (i, t), _ in pairs(docs).items():
        groups.setdefault(norm(t), []).append((-len(t or ""), i is not None, i or 0, t))
    assert Counter((i, -n) for i, n in ((x[0], -len(x[1] or "")) for x in pairs(exact).elements())) == Counter((x[2] if x[1] else None, -x[0]) for x in map(lambda g: min(g, key=lambda y: y[:3]), groups.values()))

    near = step("near", docs)
    assert near.columns == columns
    rows = list(pairs(docs))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in range(3):
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and root[i] != root[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    kept = pairs(near)
    for x in set(root):
        own = [i for i in range(len(rows)) if root[i] == x]
        if not sets[x]:
            assert all(kept[rows[i]] == pairs(docs)[rows[i]] for i in own)
            continue
        stays = [rows[i] for i in own if kept[rows[i]]]
        assert len(stays) == 1
        assert kept[stays[0]] == 1
        named = [rows[i][0] for i in own if rows[i][0] is not None]
        assert stays[0][0] == (min(named) if named else None)

    clean = step("benchmark", docs)
    assert clean.columns == columns
    items = [words(x["text"]) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {f" {' '.join(w[i : i + 13])} " for w in items if w for i in range(max(1, len(w) - 12))}
    hit = {t for _, t in pairs(docs) if any(q in f" {' '.join(words(t))} " for q in windows)}
    assert pairs(clean) == Counter({x: n for x, n in pairs(docs).items() if x[1] not in hit})
    assert len(hit) > 3

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, places = Counter(), {}
    for (i, t), n in pairs(docs).items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += n
    packed = stages["packing"](spark, docs, folder).collect()
    assert Counter(tuple(x)[:5] for x in packed) == want
    for x in packed:
        places.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)])]
        assert [at for at, _ in sorted(own)] == ends[:-1]
        assert ends[-1] <= 4096
    assert len(places) <= 1.1 * sum(x["length"] for x in packed) / 4096 + 2


def test_run_applies_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, folder), name)
    rows = lambda df: Counter(tuple(x)[:5] for x in df.collect())
    assert rows(corpus_pipeline.run(spark, folder)) == rows(corpus_pipeline.STAGES[-1][1](spark, docs, folder))


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, none, folder).count() == 0
    docs.sparkSession.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.benchmark(spark, docs, str(tmp_path)).count() == docs.count()
