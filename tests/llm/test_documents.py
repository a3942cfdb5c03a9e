"""Operators on documents against brute force, the reference library, round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import same_rows
from pyspark.sql import functions as F

from tidewind.llm import langid, mixing, paragraphs, quality, sharding, simhash, toxicity
from tidewind.llm import queries as q
from tidewind.llm.bpe import Bpe, encode_decode
from tidewind.llm.components import connected_components
from tidewind.llm.oracle import oracle_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def nasty(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(40_000))
    para = " ".join(f"same{i}" for i in range(40))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, None), (3, long, "en", "a", len(long)), (4, f"{para}\nown line", "de", "b", 1), (5, f"other\n{para}", None, "b", 1)]
    rows += [(5, f"other\n{para}", None, "b", 1)] * 2 + [(None, "text without an id", "fr", "c", 3), (6, "\n\t \x0b", "fr", "c", 4), (7, "漢字 İ ﬃ \U0001f600", "zz", "c", 4)]
    out = spark.createDataFrame(rows, DOCS)
    return out.withColumns({c: F.lit("clash") for c in ("shard", "slot", "size", "fp", "key", "count", "rk", "u", "root", "kept", "class_id", "n_words", "score", "taken", "quality_score")})


def components_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 400 + i) for i in range(1, 50)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = components_of(600, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash.


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_a_plain_count(spark, sf_dir):
    texts = ["", None, "one", "One TWO", "a b c", "a b c d", "É é x y z", "x " * 500] + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    assert [simhash.simhash_text(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_links_lose_no_component(spark, bucket_rows):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:40]:
        for _ in range(8):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(f)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    at = {f: i for i, f in enumerate(signed)}
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket_rows=bucket_rows)[0].collect()
    assert all((fps[at[a]] ^ fps[at[b]]).bit_count() <= 64 for a, b in found)
    assert components_of(len(fps), [(at[a], at[b]) for a, b in found]) == components_of(len(fps), pairs)


def test_pivot_distances_bound_the_distance(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(50)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = {r["fp"]: r for r in simhash.pivot_table(spark.createDataFrame([(f,) for f in signed], "fp long"), 6).collect()}
    refs = simhash.pivots(8).tolist()
    cuts = [round(i * 64 / 6) for i in range(7)]
    for f, s in zip(fps, signed, strict=True):
        assert list(int(rows[s]["dist"]).to_bytes(8, "little")) == [(f ^ p).bit_count() for p in refs]
        for low, high, band in zip(cuts, cuts[1:], rows[s]["bands"], strict=False):
            assert [band >> 4 * i & 15 for i in range(8)] == [((f ^ p) >> low & (1 << (high - low)) - 1).bit_count() for p in refs]


def test_simhash_query_matches_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(d["text"]) for d in docs]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    groups = components_of(len(docs), pairs)
    low = defaultdict(lambda: 1 << 62)
    for d, g in zip(docs, groups, strict=True):
        low[g] = min(low[g], d["doc_id"])
    want = sorted((d["doc_id"], f"{f:016x}", low[g]) for d, f, g in zip(docs, fps, groups, strict=True))
    assert sorted(map(tuple, q.op4_simhash(spark, sf_dir).collect())) == want


def test_simhash_of_nasty_rows(spark):
    df = nasty(spark)
    got = simhash.simhash_components(df).collect()
    assert len(got) == df.count()
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] == 5] == [5] * 3
    assert simhash.simhash_components(df.limit(0)).count() == 0


# Mixing.


def test_mixing_matches_sql(spark, sf_dir):
    n = same_rows(q.op3_mixing(spark, sf_dir), oracle_sql()["op3_mixing"], sf_dir)
    assert n == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    assert got["a"] == 200 and got["c"] == 0 and got[None] == 20
    assert math.isclose(sum(got.values()), 1.5 * 1110) and math.isclose(got["b"], 1.5 * 1110 - 220)


def test_targets_by_rounds_of_resharing(spark):
    rng = random.Random(11)
    for _ in range(12):
        sizes = [rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 5000)]) for _ in range(rng.randint(1, 9))]
        weights = {i: (5, 2, 1)[i % 3] for i in range(len(sizes))}
        want, full = {}, set()
        while True:  # what a full source can't hold goes to the others, until none is above
            left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in full)
            share = sum(weights[i] for i in weights if i not in full)
            want = {i: 2.0 * sizes[i] if i in full else left * weights[i] / share for i in weights}
            over = {i for i in weights if i not in full and want[i] > 2 * sizes[i]}
            if not over:
                break
            full |= over
        table = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(table, (5, 2, 1), 1.5, 2.0).collect()}
        assert all(math.isclose(got[f"s{i}"], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want), (sizes, got, want)


def test_mix_comes_near_its_targets_and_repeats_itself(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs, run_bits=12).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5), run_bits=12).collect()), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs, run_bits=1).collect()), key=repr)
    for source in {r["source"] for r in got}:
        rows = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
        assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_mix_of_nasty_rows(spark):
    df = nasty(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count() and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(df.limit(0)).count() == 0


def test_better_documents_are_taken_more_often(spark):
    names = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "iota", "zeta"]
    texts = [" ".join(names)] * 400 + [" ".join(f"{w[0]}1234" for w in names)] * 400 + [" ".join(names[:2] * 5)] * 400
    got = mixing.mix(docs_of(spark, texts), weights=(1,), share=0.4, limit=2.0).collect()
    good, symbols, repeats = (sum(r["taken"] > 0 for r in got if r["doc_id"] // 400 == i) for i in range(3))
    assert good > 2 * symbols > 0 and good > 2 * repeats > 0


# Sharding.


def test_mixing_weight_sees_repetition_and_symbols_but_not_length(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    n = mixing.words(F.col("text"))
    band = F.when(n <= 50, 0).when(n <= 1000, 1).otherwise(2)
    rows = docs.groupBy("quality", band.alias("band")).agg(F.avg(mixing.quality_weight(F.col("text"))).alias("w"), F.count("*").alias("n")).collect()
    good, bad = ([r["w"] for r in rows if r["quality"] == q and r["n"] >= 5] for q in (1, 0))
    assert len(good) == 3 and min(good) > 0.9 * max(good) and min(good) > 1.4 * max(bad)
    texts = ["word", "", None, "!!! ???", "a b c d", "a a a a", "a b # $", "a b c d " * 500]
    got = [r["w"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(mixing.quality_weight(F.col("text")).alias("w")).collect()]
    assert got[:6] == [1.0, 0.1, 0.1, 0.1, 1.0, 0.1] and got[6] == 0.5 and 0.1 <= got[7] < 0.2


def test_hypergeometric_moments():
    rng = random.Random(3)
    got = [sharding.hypergeometric(rng, 300, 700, 100) for _ in range(4000)]
    assert abs(np.mean(got) - 30) < 0.3 and abs(np.var(got) - 100 * 0.3 * 0.7 * 900 / 999) < 1.5
    assert sharding.hypergeometric(rng, 5, 0, 5) == 5 and sharding.hypergeometric(rng, 0, 9, 4) == 0
    big = sharding.hypergeometric(rng, 10**9, 7 * 10**9, 10**8)
    assert abs(big - 10**8 / 8) < 10**5


def test_matrix_has_exact_sums():
    rows = [random.Random(i).randrange(50) for i in range(40)]
    m = sharding.communication_matrix(rows, 8, 1)
    assert [sum(r) for r in m] == rows
    sums = [sum(c) for c in zip(*m, strict=True)]
    assert max(sums) - min(sums) <= 1 and sum(sums) == sum(rows)


def test_sharding_query(spark, sf_dir):
    got = q.op5_sharding(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, q.op5_sharding(spark, sf_dir).collect()), key=repr)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    import zlib

    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)


def test_shards_are_uniform(spark):
    rows = spark.range(4000)
    seen = np.zeros((2, 8))
    for seed in range(6):
        for r in sharding.uniform_shards(rows, F.xxhash64("id"), seed=seed).collect():
            seen[int(r["id"] < 2000), r["shard"]] += 1
    spread = seen[1] - seen.sum(axis=0) / 2
    assert np.abs(spread).max() < 5 * math.sqrt(seen.sum() / 8 / 4)


def test_sharding_of_nasty_rows_has_no_python(spark):
    df = nasty(spark)
    out = sharding.uniform_shards(df, F.xxhash64("doc_id", "text"))
    assert out.count() == df.count() and set(out.columns) == set(df.columns)
    assert sorted(r["slot"] for r in out.where("shard = 0").collect()) == list(range(out.where("shard = 0").count()))
    assert sharding.uniform_shards(df.limit(0), F.xxhash64("doc_id")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# Toxicity, quality, language.


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    fair = [np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.1) for _ in range(3)]
    copied = np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.4)
    votes = np.stack([*fair, *[copied] * 6], axis=1)
    known = np.where(rng.random(4000) < 0.2, y, -1)
    p = toxicity.label_model(votes, known)
    hidden = known < 0
    assert ((p[hidden] > 0.5) == y[hidden]).mean() > 0.9


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.1"


def test_toxicity_held_out(spark, sf01):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    got = q.op6_toxicity(spark, sf01).collect()
    assert len(got) == spark.read.parquet(f"{sf01}/documents.parquet").count()
    judged = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(judged) > 300 and np.mean([a == b for a, b in judged]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_counts_by_brute_force():
    def plain(text):
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
        seen, dup = [], 0
        for line in text.split("\n"):
            if any(c not in " \t\n\v\f\r" for c in line):
                dup += line in seen
                seen.append(line)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        cover = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "a", "\n", "é ", " ", "#", "\t", "\x1c", "a b c\n", "x"]) for _ in range(rng.randrange(60)))
        assert quality.base_counts(text) == plain(text), repr(text)
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)


def test_quality_keeps_good_documents(spark, sf01):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    got = [r for r in q.op7_quality(spark, sf01).collect() if r["doc_id"] in truth and not r["base_failed"]]
    good = [r["kept"] for r in got if truth[r["doc_id"]] == 1]
    bad = [r["kept"] for r in got if truth[r["doc_id"]] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.4


def test_language_held_out(spark, sf01):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    got = q.op9_language(spark, sf01).collect()
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(got) == len(truth) and np.mean(held) > 0.97


def test_language_scores_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs.collect()]
    words = lambda t: langid.LETTERS.findall((t or "").lower())
    counts = defaultdict(Counter)
    for _, text, lang, held in rows:
        if text is not None and lang is not None and not held:
            for w in words(text):
                counts[lang, 0][w] += 1
                for k in range(1, 5):
                    counts[lang, k].update(langid.grams(w, k))
    langs = sorted({lang for lang, _ in counts})
    kept = {key: dict(sorted(c.items(), key=lambda e: (-e[1], e[0]))[: 8_000 if key[1] else 30_000]) for key, c in counts.items()}
    total = {key: sum(c.values()) for key, c in counts.items()}
    some = {k: set().union(*(kept[lang, k] for lang in langs)) for k in range(5)}
    log = lambda lang, k, g: math.log(kept[lang, k].get(g, 0.3) / total[lang, k])

    def of_word(w, lang):
        if w in some[0]:
            return log(lang, 0, w)
        for k in (4, 3, 2, 1):
            found = [g for g in langid.grams(w, k) if g in some[k]]
            if found:
                return sum(log(lang, k, g) for g in found) / len(found) + (5 - k) * math.log(0.4)
        return 0.0

    got = {r["doc_id"]: r for r in q.op9_language(spark, sf_dir).collect()}
    for doc_id, text, _, held in rows:
        found = words(text)
        logs = [sum(of_word(w, lang) for w in found) / math.sqrt(max(1, len(found))) for lang in langs]
        share = [math.exp(x - max(logs)) for x in logs]
        assert got[doc_id]["held_out"] == held
        assert got[doc_id]["lang_pred"] == (langs[share.index(1.0)] if found else "und")
        assert math.isclose(got[doc_id]["score"], 1 / sum(share) if found else 0.0, rel_tol=1e-4)


def test_sparse_and_dense_language_tables_agree(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    dense = langid.Scorer(model)
    monkeypatch.setattr(langid, "DENSE_CELLS", 0)
    sparse = langid.Scorer(model)
    for r in docs.collect():
        (a, s), (b, t) = dense.text(r["text"]), sparse.text(r["text"])
        assert a == b and math.isclose(s, t, rel_tol=1e-4)


def test_toxicity_scores_by_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.where(~q.held_out(0, 5)), labels.where(~q.held_out(0, 5)))
    weight = dict(zip(["seed insult", "two seed insults", "shouted words", "marks in a row", *model["names"]], model["weights"], strict=True))
    got = {r["doc_id"]: r for r in q.op6_toxicity(spark, sf_dir).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        words = {w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()}
        plain = {w if w.isalpha() else w.translate(toxicity.LETTER_FOR) for w in words}
        seeds = sum(w in toxicity.INSULTS for w in words)
        fired = {"=" + w for w in plain} | {w[:k] + "*" for w in plain for k in range(4, 9) if len(w) > k} | {"*" + w[-4:] for w in plain if len(w) > 4}
        fired |= {n for n, on in (("seed insult", seeds > 0), ("two seed insults", seeds > 1), ("shouted words", sum(map(str.isupper, text)) > len(text) / 2), ("marks in a row", "!!!" in text or "?!?" in text)) if on}
        score = 1 / (1 + math.exp(-max(-30, min(30, model["bias"] + sum(w for n, w in weight.items() if n in fired)))))
        assert math.isclose(got[r["doc_id"]]["score"], score, rel_tol=1e-5) and got[r["doc_id"]]["predicted"] == (score >= 0.5)


def test_word_first_backoff(spark):
    docs = spark.createDataFrame([(i, t, lang, "a", 1) for i, (t, lang) in enumerate([("the house is here", "en"), ("das haus ist hier", "de")] * 5)], DOCS)
    scorer = langid.Scorer(langid.train(docs))
    assert scorer.text("THE house")[0] == "en" and scorer.text("hausig")[0] == "de"
    assert scorer.text("") == scorer.text(None) == scorer.text("123 ½ !") == ("und", 0.0)
    assert scorer.text("字" * 10)[0] in ("de", "en")


def test_classifiers_take_nasty_and_empty_tables(spark):
    df, no = nasty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (3, 1, 0), (6, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (no, labels):
        for table in (df, df.limit(0)):
            n = table.count()
            assert quality.judge(table, quality.train(table, given)).count() == n
            assert toxicity.score(table, toxicity.train(table, given)).count() == n
            assert langid.identify(table, langid.train(table)).count() == n
    kept = quality.judge(df, quality.train(df, no)).where("kept").collect()
    assert [r["doc_id"] for r in kept] == [3]


# Paragraphs.


def jaccard(a, b):
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("part_rows", [512, 3])
def test_paragraphs_against_all_pairs(spark, part_rows):
    rng = random.Random(9)
    base = [[f"v{rng.randrange(5000)}" for _ in range(60)] for _ in range(12)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 3)):
            words = list(base[rng.randrange(12)])
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                words[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
            lines.append(" ".join(words))
        lines.insert(rng.randrange(len(lines) + 1), " ".join(f"only{i}x{k}" for k in range(30)))
        texts.append("\n".join(lines))
    units = [(d, n, line) for d, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    sure = [(i, j) for i in range(len(units)) for j in range(i) if jaccard(units[i][2], units[j][2]) >= 0.8]
    classes = defaultdict(list)
    for unit, c in zip(units, components_of(len(units), sure), strict=True):
        classes[c].append(unit)
    gone = defaultdict(set)
    links = defaultdict(set)
    for members in classes.values():
        first = min(d for d, _, _ in members)
        if len({d for d, _, _ in members}) > 1:
            for d, n, _ in members:
                links[d].add(n)
                if d != first:
                    gone[d].add(n)
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(docs_of(spark, texts), recall=0.999999, part_rows=part_rows).collect()}
    for d, t in enumerate(texts):
        assert got[d]["text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])
        assert got[d]["n_links"] == len(links[d]) and got[d]["n_removed"] == len(gone[d])


def test_bands_are_tuned():
    assert paragraphs.tune_bands(0.8, 0.99) == (12, 5)
    assert paragraphs.tune_bands(0.8, 0.5)[0] < 12


def test_clean_documents_are_left_alone(spark):
    rng = random.Random(3)
    clean = [" ".join(f"c{rng.randrange(10**6)}" for _ in range(80)) + "\nLicensed under the same short line.\n" for _ in range(20)]
    passage = " ".join(f"p{i}" for i in range(55))
    dirty = [f"start{i} of it\n{passage}\nend{i}" for i in range(5)]
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(docs_of(spark, clean + dirty)).collect()}
    assert all(got[i]["text"] == clean[i] and got[i]["n_links"] == 0 and got[i]["class_id"] == i for i in range(20))
    assert passage in got[20]["text"] and all(passage not in got[20 + i]["text"] and got[20 + i]["source_doc_ids"] == [20] for i in range(1, 5))


def test_paragraphs_of_nasty_rows(spark):
    df = nasty(spark)
    got = paragraphs.repeated_paragraphs(df).collect()
    assert len(got) == df.count()
    assert [r["text"] for r in got if r["doc_id"] == 5] == ["other"] * 3
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None]
    assert {c for c in df.columns} <= set(got[0].asDict())
    assert paragraphs.repeated_paragraphs(df.limit(0)).count() == 0


def test_shouting_is_counted_over_the_whole_text():
    at = toxicity.PATTERNS.index("shouted words")
    assert not toxicity.patterns("Abcd" * 4096, set())[at]  # every fourth character a capital
    assert toxicity.patterns("aBCD" * 4096, set())[at]
    assert not toxicity.patterns("", set())[at] and not toxicity.patterns("Ab" * 3, set())[at] and toxicity.patterns("ABc", set())[at]


def words_of(text):
    return (text or "").encode().lower().split()


def test_winnowing_meets_every_run():
    rng = random.Random(12)
    for _ in range(200):
        run = [b"%d" % rng.randrange(9) for _ in range(51)]
        pages = [[b"x%d" % rng.randrange(99) for _ in range(rng.randrange(70))] + run + [b"y%d" % rng.randrange(99) for _ in range(rng.randrange(70))] for _ in range(2)]
        picked = []
        for page in pages:
            raw = b" ".join(page)
            hashes = paragraphs.rolling(paragraphs.word_hashes(raw, paragraphs.word_spans(raw)), 16)
            assert len(hashes) == len(page) - 15 and len(set(hashes.tolist())) == len({tuple(page[i : i + 16]) for i in range(len(page) - 15)})
            picked.append(set(hashes[paragraphs.winnow(hashes, 36)].tolist()))
        assert picked[0] & picked[1]


def test_runs_inside_long_lines_and_over_wrapped_lines(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    run, short = fresh(55), fresh(50)
    wrapped = "\n".join(" ".join(run[i : i + 11]) for i in range(0, 55, 11))
    heads = [fresh(200) for _ in range(4)]
    texts = [
        " ".join(heads[0] + run + fresh(150)),
        " ".join(heads[1]) + "  " + " ".join(run).upper() + "  end of  it",
        f"head\n{wrapped}\ntail",
        " ".join(heads[2] + run[:51]),
        " ".join(heads[3] + short + fresh(9)),
        " ".join(fresh(9) + short),
    ]
    texts.append(texts[5])
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(docs_of(spark, texts)).collect()}
    want = [texts[0], " ".join(heads[1]) + "  end of  it", "head\ntail", " ".join(heads[2]), texts[4], texts[5], ""]
    assert [got[i]["text"] for i in range(7)] == want
    assert [got[i]["n_removed"] for i in range(7)] == [0, 1, 1, 1, 0, 0, 1]
    assert [got[i]["n_links"] for i in range(7)] == [1, 1, 1, 1, 0, 1, 1]
    assert [got[i]["source_doc_ids"] for i in range(7)] == [[], [0], [0], [0], [], [], [5]]
    assert [got[i]["class_id"] for i in range(7)] == [0, 0, 0, 0, 4, 5, 5]


def test_runs_against_all_windows(spark):
    rng = random.Random(15)
    pool = [f"p{i}" for i in range(600)]
    texts = []
    for i in range(50):
        words = []
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(540)
            words += [f"o{i}x{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] + pool[at : at + rng.randint(30, 90)]
        texts.append("".join(w + rng.choice("     \n") for w in words))
    first = {}
    want = {}
    for d, text in enumerate(texts):
        words, lost = words_of(text), set()
        for i in range(len(words) - 50):
            if first.setdefault(tuple(words[i : i + 51]), d) != d:
                lost.update(range(i, i + 51))
        want[d] = [w for i, w in enumerate(words) if i not in lost]
    assert sum(len(w) for w in want.values()) < sum(len(words_of(t)) for t in texts)
    got = {r["doc_id"]: r["text"] for r in paragraphs.repeated_paragraphs(docs_of(spark, texts), min_words=10**6).collect()}
    assert {d: words_of(t) for d, t in got.items()} == want


# BPE.


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_query_matches_the_library(spark, sf_dir, library):
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, q.op10_bpe(spark, sf_dir).collect())) == sorted(want)


def test_bpe_on_odd_texts(library):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        bpe = Bpe(file.read())
    rng = random.Random(6)
    texts = ["", "a" * 4000, "é" * 300, "x<|endoftext|>y <|startoftext|>", "ΟΔΥΣΣΕΥΣ Σ", "İ ﬃ ½ 漢字", "don't we'll 2024!!!", "\x00\x1f\x85   z"]
    texts += ["".join(rng.choice("aaabcinthe!!.-'sd 09éß") for _ in range(rng.randrange(80))) for _ in range(800)]
    for t in texts:
        ids, decoded = bpe.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, repr(t)
        assert decoded == bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_compatibility_is_that_of_merging(library):
    """Two tokens are compatible just when merging their symbols gives them back."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        bpe = Bpe(file.read())

    def merged(seq):
        while True:
            ranks = [(bpe.pair_rank[p], i) for i, p in enumerate(zip(seq, seq[1:], strict=False)) if p in bpe.pair_rank]
            if not ranks:
                return seq
            i = min(ranks)[1]
            seq = seq[:i] + [library.token_to_id(bpe.text_of[seq[i]] + bpe.text_of[seq[i + 1]])] + seq[i + 2 :]

    rng = random.Random(8)
    for _ in range(1500):
        a, b = rng.randrange(512, 3000), rng.randrange(512, 3000)
        if bpe.text_of[a].endswith("</w>"):
            continue
        assert bpe.compatible(a, b) == (merged(bpe.symbols(a) + bpe.symbols(b)) == [a, b])


def test_words_are_cut_like_the_library_cuts_them_for_every_code_point(library):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        bpe = Bpe(file.read())
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            text = f"e{chr(c)}a"
            clean = library.normalizer.normalize_str(text)
            assert bpe.pieces(text) == [clean[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(clean)], hex(c)


def test_bpe_of_nasty_rows(spark):
    df = nasty(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = encode_decode(df, path).collect()
    assert len(got) == df.count() and [bytes(r["ids"]) for r in got if r["doc_id"] == 2] == [b""]
    assert encode_decode(df.limit(0), path).count() == 0


def thue_morse(n, zero, one):
    """Two sequences that agree under any polynomial with an odd base modulo a power of two."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return [(zero, one)[b] for b in bits], [(one, zero)[b] for b in bits]


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_words_and_lines_of_no_common_hash(n):
    a, b = ("".join(x).encode() for x in thue_morse(n, "a", "b"))
    one, two = (paragraphs.word_hashes(x, paragraphs.word_spans(x)) for x in (a, b))
    assert one != two
    lines = [" ".join(x).encode() for x in thue_morse(n, "left", "right")]
    hashes = [paragraphs.word_hashes(x, paragraphs.word_spans(x)) for x in lines]
    whole = np.array([0]), np.array([n])
    assert paragraphs.range_hashes(hashes[0], *whole) != paragraphs.range_hashes(hashes[1], *whole)
    for width in (5, 16, 51, 64, n):
        assert paragraphs.rolling(hashes[0], width)[0] != paragraphs.rolling(hashes[1], width)[0]


def test_word_hashes_are_of_the_word_alone():
    words = ["a", "b" * 63, "c" * 64, "d" * 65, "e" * 300, "é", "a"]
    raw = "  \n".join(words).encode() + b"\t"
    for lead in (b"", b" \n"):
        data = lead + raw
        got = paragraphs.word_hashes(data, paragraphs.word_spans(data))
        alone = [paragraphs.word_hashes(w.encode(), paragraphs.word_spans(w.encode()))[0] for w in words]
        assert got.tolist() == alone and len(set(alone)) == 6
    assert len(paragraphs.word_hashes(b" \n", paragraphs.word_spans(b" \n"))) == 0


def test_different_texts_stay_however_alike_their_polynomials(spark):
    pairs = [["".join(x) for x in thue_morse(1024, f"{i:02d}a", f"{i:02d}b")] for i in range(60)]
    texts = [" ".join(p[side] for p in pairs) for side in (0, 1)]
    texts += [" ".join(x) for x in thue_morse(2048, "left", "right")]
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(docs_of(spark, texts), run_words=2000).collect()}
    assert all(got[i]["text"] == texts[i] and got[i]["n_removed"] == 0 for i in (0, 1))


def test_recall_of_production_bands(spark):
    rng = random.Random(11)
    texts, links = [], 0
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        near = list(words)
        near[rng.randrange(5, 55)] = f"x{i}"  # 5 of 56 shingles differ: a similarity of 51 / 61
        texts += [" ".join(words), " ".join(near)]
        links += 1
    got = {r["doc_id"]: r for r in paragraphs.repeated_paragraphs(docs_of(spark, texts), run_words=10**6).collect()}
    assert sum(got[2 * i + 1]["class_id"] == 2 * i for i in range(links)) >= 0.97 * links


def test_lines_without_a_lost_word_are_not_searched(monkeypatch):
    lines = [" ".join(f"w{i}x{j}" for j in range(6)) for i in range(1000)]
    calls, spans = [], paragraphs._spans
    monkeypatch.setattr(paragraphs, "_spans", lambda mark: calls.append(1) or spans(mark))
    new, n_links, n_removed = paragraphs.cut_runs("\n".join(lines), [], [], [3, 4], [3, 4], 51)
    assert (n_links, n_removed) == (1, 1) and len(calls) <= 4  # before: one a line
    # Words 3 to 54 went: the end of the first line, eight whole lines, the first word of the tenth.
    assert new.split("\n") == ["w0x0 w0x1 w0x2", lines[9][5:], *lines[10:]]
