"""The pipeline's stages, each on its own input, and the whole."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from tidewind.llm import mixing, queries, simhash


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "bpe_ids"]


def test_stages_follow_their_operators(spark, docs, tmp_path):
    sf = "/root/testdata/sf0.001"
    kept = cp.quality_rules(spark, docs, sf)
    judged = {r["doc_id"] for r in queries.op7_quality(spark, sf).where("kept").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == judged
    kept.write.parquet(str(tmp_path / "1"))
    kept = spark.read.parquet(str(tmp_path / "1"))

    single = cp.near_duplicates(spark, kept, sf)
    fps = {r["doc_id"]: simhash.simhash_text(r["text"]) for r in kept.collect()}
    got = sorted(r["doc_id"] for r in single.collect())
    for a in fps:  # who went is linked, over others, to someone smaller; who stayed isn't
        reach, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for b in fps:
                if b not in reach and (fps[x] ^ fps[b]).bit_count() <= 3:
                    reach.add(b)
                    todo.append(b)
        assert (a in got) == (a == min(reach))
    single.write.parquet(str(tmp_path / "2"))
    single = spark.read.parquet(str(tmp_path / "2"))

    cut = cp.repeated_passages(spark, single, sf)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    seen = defaultdict(set)
    for r in cut.collect():
        assert r["text"] == before[r["doc_id"]] or r["n_chars"] == len(r["text"])
        rest = iter(before[r["doc_id"]].split())  # lines go, and runs inside of lines: what stays keeps its order
        assert all(w in rest for w in r["text"].split())
        for line in r["text"].split("\n"):
            if len(line.split()) >= 20:
                seen[" ".join(line.lower().split())].add(r["doc_id"])
    assert all(len(d) == 1 for d in seen.values())
    cut.write.parquet(str(tmp_path / "3"))
    cut = spark.read.parquet(str(tmp_path / "3"))

    mixed = Counter(r["doc_id"] for r in cp.source_mix(spark, cut, sf).collect())
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(cut).collect() if r["taken"]}
    assert mixed == want


def test_one_row_of_each_component_stays(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(80))
    rows = [(5, words("x")), (5, words("y")), (5, words("y")), (7, words("y")), (None, words("x")), (None, words("z")), (None, words("z")), (None, words("v"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, cp.near_duplicates(spark, df, "").collect())))
    assert got == sorted(map(str, [(5, words("x")), (5, words("y")), (None, words("z")), (None, words("v"))]))


def test_run_gives_a_row_for_each_mixed_document(spark):
    got = cp.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50
    assert got.where(F.col("n_tokens") <= 0).count() == 0


def test_stages_take_nulls_and_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "word " * 60, None, None, 300), (2, "word " * 60, None, None, 300)]
    rows += [(3, " ".join(f"w{i % 977} x{i}" for i in range(40_000)), "de", "b", 1), (3, " ".join(f"y{i}" for i in range(70)), "de", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("clash") for c in ("size", "key", "rk", "fp", "root", "run", "u", "n", "target", "kept", "score", "ord", "taken", "class_id")})
    for table in (df, df.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, table, sf)
            assert out.count() <= 2 * table.count(), name
            if name != "bpe_ids":
                assert out.columns == table.columns


def test_passages_are_cut_once_a_row(spark, docs):
    """The stage filters by the text that Python has cut; Spark must not call it again for the filter."""
    cut = cp.repeated_passages(spark, docs, "/root/testdata/sf0.001")
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_training_gives_its_room_back(spark, monkeypatch):
    """The driver keeps nothing of the sample beside the later stages."""
    from tidewind.llm import quality

    done = []
    monkeypatch.setattr(quality, "trim", lambda: done.append(1))
    texts = [(i, " ".join(f"{'ab'[i % 2]}{i}{j}" for j in range(60)), i % 2) for i in range(40)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    assert quality.train(rows, rows)["weights"] is not None and done == [1]
