"""Texts, tables and broken writes that must not end a job."""

import pytest
from pyspark.sql import functions as F

from foliomill.llm import lm, packing, queries, sharding
from foliomill.llm.common import tokenizer_path

N = 2_000_000
RUNS = {"blanks": "x" + " " * N + "y", "hard spaces": "x" + "\u00a0" * N + "y z", "newlines": "x" + "\n" * N, "one letter": "a" * N, "mixed": " \t\u3000" * 400_000}


@pytest.fixture(scope="module")
def long_runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(RUNS.values())] + [(9, "the end of that and this for all", "en", "s", 1), (9, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_ids_of_long_runs_are_the_library_s():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for name, text in RUNS.items():
        assert packing.ids_of(text, path).tolist() == library.encode(text, add_special_tokens=False).ids, name


def test_words_of_long_runs():
    import pyarrow as pa

    path = tokenizer_path("byte_bpe_50k.json")
    ids, offsets = lm.word_ids(pa.array(["a", "x" + "\u00a0" * N + "<|endoftext|>", "b"]), path)
    assert offsets[1] == 1 and offsets[-1] == len(ids) == offsets[-2] + 1 and lm.END not in ids.tolist()


@pytest.mark.parametrize("query", ["op1_toxicity", "op3_exact_dedup", "op4_sharding", "op6_quality", "op7_lm_scoring", "op8_bpe", "op9_packing", "op10_simhash", "op12_metric_join"])
def test_queries_over_long_runs(spark, long_runs, query):
    got = queries.QUERIES[query](spark, long_runs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 9} and len(got) >= 7


def test_pipeline_over_long_runs(spark, long_runs):
    import corpus_pipeline

    corpus_pipeline.run(spark, long_runs).collect()
    packed = corpus_pipeline.pack(spark, spark.read.parquet(f"{long_runs}/documents.parquet"), long_runs).collect()
    assert sum(r.length for r in packed if r.doc_id == 0) > N


def test_pipeline_keeps_columns_of_any_name(spark, sf):
    import corpus_pipeline

    names = ["_row", "_gone", "__toxicity", "_score", "row", "size", "_ROW_", "node", "root", "_kept", "_sha"]
    good = [" ".join(f"the word{i} and that word{i}{x}" for i in range(30)) for x in "xy"]
    rows = [(1, good[0]), (2, good[0]), (3, good[1]), (4, good[1] + " more")]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(f"v{i}").alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns, name
        assert all(r[n] == f"v{i}" for r in out.collect() for i, n in enumerate(names)), name
        table = spark.createDataFrame(out.collect(), table.schema)
    assert [r.doc_id for r in table.orderBy("doc_id").collect()] == [1, 3]
    assert corpus_pipeline.pack(spark, table, sf).count() == 2


def test_broken_and_doubled_saves_of_a_slot_map(spark, sf, tmp_path):
    docs, path = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), f"file://{tmp_path}/map"
    count = docs.count()
    assert sharding.shard(docs, shards=8, slots=512, map_path=path).count() == count
    last = sharding.SlotMap.load(spark, path)
    # A save that ended after its slots: a file that no version names.
    other = sharding.SlotMap(8, tuple(7 - s for s in last.shard_of), last.version + 1, 9, (*last.history, "lost"))
    other.table(spark).write.parquet(f"{path}/slots/v{other.version}-lost")
    assert sharding.SlotMap.load(spark, path) == last
    got = sharding.shard(docs, shards=8, slots=512, map_path=path)
    assert got.count() == count == got.select("doc_id").distinct().count()
    # Two runs that store one version at once: each goes by its own map, later ones by one of the two.
    version = sharding.SlotMap.load(spark, path).version
    for shift in (1, 2):
        sharding.SlotMap(8, tuple((s + shift) % 8 for s in last.shard_of), version + 1, 9, last.history).save(spark, path)
    assert sharding.SlotMap.load(spark, path) == sharding.SlotMap.load(spark, path)
    got = sharding.shard(docs, shards=8, slots=512, map_path=path)
    assert got.count() == count and len({(r.virtual_slot, r.shard) for r in got.select("virtual_slot", "shard").collect()}) == got.select("virtual_slot").distinct().count()
