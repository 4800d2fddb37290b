import pytest

import corpus_pipeline
from ploidyflow.llm import queries

from .cases import text

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with a copy, a near copy, a shared passage, a leak and junk; what is left is known."""
    where = str(tmp_path_factory.mktemp("tables"))
    base = {i: text(i, 150, 5000) for i in range(30)}
    passage, item = text("passage", 60, 5000), text("item", 30, 5000)
    near = base[3].split()
    near[70] = "changed"
    rows = {**base, 40: base[2], 41: " ".join(near), 42: f"{text(42, 80, 5000)}\n{passage}", 43: f"{text(43, 80, 5000)}\n{passage} end", 44: f"{text(44, 90, 5000)} {item}", 45: "", 46: None, 47: "12 34 !!", 48: text("long", 40_000, 5000)}
    made = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame([*made, made[5], made[5], (None, base[1], "en", "src0", 5)], SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, passage


def test_stages(spark, folder):
    where, rows, passage = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    everything = set(rows)
    assert set(kept["language_id"]) == everything - {45, 46, 47}
    assert set(kept["near_dedup"]) == everything - {45, 46, 47, 40, 41}
    assert kept["substring_dedup"][43].text == f"{text(43, 80, 5000)}\nend" and passage in kept["substring_dedup"][42].text
    assert kept["substring_dedup"][43].n_chars == len(kept["substring_dedup"][43].text)
    assert set(kept["decontamination"]) == everything - {45, 46, 47, 40, 41, 44}
    got = [r.doc_id for r in corpus_pipeline.run(spark, where).collect()]
    assert set(got) == set(kept["decontamination"]) and got.count(5) == 3 and len(got) == len(set(got)) + 2


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
        assert docs.count() == 0


def test_queries_are_registered():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 14))
