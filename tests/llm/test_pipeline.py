"""The pipeline's stages, each against what it must do with its own input, and the registered queries."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from tollgate import storage
from tollgate.llm import line_dedup, mixing, queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "packing"]
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(corpus_pipeline.common.materialize(stage(spark, inputs[-1], SF), "stage"))
    assert all(d.columns == columns for d in inputs[:-1])
    raw, good, lined, single, mixed, packed = inputs
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    have = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in inputs]
    assert have[1] < have[0] and len(have[1] & bad) < 0.2 * len(bad) and len(have[1]) > 0.7 * len(have[0])
    assert line_dedup.decisions(lined).where("n_dropped > 0").isEmpty() and good.count() >= lined.count()
    assert have[3] == {r["component_id"] for r in simhash.near_duplicates(lined).collect()} and single.count() == len(have[3])
    words = lambda d: sum(len(re.findall(mixing.WORD, r["text"])) for r in d.collect())
    assert abs(words(mixed) - 1.5 * words(single)) <= 0.02 * words(single)
    lengths = packed.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] == 4096 or r[1] & (r[1] - 1) == 0 for r in lengths) and have[5] == have[4]
    assert raw.count() == 200


def test_run_is_the_stages(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


ODD = [
    (None, "no id but a text of some words\nsecond line of it", "en", None, 1), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t", "en", "b", 3),
    (6, "the same row twice over\nwith a line more", "en", "a", 9), (6, "the same row twice over\nwith a line more", "en", "a", 9), (6, "one id with another text", "de", "b", 9), (7, "lang " * 30_000, "en", "a", 1),
    (8, "line of two documents\nown line of eight", "en", "b", 1), (9, "line of two documents\nown line of nine, which is longer", "en", "c", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [ODD, [], ODD[1:2]], ids=["odd", "empty", "null"])
def test_run_of_odd_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'k' as key", "1 as size", "'d' as drops", "map('a', 1) as stats")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0), (None, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, out = [spark.read.parquet(str(tmp_path / "documents.parquet"))], None
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.common.materialize(stage(spark, stages[-1], str(tmp_path)), "odd")
        stages.append(out)
    assert all(s.columns == docs.columns for s in stages[:-1])
    kept = {r["doc_id"] for r in stages[3].collect()}
    words = sum(len((r["text"] or "").split()) for r in stages[4].collect())
    ids = [r for r in out.collect()]
    assert {r["doc_id"] for r in ids} <= kept and sum(r["length"] for r in ids) >= words and len({(r["row"], r["start"]) for r in ids}) == len(ids)
    if not rows:
        assert not ids


def test_stages_leave_their_tables_to_the_next(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    earlier = set(storage._WRITTEN)
    lazy = corpus_pipeline.quality_filter(spark, docs, SF)  # not written: its tables must stay
    lined = corpus_pipeline.line_dedup_stage(spark, lazy, SF)
    written = corpus_pipeline.common.materialize(lined, "written")
    made = {p for p in set(storage._WRITTEN) - earlier if "occurrences" in p}
    corpus_pipeline.near_dedup(spark, written, SF).count()
    assert written.count() and made and not made & set(storage._WRITTEN)


def _cell(v):
    return round(v, 7) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert columns == sorted(names)
    assert sorted((tuple(_cell(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(_cell(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
