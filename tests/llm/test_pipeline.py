"""The registered queries against their SQL, and the pipeline stage by stage."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from veilwork.llm import decontam, mixing, quality, simhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from check_sql import rows_of  # noqa: E402


@pytest.mark.parametrize("name", ["op1_host_quality", "op2_decontamination", "op7_chat_prefixes"])
def test_same_rows(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_all_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        steps[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = steps[name][1]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = steps["quality_rules"]
    assert ids(after) == ids(quality.judge(before).where("kept"))
    before, after = steps["near_duplicates"]
    groups = simhash.near_duplicates(before)
    assert ids(after) == sorted(r["component_id"] for r in groups.select("component_id").distinct().collect())
    before, after = steps["decontamination"]
    assert ids(after) == ids(decontam.decontaminate(before, spark.read.parquet(f"{folder}/benchmark.parquet")).where("NOT contaminated"))
    before, after = steps["source_mix"]
    taken = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix_sources(before).collect()}
    assert Counter(ids(after)) == Counter({k: n for k, n in taken.items() if n})
    before, after = steps["sharding"]
    assert ids(before) == ids(after) and after.columns == [*before.columns, "shard", "slot"]
    assert all(s[1].columns == s[0].columns for n, s in steps.items() if n != "sharding")
    assert corpus_pipeline.run(spark, folder).count() == after.count()
