import os
import time

from pyspark.sql import functions as F

import corpus_pipeline as cp
from rollcall.llm import host_rules as hr
from rollcall.llm import pfair_mix, suffix_pieces, weak_toxicity
from rollcall.llm.runtime import CLEANUP, written

from .data import SCHEMA, with_clashes
from .test_host_rules import brute as judged
from .test_host_rules import verdicts
from .test_jaccard_join import brute as linked
from .test_jaccard_join import near_copies
from .test_weak_toxicity import corpus


def test_stages(spark, tmp_path):
    data, labels = corpus(240)
    data = [(d, t, lang, "ab"[d % 2], n) for d, t, lang, _, n in data] + near_copies()[:40] + [(9000, None, "en", "a", None), (9001, "", None, None, 0), (9002, "too short", "en", "b", 9)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, kept[-1], str(tmp_path)), name)
        assert out.columns == columns, name
        kept.append(out)
    rows = [[tuple(r) for r in x.collect()] for x in kept]
    ids = [{r[0] for r in x} for x in rows]
    bad = verdicts(data, hr.MAX_RATE)
    assert ids[1] == {d for d, t, _, s, _ in data if not judged(t)[1] and not bad[s]}
    model = weak_toxicity.fit(kept[1], weak_toxicity.read_labels(spark, str(tmp_path)))
    scores = {r["doc_id"]: r["score"] for r in weak_toxicity.with_scores(kept[1], model).collect()}
    assert ids[2] == {d for d, s in scores.items() if s < weak_toxicity.THRESHOLD}
    truth = dict(labels)
    assert len([d for d in ids[2] if truth.get(d)]) < 0.2 * len([d for d in ids[1] if truth.get(d)])
    assert ids[3] == {d for d, _, c, _ in linked(rows[2], 5, 80, 100) if c == d}
    assert len(ids[3] & set(range(1000, 1060))) < len(ids[2] & set(range(1000, 1060)))
    assert sorted(rows[4]) == sorted(rows[3])
    last = cp.STAGES[-1][1](spark, kept[-1], str(tmp_path)).orderBy("mix_file", "mix_row").collect()
    library = suffix_pieces.piece_model().library
    text = {r[0]: r[1] for r in rows[4]}
    assert {r["doc_id"]: r["ids"] for r in last} == {d: library.encode(t) for d, t in text.items()}
    slot = {r["doc_id"]: (r["slot"], r["nth"]) for r in pfair_mix.mix(kept[3]).collect()}
    assert [r["doc_id"] for r in last] == sorted(slot, key=slot.get)
    assert cp.encode_pieces(spark, spark.createDataFrame(rows[4][:3], SCHEMA), "").count() == 3


def test_run(spark, tmp_path):
    data, labels = corpus(60)
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 20


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_columns_that_clash(spark, tmp_path):
    """More columns, of names that stages or Spark itself use, change nothing and are carried along."""
    data, labels = corpus(60)
    names = ("_metadata", "Slot", "__row", "kept", "score", "component_id", "a.b")
    for folder, more in (("plain", ()), ("clash", names)):
        with_clashes(spark.createDataFrame(data, SCHEMA), *more).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/clash/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, f"{tmp_path}/clash"), name)
        assert {*names} <= {*docs.columns}
    got = [cp.run(spark, f"{tmp_path}/{folder}").collect() for folder in ("plain", "clash")]
    assert sorted((r["doc_id"], r["ids"]) for r in got[0]) == sorted((r["doc_id"], r["ids"]) for r in got[1])
    assert all(r["mix_file"] is not None and r["mix_row"] is not None for r in got[1])


def test_what_was_shuffled_goes_with_its_query(spark):
    """Shuffle files of intermediate tables don't wait for the driver to collect its garbage."""
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, mode = files(), spark.conf.get(CLEANUP)
    rows = written(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 1000).alias("k")).count(), "shuffled")
    assert rows.count() == 1000 and spark.conf.get(CLEANUP) == mode
    rows = written(rows.repartition(3, "k"), "again")
    end = time.time() + 10
    # those of the count above are Spark's to remove
    while len(files() - before) > 8 and time.time() < end:
        time.sleep(0.2)
    assert len(files() - before) <= 8
    assert sorted(r["k"] for r in rows.collect()) == list(range(1000))
