"""What keeps memory and shuffles small: no broadcast of exploded rows, no text through a join that does not need it."""

import numpy as np
from pyspark.sql import functions as F

from gazetta import models
from gazetta.functions import money
from gazetta.operators import graphs, joins, overlaps


def test_topic_links_broadcast_nothing(spark):
    rows = spark.createDataFrame([(i, [f"t{i % 7}", f"u{i % 3}", "v"]) for i in range(50)], "id long, topics array<string>")
    plan = overlaps.topic_links(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_articles_without_bodies_join_no_texts(spark, tmp_path):
    spark.createDataFrame([(1, None)], "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "Title\ntext", "src0", 10)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = models.articles(spark, str(tmp_path)).select("id", "title", "topics")
    node = rows._jdf.queryExecution().optimizedPlan()
    while "Join" not in node.nodeName():
        node = node.children().apply(0)
    assert "text#" not in node.children().apply(0).output().toString()


def test_a_total_is_read_once(spark):
    rows = spark.createDataFrame([(1, "Totaling $5M: $1M and $2M")], "id int, text string")
    found = rows.where(money.total_mismatch(F.col("text"))).select("id")
    assert [r["id"] for r in found.collect()] == [1]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?i)(totaling") == 1


def test_the_best_of_equal_sets_meets_each_other_one(spark):
    rows = [(1, 3, "x", ["a", "b", "c"]), (2, 1, "x", ["c", "b", "a"]), (3, 2, "x", ["a", "b", "c", "a"]), (4, 4, "y", ["a", "b", "c"]), (5, 5, "x", ["a", "b"]), (6, 6, "x", ["a", "b"])]
    found = joins.same_topics(spark.createDataFrame(rows, "id long, rank long, scope string, topics array<string>"), "rank", 3, scope="scope")
    assert sorted(tuple(r) for r in found.collect()) == [(2, 1), (2, 3)]


def test_vectors_of_floats_stay_floats_and_meet_tile_by_tile(spark):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "vec_id long, embedding array<float>")
    one, tiled = (graphs.similar_pairs(rows, 0.4, tile=n) for n in (2048, 5))
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in tiled.collect()) and one.count() > 0
    assert "as double" not in tiled._jdf.queryExecution().optimizedPlan().toString()
