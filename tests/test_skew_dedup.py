from pyspark.sql import functions as F

from shelfmark.operators import dedup
from shelfmark.operators.skew import Busy, busy_keys, lookup_join


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def skewed(spark, n=30_000):
    third = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    return spark.range(n).select(third.alias("k"), (F.col("id") % 2).alias("half"), "id")


def test_sketch_finds_the_busy_key_and_the_nulls(spark):
    one, two, unique = busy_keys(skewed(spark), ["k"], ["k", "half"], ["id"], at_least=2_000)
    assert [item for item, _ in one.splits] == ["hot"] and one.splits[0][1] > 1 and one.null_splits > 1
    assert {item for item, _ in two.splits} == {"hot\x1f0", "hot\x1f1"}
    assert unique == Busy()
    assert busy_keys(skewed(spark), ["k"])[0] == Busy()


def test_salted_join_is_the_plain_join(spark):
    facts = skewed(spark)
    lookup = spark.range(400).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.col("id").alias("v"))
    [busy] = busy_keys(facts, ["k"], at_least=2_000)
    for how in ("left", "inner", "left_semi"):
        assert rows(lookup_join(facts, lookup, ["k"], ["id"], busy, how)) == rows(facts.join(lookup, "k", how))


def test_a_busy_key_is_spread(spark):
    facts = skewed(spark)
    lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
    # no broadcast and no run-time splitting: what is left is the salt
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = lookup_join(facts, lookup, ["k"], ["id"], Busy((("hot", 64),), 64))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def hits(spark):
    data = [
        (2, 1, 0, "o/r", "a", "h1", "u1"), (1, 2, 0, "o/r", "a", "h1", "u1"), (1, 1, 5, "o/r", "b", None, "u2"), (3, 1, 0, "o/r", "b", "", "u2"),
        (1, 1, 6, "o/r", "c", "h3", None), (1, 1, 7, "", "d", "h4", "u4"),
    ]
    return spark.createDataFrame(data, "query_idx int, page int, pos int, repo_full_name string, skill_path string, html_url string, api_url string")


def test_first_seen_does_not_depend_on_partitions(spark):
    valid = hits(spark).filter(dedup.has_required_fields())
    assert valid.count() == 4
    for n in (1, 2, 5):
        firsts = dedup.first_seen(valid.repartition(n)).orderBy("hit_key").collect()
        assert [(r["hit_key"], r["query_idx"], r["page"], r["pos"], r["n_seen"]) for r in firsts] == [("h1", 1, 2, 0, 2), ("o/r/b", 1, 1, 5, 2)]
        marked = dedup.mark_first_seen(valid.repartition(n))
        assert {(r["query_idx"], r["page"], r["pos"]) for r in marked.filter("is_first").collect()} == {(1, 2, 0), (1, 1, 5)}


def test_pages_after_a_bad_one_are_not_read(spark):
    pages = [(1, 1, 3, 200), (1, 2, 0, 200), (1, 3, 3, 200), (2, 1, 3, 200), (2, 2, 3, 503), (2, 3, 3, 200), (3, 1, 1, 200)]
    df = spark.createDataFrame(pages, "query_idx int, page int, n_items int, status_code int")
    assert sorted((r[0], r[1]) for r in dedup.readable_pages(df).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_last_wins_keeps_the_first_time(spark):
    data = [("k", 2, "two", 20), ("k", 1, "one", 10), ("k", 3, "three", 30), ("m", 1, None, 7)]
    for n in (1, 4):
        df = spark.createDataFrame(data, "key string, seq int, v string, first_found_at int").repartition(n)
        assert rows(dedup.last_wins(df, ["key"], ["seq"])) == [(10, "k", 3, "three"), (7, "m", 1, None)]
