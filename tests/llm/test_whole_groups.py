"""Sharding divides only groups larger than a bin, and packs small bins."""

from helixframe.llm import sharding
from test_groups import check_shards


def test_groups_below_a_bin_stay_whole(spark):
    own = [(i, f"text {i} " * (20 + i % 9)) for i in range(1500)]
    total = sum(len(t) + 1 for _, t in own)
    docs = own + [(10_000 + i, "nine parts " * 10) for i in range(total // 10 // 111)]
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    sizes = check_shards(docs, got, 8)
    assert len({r["shard"] for r in got if r["doc_id"] >= 10_000}) == 1 and max(sizes) < 1.05 * min(sizes)
    docs = own + [(10_000 + i, "many parts " * 10) for i in range(total * 2 // 3 // 111)]  # 3.2 bins
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    sizes = check_shards(docs, got, 8)
    assert len({r["shard"] for r in got if r["doc_id"] >= 10_000}) <= 4 and max(sizes) < 1.05 * min(sizes)
    got = sharding.shard(spark.createDataFrame(own, "doc_id long, text string"), shards=None, capacity=total // 20, bundles=4).groupBy("shard").sum("size").collect()
    assert all(r["sum(size)"] <= total // 20 for r in got) and len(got) <= 22
