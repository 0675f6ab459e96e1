"""Running sums over blocks against plain Python."""

import random

from quillwave.functions.prefix import sum_before


def test_hot_key_over_many_blocks(spark):
    r = random.Random(2)
    rows = [("hot", s, r.randrange(100)) for s in r.sample(range(10**9), 900)] + [(f"k{i % 7}", i, None if i % 5 == 0 else i) for i in range(40)] + [(None, 3, 4), (None, 1, 2)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long").selectExpr("*", "v AS block", "k AS of")
    got = sum_before(df, "k", "at", "v", "before", blocks=8)
    assert got.columns == ["k", "at", "v", "block", "of", "before"]
    want, total = {}, {}
    for k, at, v in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        want[k, at] = total.get(k, 0)
        total[k] = total.get(k, 0) + (v or 0)
    assert {(x.k, x.at): x.before for x in got.collect()} == want and got.count() == len(rows)
    blocks = df.repartitionByRange(8, "k", "at").selectExpr("k", "spark_partition_id() AS b").filter("k = 'hot'").distinct().count()
    assert blocks > 4  # the key is many tasks
    assert sum_before(df.limit(0), "k", "at", "v", "before").count() == 0
