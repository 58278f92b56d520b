"""Queries over whole tables, against brute force."""

from collections import defaultdict

import __spark_entry__ as entry


def test_components_of_all_edges(spark, tmp_path):
    # Parts 1 and 2 are not divisible by 7; part 1 joins suppliers 1 and 2, supplier 3 has part 2 only.
    rows = [(1, 7), (1, 1), (2, 1), (2, 14), (3, 2), (4, 21), (4, 21)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = defaultdict(set)
    for s, p in rows:
        near[2 * s + 1].add(2 * p)
        near[2 * p].add(2 * s + 1)
    want = {}
    for v in sorted(near):
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = v
                todo += near[x]
    got = entry.queries()["gas_connected_components"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 9 and {r.id: r.component for r in got} == want
