"""Searches with few and many queries give the same, by broadcast or in cells."""

import math
import random

from folioforge.operators import search


def test_many_queries(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(90)] + [(90, [0.0] * 6), (91, None), (92, [math.nan] + [1.0] * 5), (93, None), (94, [1.0, 2.0])]
    rows += [(200 + k, list(rows[k][1])) for k in range(5)]  # ties
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.where("id < 40 OR id > 88").withColumnRenamed("id", "q")
    queries = queries.union(queries.limit(5))  # repeated

    def plain():
        unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows if v and all(map(math.isfinite, v)) and any(v)}
        out = []
        for q in unit:
            if q < 40 or q > 88:
                best = sorted((-sum(a * b for a, b in zip(unit[q], u, strict=True)), i) for i, u in unit.items() if len(u) == len(unit[q]))[:4]
                out += [(q, i, n, round(-s, 9)) for n, (s, i) in enumerate(best, 1)]
        return sorted(out)

    def got(**more):
        return sorted((r.query_id, r.id, r.rank, round(r.similarity, 9)) for r in search.top_matches(queries, vectors, id_col="id", vector_col="v", k=4, query_id="q", **more).collect())

    want = plain()
    few = got()
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 7)
    many = search.top_matches(queries, vectors, id_col="id", vector_col="v", k=4, query_id="q", cells=3)
    assert "CartesianProduct" not in many._jdf.queryExecution().executedPlan().toString() and "BroadcastNestedLoop" not in many._jdf.queryExecution().executedPlan().toString()
    near = lambda rows: [(q, n, s) for q, _, n, s in rows]  # noqa: E731  equal similarities may change places in the last digit
    assert near(few) == near(want) and near(got(cells=3)) == near(want)
    assert search.top_matches(queries.limit(0), vectors, id_col="id", vector_col="v", k=4, query_id="q").count() == 0
