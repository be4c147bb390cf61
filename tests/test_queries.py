"""Every registered query against its SQL; those without SQL must run and keep their schema."""

import pytest

from quillgraph.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck, same):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.SQL:
        same(df, catalog.SQL[name], duck)
    else:
        assert df.count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_components_over_all_edges(spark, sf_dir, duck):
    from quillgraph.plans.registry import with_views

    root = {i: i for (i,) in duck.sql(with_views("SELECT id FROM issues")).fetchall()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in duck.sql(with_views("SELECT issue_id, depends_on_id FROM deps")).fetchall():
        if a in root and b in root:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = catalog.QUERIES["G14_components_all_edges"](spark, sf_dir).collect()
    assert len(got) == len(root) and {r["id"]: r["component"] for r in got} == {i: find(i) for i in root}


def test_chunks_with_context_gives_every_chunk(spark, sf_dir):
    got = catalog.QUERIES["W15_chunks_with_context"](spark, sf_dir).select("id").collect()
    assert len(got) == len(set(got)) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
