import pytest

from tessera.operators import rankers

CORPUS = [(1, "Install the package, then restart"), (2, "請先設置訪問權限"), (3, "unrelated"), (4, None), (5, "install install package")]


@pytest.mark.parametrize("name", sorted(rankers.RANKERS))
def test_rankings(spark, name):
    corpus = spark.createDataFrame(CORPUS, "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "install package"), (2, "访问权限"), (3, "mars colony")], "query_id long, text string")
    got = {}
    for r in rankers.RANKERS[name](queries, corpus).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got[1] == [5, 1] and 3 not in got
    assert (2 in got) == (name != "keyword") and got.get(2, [2]) == [2]  # only the fields know the other script
