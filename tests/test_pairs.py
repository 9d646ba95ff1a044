"""Co-purchase pairs with hot-basket splitting (functions.pairs)."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from marketlens.functions.pairs import chunked_basket, pair_counts
from marketlens.operators import insight


def _brute(rows):
    baskets: dict = {}
    for g, i in rows:
        if g is not None and i is not None:
            baskets.setdefault(g, set()).add(i)
    c = Counter()
    for items in baskets.values():
        for a, b in combinations(sorted(items), 2):
            c[(a, b)] += 1
    return dict(c)


def _fixture():
    # one basket holds a third of all rows; duplicates and NULLs included
    rows = [("hot", f"p{i:03d}") for i in range(120)]
    rows += [(f"o{k}", f"p{(k * 7 + j) % 150:03d}") for k in range(60) for j in range(k % 5)]
    rows += [("hot", "p001"), ("o3", None), (None, "p002"), ("o9", "p010"), ("o9", "p010")]
    return rows


def test_pairs_match_brute_force_with_split(spark):
    rows = _fixture()
    df = spark.createDataFrame(rows, "g string, i string")
    for chunk in (1, 7, 16, 1000):
        got = {(r.a, r.b): r.n for r in pair_counts(df, "g", "i", "a", "b", "n", chunk=chunk).collect()}
        assert got == _brute(rows), chunk


def test_hot_basket_is_spread_over_many_keys(spark):
    df = spark.createDataFrame(_fixture(), "g string, i string")
    cb = chunked_basket(df, "g", "i", chunk=16)
    hot = cb.where(F.col("g") == "hot")
    assert hot.select("__m").distinct().collect()[0][0] == 8           # ceil(120 / 16)
    assert hot.select("__ch").distinct().count() > 1
    assert cb.where(F.col("g") != "hot").agg(F.max("__m")).collect()[0][0] == 1


def test_cross_sell_split_equals_unsplit(tables):
    whole = insight.cross_sell_product_pairs(tables)
    split = insight.cross_sell_product_pairs(tables, chunk=2)
    assert whole.count() > 0
    assert whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0


def test_pair_join_is_keyed_by_chunk_pair(tables):
    plan = insight.cross_sell_product_pairs(tables)._jdf.queryExecution().optimizedPlan().toString()
    join = [ln for ln in plan.splitlines() if "Join Inner" in ln and "__lo" in ln]
    assert join and "__hi" in join[0] and "order_id" in join[0]
