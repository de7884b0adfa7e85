import pytest
from pyspark.sql import functions as F

from kestrelbase.functions.rules import Rule, validate
from kestrelbase.operators import mutate
from kestrelbase.operators.aggregates import Agg
from kestrelbase.plans import api, expressions as ex
from kestrelbase.plans.query import Query
from kestrelbase.sources.catalog import Catalog


@pytest.fixture(scope="module")
def products(spark):
    rows = [(f"p{i:02d}", f"Item no {i:02d}", "tools" if i % 2 else "books", 10.0 * i, 5 * i) for i in range(1, 21)]
    return spark.createDataFrame(rows, "_id string, name string, category string, price double, stock long")


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1, 3, "a"), (2, None, None), (3, 7, "b")], "id int, x int, t string")


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def test_filter_sort_limit(products):
    got = Query(products).where("category").eq("tools").where("price").gte(50.0).order_by("price", True).limit(3).all().collect()
    assert [r["_id"] for r in got] == ["p19", "p17", "p15"]


def test_count_and_first(products):
    assert Query(products).where("category").eq("books").count().first()["count"] == 10
    assert Query(products).where("price").gt(1e9).first().count() == 0
    assert Query(products).order_by("_id").offset(15).limit(10).count().first()["count"] == 5
    assert Query(products).offset(99).all().count() == 0


def test_group_sums_are_not_inflated(products):
    got = {r["category"]: r for r in Query(products).group_by("category").agg(Agg("count", alias="n"), Agg("sum", "price"), Agg("avg", "price"), Agg("min", "price"), Agg("max", "price")).all().collect()}
    assert tuple(got["books"])[1:] == (10, 1100.0, 110.0, 20.0, 200.0)
    assert tuple(got["tools"])[1:] == (10, 1000.0, 100.0, 10.0, 190.0)


def test_aggregate_over_nothing_has_no_row(products):
    assert Query(products).where("price").lt(0).agg(Agg("count", alias="n")).all().count() == 0


def test_average_modes(gaps):
    assert Query(gaps).agg(Agg("avg", "x")).all().first()[0] == pytest.approx(10 / 3)
    assert Query(gaps).agg(Agg("avg", "x"), mode="values").all().first()[0] == 5.0
    assert Query(gaps).agg(Agg("sum", "t")).all().first()[0] == 0.0


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        (ex.eq("x", 3), [1]), (ex.eq("x", None), [2]), (ex.ne("x", 3), [2, 3]), (ex.ne("x", None), [1, 3]), (ex.gt("x", 3), [3]), (ex.gte("x", 3), [1, 3]), (ex.lt("x", 7), [1]), (ex.lte("x", 7), [1, 3]),
        (ex.between("x", 3, 7), [1, 3]), (ex.in_("x", 3, None), [1, 2]), (ex.not_in("x", 3), [2, 3]), (~ex.gt("x", 3), [1, 2]), (~ex.ne("x", 3), [1]), (ex.Or(), []), (ex.And(), [1, 2, 3]),
        (ex.gt("x", 3) | ex.eq("t", "a"), [1, 3]), (~(ex.gt("x", 3) | ex.eq("t", "a")), [2]), (ex.contains("t", "a"), [1]), (ex.starts_with("t", "b"), [3]), (ex.ends_with("t", "b"), [3]), (ex.equal_fold("t", "A"), [1]),
        (ex.exists("t"), [1, 3]), (ex.missing("t"), [2]), (~ex.exists("t"), [2]), (ex.eq("x", 3.0), [1]), (ex.eq("x", "3"), []), (ex.ne("x", "3"), [1, 2, 3]), (ex.eq("nowhere", 1), []), (ex.ne("nowhere", 1), [1, 2, 3]), (ex.missing("nowhere"), [1, 2, 3]),
    ],
)
def test_truth_table(gaps, expr, want):
    assert ids(gaps.filter(ex.compile_expr(expr, gaps.schema))) == want


def test_comparison_needs_a_value(gaps):
    with pytest.raises(ValueError):
        ex.compile_expr(ex.gt("x", None), gaps.schema)
    with pytest.raises(ValueError):
        ex.from_json([{"field": "x", "op": "like", "value": 1}])


def test_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, tags array<string>")
    for expr, want in ((ex.array_contains("tags", "a"), [1]), (ex.array_any("tags", "b", "z"), [1]), (ex.array_all("tags", "a", "z"), []), (ex.array_size("tags", 0), [2])):
        assert ids(df.filter(ex.compile_expr(expr, df.schema))) == want


def test_pushdown_and_top_k(spark):
    q = Query(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "orders").where("o_totalprice").gt(5.0).where("o_orderpriority").starts_with("1").order_by("o_totalprice", True).limit(3)
    plan = q.explain()
    assert plan.startswith("Limit(3, offset=0) -> Sort -> Filter -> CollectionScan(orders)")
    assert "GreaterThan(o_totalprice" in plan and "StringStartsWith(o_orderpriority" in plan and "TakeOrderedAndProject" in plan and "Python" not in plan


def test_updates(spark):
    df = spark.createDataFrame([("u1", 25, ["go"]), ("u2", None, None)], "_id string, age int, tags array<string>")
    got = {r[0]: r for r in mutate.push(mutate.increment(df, "age", 1), "tags", "x").collect()}
    assert got["u1"][1:] == (26, ["go", "x"]) and got["u2"][1:] == (1, ["x"])
    assert mutate.pop(df, "tags").first()["tags"] == [] and mutate.add_to_set(df, "tags", "go").first()["tags"] == ["go"]
    assert mutate.remove(df, "tags", "go").first()["tags"] == [] and "age" not in mutate.unset(df, "age").columns
    assert mutate.increment(spark.createDataFrame([(1.5,)], "v double"), "v", 1).first()[0] == 2.5


def test_writes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "_id string, v int")
    assert sorted(map(tuple, mutate.upsert(df, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, mutate.replace(df, new).collect())) == [("a", 1), ("b", 9)]
    assert mutate.insert(df, spark.createDataFrame([(None, 5)], "_id string, v int")).filter("_id is null").count() == 0
    assert mutate.unique_violations(df.union(df), ["_id"]).count() == 2 and mutate.unique_violations(df, ["_id"]).count() == 0


def test_schema_rules(spark):
    df = spark.createDataFrame([("Al", 5, 1.0), (None, 5, 2.0), ("bo", 200, 3.0), ("Cy", 0, None)], "name string, age int, w double")
    good, bad = validate(df, {"name": Rule(required=True, type="string", pattern="^[A-Z]"), "age": Rule(type="float", min=0, max=150), "w": Rule(type="int"), "x": Rule()})
    assert [r[0] for r in bad.select("violation").collect()] == ["w: not a int", "name: required", "name: pattern"] and good.count() == 1


def test_catalog_and_api(spark, products, tmp_path):
    c = Catalog(spark)
    c.register("collection", "products", products)
    got = api.documents(c, {"collection": "products", "filters": [{"field": "price", "op": "lt", "value": 50.0}], "order_by": "price", "order_desc": True, "limit": 2, "select": ["_id"]}).collect()
    assert [r[0] for r in got] == ["p04", "p03"]
    assert api.text_search(c, {"collection": "products", "query": "item 07"}).first()["_id"] == "p07"
    c.backup(str(tmp_path))
    again = Catalog(spark)
    again.restore(str(tmp_path), [("collection", "products")])
    assert again.get("collection", "products").count() == 20 and again.names("collection") == ["products"]
    assert spark.sql("select count(*) from products").first()[0] == 20
    with pytest.raises(KeyError):
        c.get("queue", "none")
    assert c.query("products").where(ex.gt("stock", 90)).all().filter(F.col("stock") > 90).count() == 2
