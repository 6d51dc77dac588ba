import pytest

from vecloom.plans.where import apply_where, translate


@pytest.fixture(scope="module")
def rows(spark):
    data = [(100 + i, i, i % 2 == 0, ["rust", "vector"] if i % 2 == 0 else ["python"], f"2026-04-0{i + 1}", f"it's {i}") for i in range(5)]
    return spark.createDataFrame(data, "id long, `order` long, active boolean, tags array<string>, created_at string, `a.b` string")


CASES = [
    ('"order" >= 2 AND "order" < 4', {102, 103}), ('"active" = true', {100, 102, 104}), ("\"tags\" CONTAINS 'rust'", {100, 102, 104}), ("\"created_at\" >= '2026-04-03' AND \"created_at\" <= '2026-04-04'", {102, 103}),
    ('"order" IN (1, 2)', {101, 102}), ('"order" = 1 OR "order" = 2', {101, 102}), ('"created_at" in ("2026-04-01", "2026-04-02")', {100, 101}), ("`a.b` = 'it''s 3'", {103}), ('`a.b` = "it\'s 3"', {103}),
    ("(id = 100 OR id = 101) AND NOT active", {101}), ("tags = null", set()), ("id != null", {100, 101, 102, 103, 104}), ("created_at LIKE '%-03' or id between 103 and 104", {102, 103, 104}), ("tags contains \"python\" and id == 101", {101}),
    ("length(created_at) = 10 and id % 2 = 1", {101, 103}), ("a.b = 'it''s 0'", {100}),
]


@pytest.mark.parametrize("text, want", CASES)
def test_filters(rows, text, want):
    assert {r.id for r in apply_where(rows, text).collect()} == want


@pytest.mark.parametrize("bad", [123, "", "(a = 1", "a = 1)", "a = ;", "CONTAINS 'x'"])
def test_errors(bad):
    with pytest.raises(ValueError):
        translate(bad)


def test_unknown_field(rows):
    with pytest.raises(ValueError):
        apply_where(rows, "nope = 1")


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 as label").write.parquet(str(tmp_path / "t"))
    plan = apply_where(spark.read.parquet(str(tmp_path / "t")), '"label" = 1')._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,1)" in plan
