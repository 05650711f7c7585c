"""Deletes through the key graph, against deleting key by key."""

import random
from decimal import Decimal as D

import pytest

from larder.operators.deletes import CASCADES, child_first, correct_customers, delete_closure
from larder.operators.quality import REFERENCES


def test_order_of_tables():
    order = child_first(REFERENCES)
    for child, edges in REFERENCES.items():
        assert all(order.index(child) < order.index(parent) for parent in edges.values())
    # What goes with orders and recipes refers to ingredients.
    assert max(order.index("orders"), order.index("recipes")) < order.index("ingredients")
    with pytest.raises(ValueError, match="circle"):
        child_first({"a": {"b_id": "b"}, "b": {"a_id": "a"}}, set())


def fold(rows, asked, references, cascades):
    """rows: {table: {id: {fk: id}}} -> outcomes, deleting one key after the other, child tables first."""
    out = {}
    for t in child_first(references, cascades):
        verdicts = {}
        for k in sorted({k for a, k in asked if a == t}):
            if k not in rows[t]:
                verdicts[k] = ("missing", 0, 0, set())
                continue
            goes = [(t, k)]
            for g, gid in goes:
                goes += [(c, i) for c, edges in references.items() for fk, p in edges.items() if p == g and (c, fk) in cascades
                         for i, r in rows[c].items() if r.get(fk) == gid]
            holds = sum(r.get(fk) == gid and (c, i) not in goes for g, gid in goes for c, edges in references.items()
                        for fk, p in edges.items() if p == g and (c, fk) not in cascades for i, r in rows[c].items())
            verdicts[k] = ("blocked" if holds else "deleted", len(goes) - 1, holds, set() if holds else set(goes))
        for k, (what, cascaded, holds, goes) in verdicts.items():
            out[t, str(k)] = (what, cascaded, holds)
            for c, i in goes:
                rows[c].pop(i, None)
    return out


@pytest.mark.parametrize("deep", [False, True])
def test_equal_to_deleting_key_by_key(spark, deep):
    """Also where cascades go two levels deep."""
    rng = random.Random(deep)
    references = {k: dict(v) for k, v in REFERENCES.items()}
    cascades = set(CASCADES)
    if deep:
        references["parts"] = {"line_id": "order_lines", "ingredient_id": "ingredients"}
        cascades.add(("parts", "line_id"))
    names = child_first(references, cascades)
    rows = {t: {} for t in names}
    for t in reversed(names):
        for i in range(8 if t not in references else 30):
            rows[t][i] = {fk: rng.choice([*list(rows[p])[:20], None]) for fk, p in references.get(t, {}).items()}
    asked = [(t, rng.randrange(36)) for t in names for _ in range(9)] * 2
    frames = {t: spark.createDataFrame([(i, *r.values()) for i, r in rows[t].items()],
                                       ", ".join(["id long", *(f"{fk} long" for fk in references.get(t, {}))])) for t in names}
    found = delete_closure(frames, spark.createDataFrame([(t, str(k)) for t, k in asked] + [("orders", None)], "table_name string, id string"),
                           references, cascades)
    want = fold(rows, asked, references, cascades)
    assert {(r["table_name"], r["id"]): (r["outcome"], r["n_cascaded"], r["n_blocking"]) for r in found.outcome.collect()} == want
    assert {v[0] for v in want.values()} == {"deleted", "blocked", "missing"}
    for t in names:
        assert sorted(r["id"] for r in found.tables[t].collect()) == sorted(rows[t]), t
    again = delete_closure(frames, spark.createDataFrame([], "table_name string, id string"), references, cascades)
    assert again.outcome.count() == 0 and again.tables["orders"].count() == frames["orders"].count()


def test_customers_after_deletes(spark):
    customers = spark.createDataFrame([("a", 3, D("50.00")), ("b", 1, D("5.00")), ("c", 2, None), ("d", None, D("1.00"))],
                                      "id string, total_orders int, total_spent decimal(12,2)")
    gone = spark.createDataFrame([("a", D("20.00")), ("a", None), ("b", D("9.00")), ("c", D("1.00")), (None, D("1.00"))],
                                 "customer_id string, selling_price decimal(12,2)")
    got = {r["id"]: (r["total_orders"], r["total_spent"]) for r in correct_customers(customers, gone).collect()}
    assert got == {"a": (1, D("30.00")), "b": (0, D("0.00")), "c": (1, D("0.00")), "d": (None, D("1.00"))}


def test_what_is_left_of_a_table_reads_it_once(spark, tmp_path):
    """The keys that went are known by then: they are not looked for again in the tables they came from."""
    frames = {"orders": spark.range(9).selectExpr("id", "id % 2 as customer_id"), "order_lines": spark.range(20).selectExpr("id % 10 as order_id")}
    for name, rows in frames.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    stored = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in frames}
    found = delete_closure(stored, stored["orders"].where("id < 4").selectExpr("'orders' as table_name", "cast(id as string) as id"))
    for name, left in (("orders", 5), ("order_lines", 12)):
        assert found.tables[name]._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1, name
        assert found.tables[name].count() == left
