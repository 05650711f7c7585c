"""Schemas of the driver's test tables, which the registered queries read."""

from __future__ import annotations

from pyspark.sql import types as T

from larder.schemas import I, S, _schema

L, DB, NTZ = T.LongType(), T.DoubleType(), T.TimestampNTZType()
TESTDATA = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", DB), ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", DB)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                    ("p_retailprice", DB)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", DB),
                      ("o_orderdate", NTZ), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                        ("l_quantity", DB), ("l_extendedprice", DB), ("l_discount", DB), ("l_tax", DB),
                        ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", NTZ)),
    "events": _schema(("event_id", L), ("ts", NTZ), ("user_id", L), ("event_type", S), ("value", DB),
                      ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
}
