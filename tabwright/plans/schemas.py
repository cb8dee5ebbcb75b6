"""Column lists of the given tables, used to write the DuckDB oracle SQL
(the Spark side always reads schemas from the files themselves)."""

from __future__ import annotations

SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "integer"), ("r_name", "string")],
    "nation": [("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer")],
    "customer": [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
                 ("c_acctbal", "float"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "integer"), ("s_name", "string"), ("s_nationkey", "integer"), ("s_acctbal", "float")],
    "part": [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "integer"), ("p_retailprice", "float")],
    "orders": [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"),
               ("o_totalprice", "float"), ("o_orderdate", "temporal"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"),
                 ("l_linenumber", "integer"), ("l_quantity", "float"), ("l_extendedprice", "float"),
                 ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "temporal")],
    "events": [("event_id", "integer"), ("ts", "temporal"), ("user_id", "integer"), ("event_type", "string"),
               ("value", "float"), ("props", "string")],
    "documents": [("doc_id", "integer"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "integer")],
    "embeddings": [("vec_id", "integer"), ("embedding", "nested"), ("label", "integer")],
    "pages": [("page_id", "integer"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "integer"), ("text", "string")],
    "labels": [("doc_id", "integer"), ("quality", "integer"), ("toxic", "integer")],
    "conversations": [("conv_id", "integer"), ("turn", "integer"), ("role", "string"), ("text", "string")],
    "events_dirty": [("event_id", "integer"), ("user_id", "integer"), ("event_type", "string"), ("value", "float"),
                     ("sparse_col", "float"), ("const_col", "integer"), ("value_x2", "float"), ("target", "integer")],
}
