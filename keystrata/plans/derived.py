"""The store's relations, derived from the driver's tables by SQL that both Spark and DuckDB run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table

EDGES = """
select concat('r', n_regionkey) as parent, concat('n', n_nationkey) as child, false as leaf from {nation}
union all select concat('n', c_nationkey), concat('c', c_custkey), false from {customer}
union all select concat('c', o_custkey), concat('o', o_orderkey), false from {orders}
union all select concat('o', l_orderkey), concat('p', l_partkey), true from {lineitem}
union all select concat('o', l_orderkey), concat('s', l_suppkey), true from {lineitem}
"""
INDEX = """
select cast(l_orderkey % 32 as bigint) as seg_id, concat('p', l_partkey) as "key", l_orderkey * 8 + l_linenumber as off,
       cast(l_quantity as bigint) * 10 + l_linenumber as slen, l_shipdate as sealed_at from {lineitem}
"""
LIVE = """select concat('p', p_partkey) as "key" from {part} where p_size > 20"""
REFS = """select concat('ref-', lower(r_name)) as name, concat('r', r_regionkey) as "key" from {region}"""
PRESENT = """
select concat('r', r_regionkey) as "key" from {region} union all select concat('n', n_nationkey) from {nation}
union all select concat('c', c_custkey) from {customer} where c_acctbal > -900 union all select concat('o', o_orderkey) from {orders}
union all select concat('p', p_partkey) from {part} where p_size <> 13 union all select concat('s', s_suppkey) from {supplier}
"""
ASKED = """select l.doc_id as pos, concat('d', l.doc_id * 3) as "key" from {labels} l union all select item_id * 2, concat('d', item_id) from {benchmark}"""
STORED = """select concat('d', doc_id) as "key", doc_id % 7 as seg_id, doc_id as off, n_chars as slen from {documents} where doc_id in (select doc_id from {labels})"""
ENTRIES = """select concat(source, '/', lang) as dir, source as top, concat('f', lpad(cast(doc_id as varchar(20)), 9, '0')) as name, doc_id, n_chars as size from {documents}"""
UPDATES = """select concat('conv-', conv_id) as name, turn as pos, concat(role, '-', turn) as "key", role as "user", conv_id * 1000 + turn as created_at_ns from {conversations}"""


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the relations above as a DataFrame."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql.replace('"', "`"), **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    """The relation's SQL for DuckDB, in parentheses."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"
