"""One query for each operator of the dialect, over the driver's tables, and its DuckDB equivalent."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltql.errors import EngineError
from basaltql.session import Instance

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")
_DATES = {"orders": "o_orderdate", "lineitem": "l_shipdate"}


def engine(spark: SparkSession, sf_dir: str, text: str | None = None) -> Instance:
    """An instance with the tables that the text names, or all; its root is in the cluster's shared folder or the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    out = Instance(spark, f"{shared.rstrip('/')}/basaltql-{uuid.uuid4().hex}" if shared else None)
    for name in TABLES:
        if text is not None and not re.search(rf"\b{name}\b", text):
            continue
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in _DATES:
            df = df.withColumn(_DATES[name], F.col(_DATES[name]).cast("date"))
        out.register(name, df)
    return out


_B = "CAST({} AS BIGINT)".format
#: name: (the dialect's text, DuckDB's; None: the same text)
TEXTS: dict[str, tuple[str, str | None]] = {
    "scan_project": ("select n_nationkey, n_name from nation", None),
    "star": ("select * from region", None),
    "const_select": ("select 1+2*3 as a, 'x' as b", "SELECT CAST(7 AS BIGINT) AS a, 'x' AS b"),
    "filter_and_or_not": ("select o_orderkey, o_totalprice from orders where (o_orderstatus = 'F' and o_totalprice > 100000.0) or not (o_orderstatus <> 'P')", None),
    "int_div_mod": ("select l_orderkey, l_linenumber, l_orderkey / 7 as q, l_orderkey % 7 as r from lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, l_orderkey % 7 AS r FROM lineitem"),
    "arith_float": ("select l_orderkey, l_extendedprice * (1.0 - l_discount) as net from lineitem", "SELECT l_orderkey, l_extendedprice * (1.0::DOUBLE - l_discount) AS net FROM lineitem"),
    "is_null": ("select d.doc_id as doc_id from documents d left join labels l on d.doc_id = l.doc_id where l.quality is null", None),
    "is_not_null": ("select d.doc_id as doc_id, l.quality as quality from documents d left join labels l on d.doc_id = l.doc_id where l.quality is not null", None),
    "in_list": ("select p_partkey from part where p_size in (1, 5, 9)", None),
    "not_in_list": ("select p_partkey from part where p_size not in (1, 5, 9) and p_size in (2, 3, null)", None),
    "like": ("select p_partkey, p_name from part where p_name like '%ring%'", None),
    "not_like": ("select p_partkey from part where p_name not like '%e%'", None),
    "like_escape": ("select c_custkey from customer where c_name like 'Customer!#%1' escape '!'", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%1'"),
    "fn_concat": ("select n_nationkey, concat(n_name, '-', n_nationkey) as s from nation", "SELECT n_nationkey, n_name || '-' || n_nationkey AS s FROM nation"),
    "fn_concat_null": ("select d.doc_id as doc_id, concat(d.lang, l.quality) as s from documents d left join labels l on d.doc_id = l.doc_id", "SELECT d.doc_id, d.lang || CAST(l.quality AS VARCHAR) AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "fn_upper": ("select p_partkey, upper(p_name) as s from part", None),
    "fn_lower": ("select p_partkey, lower(p_brand) as s from part", None),
    "fn_length": ("select p_partkey, length(p_name) as n from part", None),
    "fn_substring": ("select p_partkey, substring(p_name, 2, 4) as s, substr(p_name, 3) as t from part", None),
    "join_inner": ("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey", None),
    "join_comma": ("select s_suppkey, r_name from supplier, nation, region where s_nationkey = n_nationkey and n_regionkey = r_regionkey", None),
    "join_left": ("select d.doc_id as doc_id, l.toxic as toxic from documents d left join labels l on d.doc_id = l.doc_id", None),
    "join_right": ("select l.toxic as toxic, d.doc_id as doc_id from labels l right join documents d on d.doc_id = l.doc_id", None),
    "join_theta": ("select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_acctbal < b.s_acctbal and a.s_nationkey = b.s_nationkey", None),
    "join_residual": ("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey and l_quantity > 45.0", None),
    "join_3way": ("select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name", None),
    "join_mixed": ("select n.n_name as n_name, s.s_suppkey as s_suppkey from region r, nation n left join supplier s on s.s_nationkey = n.n_nationkey and s.s_acctbal > 5000.0 where n.n_regionkey = r.r_regionkey", None),
    "join_cross": ("select n_name, r_name from nation, region", None),
    "join_nested_loop": ("select a.s_suppkey as a, b.n_nationkey as b from supplier a join nation b on a.s_suppkey < b.n_nationkey", None),
    "join_self_chain": ("select a.n_name as x, b.n_name as y, c.r_name as z from nation a join nation b on a.n_regionkey = b.n_regionkey left join region c on b.n_regionkey = c.r_regionkey and c.r_name <> 'ASIA'", None),
    "agg_distinct_all": ("select count(distinct p_size) as n, sum(distinct p_size) as s, avg(distinct p_size) as a, min(distinct p_size) as lo, max(distinct p_size) as hi from part", f"SELECT count(DISTINCT p_size) AS n, {_B('sum(DISTINCT p_size)')} AS s, avg(DISTINCT p_size) AS a, min(p_size) AS lo, max(p_size) AS hi FROM part"),
    "exp_unary": ("select n_nationkey, -n_regionkey as m, +n_nationkey as p, -(-3) as q from nation", "SELECT n_nationkey, -n_regionkey AS m, n_nationkey AS p, CAST(3 AS BIGINT) AS q FROM nation"),
    "exp_literals": ("select 1 as a, 2.5 as b, 1e3 as c, 'it''s' as d", "SELECT CAST(1 AS BIGINT) AS a, 2.5::DOUBLE AS b, 1000.0::DOUBLE AS c, 'it''s' AS d"),
    "exp_kleene": ("select d.doc_id as doc_id, l.toxic = 1 or d.doc_id % 2 = 0 as a, l.toxic = 1 and d.doc_id % 2 = 0 as b, not l.toxic = 1 as c from documents d left join labels l on d.doc_id = l.doc_id", None),
    "exp_remainder": ("select n_nationkey, (0 - n_nationkey) % 7 as a, n_nationkey % -1 as b, 7.5 % 2.0 as c from nation", "SELECT n_nationkey, (0 - n_nationkey) % 7 AS a, CAST(0 AS BIGINT) AS b, 1.5::DOUBLE AS c FROM nation"),
    "like_computed": ("select r_name from region where r_name like concat('A', '%', 'A') escape '!'", "SELECT r_name FROM region WHERE r_name LIKE 'A%A'"),
    "fn_concat_float": ("select concat(1e308 * 10.0, '|', 2.5, '|', 1e20) as s from region where r_regionkey = 0", "SELECT 'inf|2.5|100000000000000000000.0' AS s"),
    "order_constant": ("select distinct r_regionkey from region order by 1", "SELECT r_regionkey FROM region"),
    "order_correlated": ("select n_name, n_nationkey from nation order by (select count(*) from supplier where s_nationkey = n_nationkey) desc, n_name limit 7", "SELECT n_name, n_nationkey FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey ORDER BY coalesce(n, 0) DESC, n_name LIMIT 7"),
    "union_widened": ("select n_nationkey as k from nation union select s_acctbal from supplier", "SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation UNION SELECT s_acctbal FROM supplier"),
    "sub_union_limit": ("select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 0 union select n_nationkey from nation where n_regionkey = 2 order by n_nationkey limit 4)", None),
    "sub_outer_in_aggregate": ("select n_nationkey, (select sum(s_suppkey + n_nationkey) from supplier where s_nationkey = n_nationkey) as s from nation", f"SELECT n_nationkey, (SELECT {_B('sum(s_suppkey + n_nationkey)')} FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation"),
    "not_in_nulls": ("select n_nationkey from nation where n_nationkey not in (select l.quality from documents d left join labels l on d.doc_id = l.doc_id)", None),
    "not_in_empty": ("select n_nationkey from nation where n_nationkey not in (select r_regionkey from region where r_regionkey < 0)", None),
    "text_length": ("select doc_id, length(text) as n from documents", None),
    "scan_lineitem": ("select l_orderkey, l_linenumber, l_extendedprice from lineitem", None),
    "sort_lineitem": ("select l_orderkey, l_linenumber, l_quantity from lineitem order by l_extendedprice, l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"),
    "not_in_lineitem": ("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 30.0)", None),
    "agg_global": ("select count(*) as n, count(l_quantity) as m, sum(l_linenumber) as s, min(l_shipdate) as lo, max(l_extendedprice) as hi, avg(l_linenumber) as mean from lineitem", f"SELECT count(*) AS n, count(l_quantity) AS m, {_B('sum(l_linenumber)')} AS s, CAST(min(l_shipdate) AS DATE) AS lo, max(l_extendedprice) AS hi, avg(l_linenumber) AS mean FROM lineitem"),
    "agg_distinct": ("select count(distinct l_suppkey) as n, sum(distinct l_linenumber) as s from lineitem", f"SELECT count(DISTINCT l_suppkey) AS n, {_B('sum(DISTINCT l_linenumber)')} AS s FROM lineitem"),
    "agg_expr": ("select sum(o_orderkey) + 1 as s, upper(min(o_orderpriority)) as p from orders", f"SELECT {_B('sum(o_orderkey) + 1')} AS s, upper(min(o_orderpriority)) AS p FROM orders"),
    "agg_empty": ("select count(*) as n, sum(o_orderkey) as s, avg(o_totalprice) as a from orders where o_orderkey < 0", f"SELECT count(*) AS n, {_B('sum(o_orderkey)')} AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0"),
    "group_by": ("select l_returnflag, l_linestatus, count(*) as n, sum(l_linenumber) as s from lineitem where l_quantity > 10.0 group by l_returnflag, l_linestatus", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_B('sum(l_linenumber)')} AS s FROM lineitem WHERE l_quantity > 10.0 GROUP BY l_returnflag, l_linestatus"),
    "group_by_expr": ("select l_orderkey % 10 as k, count(*) as n from lineitem group by l_orderkey % 10", "SELECT l_orderkey % 10 AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey % 10"),
    "group_by_null": ("select l.quality as quality, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by l.quality", None),
    "group_having": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", None),
    "group_loose": ("select n_regionkey, r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by n_regionkey", "SELECT n_regionkey, any_value(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"),
    "group_order": ("select o_custkey, sum(o_orderkey) as s from orders group by o_custkey order by s desc, o_custkey limit 20", f"SELECT o_custkey, {_B('sum(o_orderkey)')} AS s FROM orders GROUP BY o_custkey ORDER BY s DESC, o_custkey LIMIT 20"),
    "order_limit": ("select o_orderkey, o_totalprice from orders order by o_orderkey limit 25", None),
    "order_offset": ("select o_orderkey from orders order by o_orderkey limit 10 offset 100", None),
    "topk_desc": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 30", None),
    "order_alias": ("select o_orderkey as k, o_custkey from orders order by k desc limit 15", None),
    "order_nulls": ("select d.doc_id as doc_id, l.quality as quality from documents d left join labels l on d.doc_id = l.doc_id order by l.quality, d.doc_id limit 40", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id LIMIT 40"),
    "distinct": ("select distinct l_returnflag, l_linestatus from lineitem", None),
    "distinct_expr": ("select distinct p_size % 5 as k from part", "SELECT DISTINCT CAST(p_size % 5 AS BIGINT) AS k FROM part"),
    "distinct_hidden_order": ("select distinct n_regionkey from nation order by n_nationkey limit 3", "SELECT n_regionkey FROM nation GROUP BY n_regionkey ORDER BY min(n_nationkey) LIMIT 3"),
    "union": ("select n_regionkey as k from nation union select r_regionkey from region", None),
    "union_all": ("select n_regionkey as k from nation union all select r_regionkey from region", None),
    "union_mixed": ("select n_regionkey as k from nation union select r_regionkey from region union all select r_regionkey from region", None),
    "union_order": ("select n_name as k from nation union select r_name from region order by k limit 12", None),
    "scalar_sub": ("select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)", None),
    "in_sub": ("select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)", None),
    "not_in_sub": ("select d.doc_id as doc_id from documents d where d.doc_id not in (select l.doc_id from labels l where l.toxic = 0)", None),
    "exists": ("select c_custkey from customer where exists (select o_orderkey from orders where o_custkey = c_custkey and o_totalprice > 400000.0)", None),
    "not_exists": ("select d.doc_id as doc_id from documents d where not exists (select l.doc_id from labels l where l.doc_id = d.doc_id)", None),
    "corr_scalar_project": ("select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'P') as n from customer", None),
    "corr_scalar_where": ("select o_orderkey from orders o where o_totalprice > (select 1.5 * avg(p.o_totalprice) from orders p where p.o_custkey = o.o_custkey)", None),
    "corr_two_level": ("select n_name from nation where exists (select c_custkey from customer where c_nationkey = n_nationkey and c_acctbal = (select max(s_acctbal) from supplier where s_nationkey = n_nationkey and s_suppkey < c_custkey)) or n_regionkey in (select r_regionkey from region where r_regionkey = (select min(s_nationkey) from supplier where s_nationkey = n_nationkey))", None),
    "having_subquery": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > (select avg(l_linenumber) * 3.0 from lineitem)", None),
    "date_cmp": ("select o_orderkey, o_orderdate from orders where o_orderdate >= '1997-01-01' and '1997-07-01' > o_orderdate", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND DATE '1997-07-01' > o_orderdate"),
    "point_select": ("select * from customer where c_custkey = 77", None),
    "range_scan": ("select o_orderkey, o_custkey from orders where o_orderkey >= 1000 and o_orderkey < 1100", None),
}


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = engine(spark, sf_dir).session()
    s.execute("create view big as select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 200000.0")
    return s.sql("select o_custkey, count(*) as n from big group by o_custkey")


def _view_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = engine(spark, sf_dir).session()
    s.execute("create view local as select n_nationkey as k, n_name as name, r_name as region from nation join region on n_regionkey = r_regionkey")
    return s.sql("select c.c_custkey as c_custkey, v.name as name, v.region as region from customer c join local v on c.c_nationkey = v.k where v.region = 'ASIA'")


def _dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = engine(spark, sf_dir).session()
    s.execute(
        "create table t (id int primary key, name char(10), score float default 1.5);"
        "insert into t values (1, 'alice', 95.5), (2, 'bob', 80), (3, 'carol', 90);"
        "insert into t (id, name) values (4, 'dave');"
        "update t set score = score + 10, name = upper(name) where id <= 2;"
        "delete from t where id = 3"
    )
    return s.sql("select id, name, score from t")


def _information_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = engine(spark, sf_dir).session()
    s.execute("create table t (id int primary key, name char(8))")
    return s.sql("select table_name, column_name, data_type, primary_key from information_schema.columns")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "orders").session().sql("select o_orderkey, o_totalprice from orders where o_orderstatus = ? and o_totalprice > ?", ["F", 300000.0])


def _script(script: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query after a script on tables of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = engine(spark, sf_dir, script + query).session()
        s.execute(script)
        return s.sql(query)

    return run


def _refused(script: str, statement: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query after a statement that must fail and leave no trace."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = engine(spark, sf_dir, "").session()
        s.execute(script)
        try:
            s.execute(statement)
        except EngineError:
            return s.sql(query)
        raise EngineError(f"not refused: {statement}")

    return run


def _two_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instances on one root commit in turn; a third reads what both did."""
    one = engine(spark, sf_dir, "")
    a, b = one.session(), Instance(spark, one.root).session()
    a.execute("create table ledger (entry int primary key, amount int); insert into ledger values (1, 10)")
    b.execute("insert into ledger values (2, 20)")
    a.execute("insert into ledger values (3, 30); update ledger set amount = amount + 1 where entry = 2")
    return Instance(spark, one.root).session().sql("select entry, amount from ledger")


def _grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revoked part of ALL is gone, the others stay: what each statement of a user with write only gives."""
    first = engine(spark, sf_dir, "")
    i = Instance(spark, first.root, auth=True)
    s = i.session()
    s.execute("create user root identified by 'r'; login root 'r'; create table box (n int); create user eva identified by 'e'; grant all on main to eva; revoke read on main from eva")
    u, rows = i.session(), []
    u.execute("login eva 'e'")
    for k, text in enumerate(("insert into box values (5)", "select n from box", "create user x identified by 'x'")):
        try:
            u.execute(text)
            rows.append((k, "done"))
        except EngineError:
            rows.append((k, "refused"))
    return spark.createDataFrame(rows, "step bigint, outcome string")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text grid, the JSON envelope, a headless column's name and the parse trace, a row each."""
    s = engine(spark, sf_dir, "region").session()
    r = s.execute("select r_regionkey * 2, r_name from region where r_regionkey = 1")
    rows = [("grid", r.grid().splitlines()[3]), ("json", json.dumps(r.json()["rows"])), ("header", r.frame.columns[0]), ("trace", str(len(s.trace("select 1 + 1")["tokens"])))]
    return spark.createDataFrame(rows, "what string, value string")


_CELLAR = "create table cellar (bin int primary key, label char(12), litres float default 0.5); insert into cellar (bin, label) values (11, 'quince'); insert into cellar values (12, 'plum', 2), (13, null, 4.5);"
MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "view_query": (_view, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000.0 GROUP BY o_custkey"),
    "view_join": (_view_join, "SELECT c_custkey, n_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "dml_roundtrip": (_dml, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'ALICE', 105.5::DOUBLE), (2, 'BOB', 90.0), (4, 'dave', 1.5)) t(id, name, score)"),
    "info_schema_columns": (_information_schema, "SELECT * FROM (VALUES ('t', 'id', 'int', CAST(1 AS BIGINT)), ('t', 'name', 'char(8)', 0)) t(table_name, column_name, data_type, primary_key)"),
    "drop_table": (_script("create table a1 (x int); create table a2 (x int); drop table a1", "show tables"), "SELECT * FROM (VALUES ('a2')) t(\"table\")"),
    "show_tables_views": (_script(_CELLAR + "create view big as select bin from cellar where litres > 1.0", "show tables"), "SELECT * FROM (VALUES ('big'), ('cellar')) t(\"table\")"),
    "show_databases": (_script("create database annex", "show databases"), "SELECT * FROM (VALUES ('annex'), ('main')) t(\"database\")"),
    "use_database": (_script("create database annex; use annex; create table only_here (x int); insert into only_here values (4)", "select x from only_here"), "SELECT CAST(4 AS BIGINT) AS x"),
    "describe": (_script(_CELLAR, "describe cellar"), "SELECT * FROM (VALUES ('bin', 'int', 'NO', 'PRI', NULL, ''), ('label', 'char(12)', 'YES', '', NULL, ''), ('litres', 'float', 'YES', '', '0.5', '')) t(field, type, \"null\", \"key\", \"default\", extra)"),
    "explain": (_script(_CELLAR + "create index by_label on cellar (label)", "explain select bin from cellar where label = 'plum'"), "SELECT 'IndexScan(index=by_label, table=cellar, where label = ''plum'') -> Filter -> Project' AS plan"),
    "create_index_used": (_script(_CELLAR + "create index by_label on cellar (label); update cellar set litres = 9.0 where bin = 12; drop index by_label", "select bin, litres from cellar where label = 'plum'"), "SELECT CAST(12 AS BIGINT) AS bin, 9.0::DOUBLE AS litres"),
    "info_schema_schemata": (_script("create database annex", "select schema_name from information_schema.schemata"), "SELECT * FROM (VALUES ('annex'), ('main')) t(schema_name)"),
    "info_schema_tables": (_script(_CELLAR + "create table logs (x int) engine = lsm", "select table_name, engine, page_layout from information_schema.tables"), "SELECT * FROM (VALUES ('cellar', 'heap', 'row'), ('logs', 'lsm', 'row')) t(table_name, engine, page_layout)"),
    "unique_refused": (_refused(_CELLAR, "insert into cellar values (14, 'fig', 1), (11, 'pear', 1)", "select bin, label, litres from cellar"), "SELECT * FROM (VALUES (CAST(11 AS BIGINT), 'quince', 0.5::DOUBLE), (12, 'plum', 2.0), (13, NULL, 4.5)) t(bin, label, litres)"),
    "commit": (_script(_CELLAR + "begin; update cellar set litres = litres * 2.0; delete from cellar where bin = 12; commit", "select bin, litres from cellar"), "SELECT * FROM (VALUES (CAST(11 AS BIGINT), 1.0::DOUBLE), (13, 9.0)) t(bin, litres)"),
    "rollback": (_script(_CELLAR + "begin; update cellar set litres = litres * 2.0; delete from cellar where bin = 12; rollback", "select bin, litres from cellar"), "SELECT * FROM (VALUES (CAST(11 AS BIGINT), 0.5::DOUBLE), (12, 2.0), (13, 4.5)) t(bin, litres)"),
    "vacuum_merges": (_script(_CELLAR + "delete from cellar where bin = 13; vacuum; checkpoint", "select bin, label from cellar"), "SELECT * FROM (VALUES (CAST(11 AS BIGINT), 'quince'), (12, 'plum')) t(bin, label)"),
    "two_instances": (_two_instances, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(10 AS BIGINT)), (2, 21), (3, 30)) t(entry, amount)"),
    "grants": (_grants, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'done'), (1, 'refused'), (2, 'done')) t(step, outcome)"),
    "results_as_text": (_grid, "SELECT * FROM (VALUES ('grid', '| 2                 | AMERICA |'), ('json', '[[2, \"AMERICA\"]]'), ('header', '(* r_regionkey 2)'), ('trace', '5')) t(what, value)"),
    "prepared": (_prepared, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000.0"),
}


def _text_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, text).session().sql(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _text_query(t) for k, (t, _) in TEXTS.items()} | {k: f for k, (f, _) in MORE.items()}
SQL: dict[str, str] = {k: o or t for k, (t, o) in TEXTS.items()} | {k: o for k, (_, o) in MORE.items()}
