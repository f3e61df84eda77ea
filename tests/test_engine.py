"""Statements on small tables of a weather service, with the rows that the dialect's rules give."""

import json
import random
import re
import socket
import struct
import urllib.request

import pytest

from basaltql import server
from basaltql.errors import EngineError, SerializationError
from basaltql.session import Instance

STATIONS = (
    "create table station (code int primary key, place char(16), height float, opened date);"
    "insert into station values (501, 'Varnholt', 812.5, '1931-04-17'), (502, 'Isle of Quern', 3.25, '1968-11-02'),"
    " (507, 'Mellby', null, '2004-02-29'), (509, null, 140.0, null), (512, 'Torrevela', 3.25, '1999-12-31');"
)
READINGS = (
    "create table reading (station int, hour int, rain float, kind char(6));"
    "insert into reading values (501, 6, 0.5, 'auto'), (501, 12, 4.0, 'manual'), (501, 18, 4.0, 'auto'), (502, 6, null, 'auto'),"
    " (502, 12, 7.75, 'auto'), (512, 6, 1.25, 'manual'), (599, 6, 9.0, 'auto'), (null, 12, 2.0, null);"
)
BOTH = STATIONS + READINGS


@pytest.fixture
def s(spark, tmp_path):
    return Instance(spark, str(tmp_path)).session()


CASES = [
    # Arithmetic, logic and text.
    ("", "select 29 / 6, -29 / 6, -29 % 6, 29 / 4.0, null = null, 3 = 4 and null, 3 = 3 or null", [(4, -4, -5, 7.25, None, False, True)]),
    ("", "select -9 % -1, 9 % (2 - 3), 10.5 % 4", [(0, 0, 2.5)]),
    ("", "select length('naïveté'), upper('grün'), lower('ÉTÉ'), substring('barometer', 5, 3), substr('barometer', 30), concat(7, '/', 0.25, '/', 2 < 1)", [(7, "GRÜN", "été", "met", "", "7/0.25/false")]),
    ("", "select concat(3e21, ' ', 90210.0, ' ', 0.00004, ' ', -1e308 * 1e10, ' ', 1e308 * 1e10)", [("3000000000000000000000.0 90210.0 0.00004 -inf inf",)]),
    ("", "select '80_kmh' like '80~_%' escape '~', '80xkmh' like '80~_%' escape '~', 'gust' like '_us_', null like 'x', 'back\\\\slash' like '%\\\\s%'", [(True, False, True, None, True)]),
    ("", "select '80_kmh' like concat('80~_', '%') escape '~', '80xkmh' like concat('80~_', '%') escape '~', '~x' like concat('~~', '_') escape '~'", [(True, False, True)]),
    # Filters and order.
    (STATIONS, "select code from station where height <> 3.25", [(501,), (509,)]),
    (STATIONS, "select code from station where height is null or place is null order by code", [(507,), (509,)]),
    (STATIONS, "select code from station where opened >= '1968-11-02' and opened < '2004-02-29' order by opened desc", [(512,), (502,)]),
    (STATIONS, "select place from station order by place limit 3 offset 1", [("Isle of Quern",), ("Mellby",), ("Torrevela",)]),
    (STATIONS, "select place as p, height * 2 as twice from station where code in (502, 501, 77) order by twice, p", [("Isle of Quern", 6.5), ("Varnholt", 1625.0)]),
    (STATIONS, "select code from station where code not in (501, 502, null)", []),
    (STATIONS, "select distinct height from station order by code desc limit 2", [(3.25,), (140.0,)]),
    # Joins.
    (BOTH, "select s.place, r.hour from station s join reading r on s.code = r.station and r.rain > 3.5 order by s.place, r.hour", [("Isle of Quern", 12), ("Varnholt", 12), ("Varnholt", 18)]),
    (BOTH, "select s.code, r.rain from station s left join reading r on r.station = s.code and r.kind = 'manual' order by s.code", [(501, 4.0), (502, None), (507, None), (509, None), (512, 1.25)]),
    (BOTH, "select s.place, r.station, r.rain from station s right join reading r on r.station = s.code where r.rain > 1.5 and s.code is null order by r.rain", [(None, None, 2.0), (None, 599, 9.0)]),
    (BOTH, "select count(*) from station, reading", [(40,)]),
    (BOTH, "select a.code, b.code from station a, station b where a.height = b.height and a.code < b.code", [(502, 512)]),
    # Groups.
    (READINGS, "select count(*), count(rain), count(distinct rain), sum(rain), avg(hour), min(kind), max(hour) from reading", [(8, 7, 6, 28.5, 9.75, "auto", 18)]),
    (READINGS, "select kind, sum(rain) as total from reading group by kind having count(*) > 1 order by total desc", [("auto", 21.25), ("manual", 5.25)]),
    (READINGS, "select station, count(*) from reading group by station order by count(*) desc, station limit 2", [(501, 3), (502, 2)]),
    (READINGS, "select station, hour, sum(rain) from reading where station < 510 group by station order by station", [(501, 6, 8.5), (502, 6, 7.75)]),
    (READINGS, "select hour / 6 as part, max(rain) + 1 from reading group by hour / 6 order by part", [(1, 10.0), (2, 8.75), (3, 5.0)]),
    (READINGS, "select count(*), max(rain), avg(rain) from reading where hour > 23", [(0, None, None)]),
    # Sets.
    (BOTH, "select code as k from station union select station from reading order by k", [(None,), (501,), (502,), (507,), (509,), (512,), (599,)]),
    (BOTH, "select code from station where code > 508 union all select hour from reading where kind = 'manual'", [(509,), (512,), (12,), (6,)]),
    (BOTH, "select code from station where code = 512 union select rain from reading where rain > 7.0 order by code", [(7.75,), (9.0,), (512.0,)]),
    # Subqueries.
    (BOTH, "select code from station where code in (select station from reading where rain >= 4.0) order by code", [(501,), (502,)]),
    (BOTH, "select code from station where code not in (select station from reading)", []),
    (BOTH, "select code from station where code not in (select station from reading where station is not null) order by code", [(507,), (509,)]),
    (BOTH, "select code from station where height not in (select rain from reading where hour = 99) order by code", [(501,), (502,), (507,), (509,), (512,)]),
    (BOTH, "select place, (select sum(rain) from reading where station = code) from station where code < 507 order by code", [("Varnholt", 8.5), ("Isle of Quern", 7.75)]),
    (BOTH, "select code from station where not exists (select hour from reading where station = code) order by code", [(507,), (509,)]),
    (BOTH, "select code from station order by (select count(*) from reading where station = code) desc, code limit 3", [(501,), (502,), (512,)]),
    (BOTH, "select code, (select sum(hour + code) from reading where station = code) from station where code > 511", [(512, 518)]),
    (BOTH, "select code from station where exists (select hour from reading where station = code and rain = (select max(z.rain) from reading z where z.station = code and z.hour < 13)) order by code", [(501,), (502,), (512,)]),
    (BOTH, "select kind from reading group by kind having sum(rain) > (select max(height) / 100 from station) order by kind", [("auto",)]),
    (STATIONS + "create view low as select code, place from station where height < 200.0;", "select count(*), min(place) from low", [(3, "Isle of Quern")]),
    ("create table Gauge (n int); create table gauge (n int); insert into Gauge values (61);", "select n from Gauge", [(61,)]),
]


@pytest.mark.parametrize(("script", "query", "rows"), CASES)
def test_rows(s, script, query, rows):
    s.execute(script)
    got = s.execute(query).rows()
    assert (got if " order by " in query else sorted(got, key=repr)) == (rows if " order by " in query else sorted(rows, key=repr))


ERRORS = [
    ("", "select 12 % 0", "zero"),
    ("", "select 4611686018427387904 * 2", "overflow"),
    ("", "select (-9223372036854775807 - 1) % -1", "overflow"),
    ("", "select 'rain' > 3", "type mismatch"),
    ("", "select soundex('x')", "unknown function: soundex"),
    ("", "select length(12)", "type mismatch"),
    ("", "select substring('hail', -2)", "positive"),
    ("", "select 'a' like concat('a', '~') escape '~'", "ends with its escape"),
    ("", "select x from nowhere", "no such table: nowhere"),
    (STATIONS, "select depth from station", "no such column: depth"),
    (STATIONS, "select code from station where height", "boolean"),
    (STATIONS, "select place, max(height) from station", "must appear in group by"),
    (STATIONS, "select code from station where code = (select code from station)", "more than one row"),
    (STATIONS, "select code from station where code in (select code, place from station)", "single column"),
    (STATIONS, "select code from station union select code, place from station", "column count"),
    (STATIONS, "select code from station where opened = '1999-13-01'", "invalid date"),
    (STATIONS, "insert into station values (600, 'Nowhere')", "column count"),
    (STATIONS, "insert into station values (6.5, 'Nowhere', 1.0, null)", "cannot insert"),
    (STATIONS, "insert into station values (600, 'a place of far too many letters', 1.0, null)", "cannot insert"),
    (STATIONS, "insert into station values (600, 'Nowhere', 1.0, '2023-02-30')", "invalid date"),
    (STATIONS, "insert into station values (509, 'Again', 1.0, null)", "duplicate key: station(code)"),
    (STATIONS, "insert into station values (601, 'x', 1.0, null), (601, 'y', 1.0, null)", "duplicate key"),
    (STATIONS, "insert into station values (null, 'x', 1.0, null)", "cannot be null"),
    (STATIONS, "update station set code = 501 where code > 505", "duplicate key"),
    (STATIONS, "update station set place = 'a place of far too many letters'", "cannot insert"),
    (STATIONS, "create table station (n int)", "already exists"),
    (STATIONS, "drop view station", "no such view"),
    (BOTH, "select hour from station, reading, reading", "ambiguous"),
    ("begin", "create table late (n int)", "DDL inside a transaction"),
    ("begin", "begin", "already begun"),
]


@pytest.mark.parametrize(("script", "statement", "text"), ERRORS)
def test_errors(s, script, statement, text):
    s.execute(script)
    with pytest.raises(Exception, match="(?i)" + re.escape(text)) as e:
        r = s.execute(statement)
        if r.kind == "rows":
            r.rows()
    assert e.value is not None


def test_headers_and_metadata(s):
    s.execute("create table buoy (mark int primary key, name char(9) default 'none', drift float unique); create index by_name on buoy (name); create view named as select mark from buoy")
    assert s.execute("select mark - 4, max(drift) from buoy group by mark").frame.columns == ["(- mark 4)", "(max drift)"]
    assert s.execute("describe buoy").rows()[1] == ("name", "char(9)", "YES", "", "none", "")
    assert s.execute("show tables").rows() == [("buoy",), ("named",)]
    assert s.execute("explain select name from buoy where mark >= 5 and mark < 9").rows() == [("IndexScan(index=__buoy_mark_unique, table=buoy, where mark >= 5 and mark < 9) -> Filter -> Project",)]
    assert s.execute("explain select mark from buoy order by drift").rows() == [("OrderedIndexScan(index=__buoy_drift_unique, table=buoy) -> Filter -> Project",)]
    assert s.execute("explain select a.mark from buoy a, buoy b where a.mark < b.mark").rows() == [("NestedLoopJoin(tables=2) -> Filter -> Project",)]
    assert ("main", "buoy", "heap", "row") in s.execute("select * from information_schema.tables").rows()
    with pytest.raises(EngineError, match="constraint"):
        s.execute("drop index __buoy_mark_unique")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(s, spark):
    """NOT IN broadcasts nothing of unknown size; an equality spares a product of two blocks."""
    s.execute(BOTH)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(s.sql("select code from station where code not in (select station from reading)"))
        assert "LeftAnti" in text and "BroadcastExchange" not in text and "NestedLoop" not in text
        text = plan(s.sql("select code from station where exists (select hour from reading where station = code and rain = (select max(z.rain) from reading z where z.station = code))"))
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_inequality_in_a_subquery_is_no_product(s, spark):
    """An aggregate up to an outer value is sorted along, whatever block the equal column comes from."""
    s.execute(BOTH)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for text in (
            "select code from station where exists (select hour from reading r where station = code and rain = (select max(z.rain) from reading z where z.station = code and z.hour < r.hour))",
            "select hour, (select count(*) from station where code <= r.station) from reading r",
        ):
            text = plan(s.sql(text))
            assert "CartesianProduct" not in text and "NestedLoop" not in text and "Window" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def buoys(s):
    """Two tables of a few values and many ties and nulls: (tag, bay, since) and (bay, hour, height, code)."""
    r = random.Random(17)
    some = lambda n: r.choice([None, *range(n), *range(n)])
    buoys = [(i, some(3), some(9)) for i in range(40)]
    waves = [(some(3), some(9), r.choice([None, -2.5, 0.25, 8.0, 31.5]), some(50)) for _ in range(60)]
    rows = lambda t: ", ".join("(" + ", ".join("null" if v is None else str(v) for v in x) + ")" for x in t)
    s.execute(f"create table buoy (tag int primary key, bay int, since int); insert into buoy values {rows(buoys)}")
    s.execute(f"create table wave (bay int, hour int, height float, code int); insert into wave values {rows(waves)}")
    return buoys, waves


def alike(a, b):
    return None not in (a, b) and a == b


def test_aggregates_up_to_an_outer_value(s, buoys):
    """Every aggregate and comparison, either side first, with and without an equal column, against a loop over all pairs."""
    buoys, waves = buoys
    holds = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}

    def expected(met):
        v, c = [w[2] for w in met if w[2] is not None], [w[3] for w in met if w[3] is not None]
        return max(v, default=None), min(v, default=None), sum(v) if v else None, sum(v) / len(v) if v else None, sum(c) if c else None, len(c), len(met), len(set(v))

    for op, same, side in (("<", True, 0), ("<=", True, 1), (">", True, 1), (">=", True, 0), ("<", False, 1), (">=", False, 0)):
        tail = f"from wave w where {'w.bay = b.bay and ' if same else ''}{f'since {turned[op]} w.hour' if side else f'w.hour {op} since'} and w.hour <> 4"
        asked = ", ".join(f"(select {f} {tail})" for f in ("max(height)", "min(height)", "sum(height)", "avg(height)", "sum(code)", "count(code)", "count(*)", "count(distinct height)"))
        met = lambda bay, since: [w for w in waves if None not in (w[1], since) and holds[op](w[1], since) and w[1] != 4 and (alike(w[0], bay) or not same)]  # noqa: E731, B023
        assert s.execute(f"select tag, {asked} from buoy b order by tag").rows() == [(i, *expected(met(bay, since))) for i, bay, since in buoys], (op, same, side)


def test_aggregates_up_to_an_outer_value_in_other_places(s, buoys):
    """A value from two levels out, conditions on the outer rows, rows of an outer join, two inequalities, a wide sum."""
    buoys, waves = buoys
    before = lambda bay, hour: [w for w in waves if alike(w[0], bay) and None not in (w[1], hour) and w[1] < hour]
    top = lambda met: max((w[2] for w in met if w[2] is not None), default=None)
    got = s.execute("select tag from buoy where tag < 3 or exists (select hour from wave w where w.bay = buoy.bay and w.height = (select max(z.height) from wave z where z.bay = buoy.bay and z.hour < w.hour) and w.code > 20) order by tag").rows()
    assert got == [(i,) for i, bay, _ in buoys if i < 3 or any(alike(w[0], bay) and alike(w[2], top(before(bay, w[1]))) and (w[3] or 0) > 20 for w in waves)]
    assert 3 < len(got) < len(buoys)
    got = s.execute("select tag from buoy b where since > 2 and 6 > (select count(*) from wave w where w.bay = b.bay and w.hour < b.since) and tag < 30 order by tag").rows()
    assert got == [(i,) for i, bay, since in buoys if since is not None and since > 2 and i < 30 and len(before(bay, since)) < 6]
    got = s.execute("select b.tag, (select count(*) from wave z where z.bay = w.bay and z.hour < w.hour) as n from buoy b left join wave w on w.bay = b.bay and w.code = b.tag where w.height is null order by tag, n").rows()
    joined = [(i, w) for i, bay, _ in buoys for w in ([w for w in waves if alike(w[0], bay) and alike(w[3], i)] or [(None,) * 4])]
    assert got == sorted((i, len(before(w[0], w[1]))) for i, w in joined if w[2] is None)
    got = s.execute("select tag, (select max(w.height) from wave w where w.bay = b.bay and w.hour < b.since and w.code > b.tag) from buoy b order by tag").rows()
    assert got == [(i, top([w for w in before(bay, since) if w[3] is not None and w[3] > i])) for i, bay, since in buoys]
    # The sum in the order of hours passes the range of whole numbers; the one asked for does not.
    far = 2**62
    s.execute(f"create table mark (since int); create table tide (hour int, code int); insert into mark values (9), (1); insert into tide values (1, {far}), (2, {far}), (3, -{far}), (9, 7)")
    assert s.execute("select since, (select sum(code) from tide where hour < since) from mark order by since").rows() == [(1, None), (9, far)]


def test_changes_rewrite_only_touched_files(s, spark):
    s.execute("create table tide (n int primary key, level float default 0.5, note char(8))")
    assert s.execute("insert into tide (n, note) values (1, 'ebb'), (2, 'neap')").affected == 2
    s.execute("insert into tide values (3, 2.5, null)")
    first, second = s.db.manifest["tables"]["tide"]["folders"]
    assert s.execute("update tide set level = level + n, note = upper(concat(note, '!')) where n < 2").affected == 1
    assert second in s.db.manifest["tables"]["tide"]["folders"] and first not in s.db.manifest["tables"]["tide"]["folders"]
    assert s.execute("update tide set level = 9.0 where n in (select z.n from tide z where z.note = 'neap')").affected == 1
    assert s.execute("delete from tide where level = 2.5").affected == 1
    assert s.execute("delete from tide where n = 77").affected == 0
    again = Instance(spark, s.instance.root).session()
    assert again.execute("select * from tide order by n").rows() == [(1, 1.5, "EBB!"), (2, 9.0, "neap")]
    assert again.execute("vacuum").message == "VACUUM COMPLETE: 3 rows purged"
    assert again.execute("select n from tide order by n").rows() == [(1,), (2,)]


def test_small_inserts_are_merged(s):
    s.execute("create table drop_ (n int unique, t char(4))")
    for i in range(20):
        s.execute(f"insert into drop_ values ({i}, 'x')")
    assert len(s.db.manifest["tables"]["drop_"]["folders"]) <= 9
    assert s.execute("select count(*), sum(n) from drop_").rows() == [(20, 190)]
    with pytest.raises(EngineError, match="duplicate"):
        s.execute("insert into drop_ values (3, 'y')")


def test_two_instances_lose_nothing(s, spark):
    other = Instance(spark, s.instance.root).session()
    s.execute("create table log (who char(4), n int)")
    for i in range(4):
        s.execute(f"insert into log values ('one', {i})")
        other.execute(f"insert into log values ('two', {i})")
    rows = Instance(spark, s.instance.root).session().execute("select who, count(*), sum(n) from log group by who order by who").rows()
    assert rows == [("one", 4, 6), ("two", 4, 6)]
    s.isolation = other.isolation = "repeatable_read"
    s.execute("begin; update log set n = 50 where n = 0")
    other.execute("begin; update log set n = 60 where n = 0")
    other.execute("commit")
    with pytest.raises(SerializationError, match="could not serialize"):
        s.execute("commit")
    assert s.execute("select sum(n) from log").rows() == [(132,)]


def test_transactions(s):
    s.execute("create table tank (id int, litres int); insert into tank values (7, 300)")
    other = s.instance.session()
    s.execute("begin; update tank set litres = litres - 45")
    assert other.execute("select litres from tank").rows() == [(300,)]
    assert s.execute("select litres from tank").rows() == [(255,)]
    with pytest.raises(EngineError, match="schema is locked"):
        other.execute("drop table tank")
    s.execute("rollback")
    assert s.execute("select litres from tank").rows() == [(300,)]


def test_users(spark, tmp_path):
    s = Instance(spark, str(tmp_path), auth=True).session()
    with pytest.raises(EngineError, match="not logged in"):
        s.execute("show databases")
    s.execute("create user root identified by 'sesame'; login root 'sesame'; create table vane (n int); create database annex")
    s.execute("create user ida identified by 'i'; grant all on main to ida; grant read on annex to ida; revoke write on main from ida")
    u = s.instance.session()
    u.execute("login ida 'i'; select n from vane")
    with pytest.raises(EngineError, match="access denied"):
        u.execute("insert into vane values (1)")
    s.execute("revoke read on main from ida; drop database annex; create database annex")
    for statement in ("select n from vane", "use annex; show tables"):
        with pytest.raises(EngineError, match="access denied"):
            u.execute(statement)
    with pytest.raises(EngineError, match="authentication failed"):
        u.execute("login root 'open'")


def test_random_changes_against_a_model(s):
    """The same random script on the engine and on a dictionary."""
    s.execute("create table crate (tag int primary key, bay int, load int)")
    model, r = {}, random.Random(41)
    for _ in range(14):
        i, g, v = r.randrange(9), r.randrange(4), r.randrange(500)
        match r.randrange(3):
            case 0:
                try:
                    s.execute(f"insert into crate values ({i}, {g}, {v})")
                    assert i not in model
                    model[i] = (g, v)
                except EngineError:
                    assert i in model
            case 1:
                s.execute(f"update crate set load = load - {v}, bay = bay + 1 where bay = {g}")
                model = {k: (a + 1, b - v) if a == g else (a, b) for k, (a, b) in model.items()}
            case 2:
                s.execute(f"delete from crate where tag = {i}")
                model.pop(i, None)
    assert s.execute("select * from crate order by tag").rows() == [(k, *v) for k, v in sorted(model.items())]


def test_results_as_json_and_grid(s):
    r = s.execute("select 44 as depth, null as note, 1e308 * 10 as far")
    assert r.json() == {"type": "rows", "columns": ["depth", "note", "far"], "rows": [[44, None, None]]}
    assert r.grid().splitlines()[1:4:2] == ["| depth | note | far |", "| 44    | NULL | inf |"]
    assert s.trace("select [")["error"]


def test_servers(s):
    s.execute("create table sky (n int)")
    with server.running(server.serve_http(s.instance, port=0)) as h, server.running(server.serve_tcp(s.instance, port=0)) as t:
        base = f"http://127.0.0.1:{h.server_address[1]}"

        def post(text, name=None):
            request = urllib.request.Request(f"{base}/query", text.encode(), {"X-Session": name} if name else {})
            try:
                with urllib.request.urlopen(request) as f:
                    return json.load(f), f.headers.get("X-Session")
            except urllib.error.HTTPError as e:
                return json.load(e), None

        assert json.load(urllib.request.urlopen(f"{base}/health")) == {"status": "ok"}
        name = json.load(urllib.request.urlopen(f"{base}/session"))["session"]
        assert post("begin; insert into sky values (8)", name) == ({"results": [{"type": "message", "message": "BEGIN"}, {"type": "affected", "affected": 1}]}, name)
        assert post("select count(*) as c from sky")[0]["results"][0]["rows"] == [[0]]
        assert post("commit", name)[1] == name and post("commit", "made up")[1] is None
        assert post(json.dumps({"sql": "select n from sky where n = ?", "parameters": [8]}))[0]["results"][0]["rows"] == [[8]]
        assert "no such table" in post("select n from cloud")[0]["error"]
        with socket.create_connection(t.server_address) as link:
            text = b"select n + 1 as m from sky"
            link.sendall(struct.pack("<I", len(text)) + text)
            stream = link.makefile("rb")
            assert json.loads(stream.read(struct.unpack("<I", stream.read(4))[0]))["results"][0]["rows"] == [[9]]


def test_sessions_are_bounded(s):
    known = server.Sessions(s.instance, limit=3, idle=1000)
    names = [known.claim(None)[0] for _ in range(5)]
    assert len(known.known) == 3 and names[-1] in known.known and names[0] not in known.known
