"""From the syntax tree to Spark SQL: names, static types and the dialect's rules; Catalyst plans the rest.

Every source gets a unique alias and positional column names, so Spark never sees the user's names (which are
case sensitive here).  A subquery may use columns of any enclosing block; Spark resolves one level, so a block
between passes on what inner blocks need as columns of its own (see Block.reference).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from basaltql import functions
from basaltql.errors import EngineError
from basaltql.plans.syntax import Aggregate, Apply, Like, Literal, Name, Select, Subquery, Union, header

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
MISMATCH = "type mismatch in expression"
#: Comparisons, and each with its sides exchanged.
_TURNED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass
class Relation:
    """A table or view: names and types of its columns, and its rows under positional names c0, c1, ..."""

    columns: list[tuple[str, str]]
    frame: DataFrame
    #: The position of a column that numbers rows in the order of insertion, if there is one.
    row_id: int | None = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    return {"string": "str", "date": "date", "boolean": "bool", "void": "null"}.get(t.typeName(), "other")


def relation(df: DataFrame, row_id: str | None = None) -> Relation:
    names = [(f.name, kind_of(f.dataType)) for f in df.schema]
    place = next((i for i, (n, _) in enumerate(names) if n == row_id), None)
    return Relation(names, df.toDF(*(f"c{i}" for i in range(len(names)))), place)


def check_date(text: str) -> None:
    import datetime

    try:
        if not _DATE.fullmatch(text):
            raise ValueError
        datetime.date.fromisoformat(text)
    except ValueError:
        raise EngineError(f"invalid date: {text}") from None


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(e: Literal) -> tuple[str, str]:
    match e.kind:
        case "null":
            return "NULL", "null"
        case "int":
            return ("(-9223372036854775807L - 1L)" if e.value == -(1 << 63) else f"{e.value}L"), "int"
        case "float":
            return f"{e.value!r}D", "float"
        case _:
            return quote(e.value), "str"


@dataclass
class Entry:
    alias: str  # the user's
    sql: str  # ours
    relation: Relation


@dataclass
class Block:
    """The names that one SELECT block sees."""

    compiler: Compiler
    parent: Block | None = None
    entries: list[Entry] = field(default_factory=list)
    #: Columns of blocks further out that inner blocks need: their SQL out there, and the name here.
    passed: dict[str, str] = field(default_factory=dict)
    wrapped: str | None = None
    in_from: bool = False
    #: Columns of enclosing blocks that WHERE sets equal to a column of this block: (block, source, place) to that column.
    equal: dict[tuple[int, str, int], tuple[Entry, int]] = field(default_factory=dict)
    #: WHERE, as soon as FROM is compiled.
    where: Any = None
    #: Whether the block uses a column of an enclosing one.
    correlated: bool = False

    def find(self, n: Name) -> tuple[Entry, int] | None:
        found = [(e, i) for e in self.entries if n.owner in (None, e.alias) for i, (c, _) in enumerate(e.relation.columns) if c == n.column and i != e.relation.row_id]
        if len(found) > 1:
            raise EngineError(f"ambiguous column: {n.column}")
        return found[0] if found else None

    def own(self, e: Entry, i: int) -> str:
        if self.wrapped and not self.in_from:
            return f"{self.wrapped}.{e.sql}_c{i}"
        return f"{e.sql}.c{i}"

    def resolve(self, n: Name, carried: bool = False) -> tuple[str, str, bool]:
        """(SQL, type, whether the column is this block's own); carried: a column further out is to become one of this block's rows."""
        if hit := self.find(n):
            return self.own(*hit), hit[0].relation.columns[hit[1]][1], True
        if found := self.outer(n):
            block, hit = found
            inner = self
            while inner is not block:
                inner.correlated, inner = True, inner.parent
            return (self.hand_on if carried else self.reference)(block, hit), hit[0].relation.columns[hit[1]][1], False
        raise EngineError(f"no such column: {header(n)}")

    def outer(self, n: Name) -> tuple[Block, tuple[Entry, int]] | None:
        """The nearest enclosing block that has the column, and its place there."""
        block = self.parent
        while block:
            if hit := block.find(n):
                return block, hit
            block = block.parent
        return None

    def note_equalities(self, where: Any) -> None:
        """Where WHERE sets a column equal to one further out, inner blocks may use the former for the latter."""
        self.where = where
        for e in conjuncts(where):
            if isinstance(e, Apply) and e.op == "=" and all(isinstance(a, Name) for a in e.args):
                for mine, other in (e.args, e.args[::-1]):
                    if (hit := self.find(mine)) and not self.find(other) and (far := self.outer(other)):
                        block, place = far
                        if hit[0].relation.columns[hit[1]][1] == place[0].relation.columns[place[1]][1]:
                            self.equal.setdefault((id(block), place[0].sql, place[1]), hit)

    def reference(self, owner: Block, hit: tuple[Entry, int]) -> str:
        """SQL by which this block reaches a column of an enclosing block."""
        if self.parent is owner:
            return owner.own(*hit)
        return self.parent.hand_on(owner, hit)

    def hand_on(self, owner: Block, hit: tuple[Entry, int]) -> str:
        if same := self.equal.get((id(owner), hit[0].sql, hit[1])):
            return self.own(*same)
        if self.in_from:
            raise EngineError("not supported: a subquery in ON that refers to a block beyond the enclosing one")
        sql = self.reference(owner, hit)
        name = self.passed.setdefault(sql, f"p{len(self.passed)}")
        return f"{self.wrapped or 'unwrapped'}.{name}"


@dataclass
class Context:
    """Where an expression stands: how aggregates and ungrouped columns are treated there."""

    block: Block
    grouped: bool = False
    keys: dict[str, str] = field(default_factory=dict)
    loose: bool = False
    in_aggregate: bool = False
    allow_aggregates: bool = False


@dataclass
class Query:
    sql: str
    columns: list[tuple[str, str]]
    correlated: bool = False


class Compiler:
    def __init__(self, spark: SparkSession, lookup: Callable[[str], Relation]):
        self.spark, self.lookup, self.frames, self.n = spark, lookup, {}, 0

    def again(self) -> Compiler:
        """A compiler of the same tables for another statement."""
        return Compiler(self.spark, self.lookup)

    def fresh(self, prefix: str) -> str:
        self.n += 1
        return f"{prefix}{self.n}"

    # Expressions.
    def expr(self, e: Any, c: Context) -> tuple[str, str]:
        if c.grouped and c.keys and not c.in_aggregate and not isinstance(e, Literal) and not _holds(e, (Aggregate, Subquery)):
            text = self.expr(e, Context(c.block))
            if text[0] in c.keys:
                return c.keys[text[0]], text[1]
        match e:
            case Literal():
                return literal(e)
            case Name():
                sql, kind, own = c.block.resolve(e, c.in_aggregate)  # Spark's aggregates don't mix rows of two blocks
                if own and c.grouped and not c.in_aggregate:
                    if not c.loose:
                        raise EngineError(f"column must appear in group by or aggregate: {header(e)}")
                    return self.first_of_group(sql, c.block), kind
                return sql, kind
            case Aggregate():
                return self.aggregate(e, c)
            case Like():
                return self.like(e, c)
            case Subquery():
                return self.subquery(e, c)
            case Apply(op, args):
                made = [self.expr(a, c) for a in args]
                return self.apply(op, made, args)
        raise EngineError(f"cannot compile {e!r}")

    def first_of_group(self, sql: str, block: Block) -> str:
        if len(block.entries) == 1 and (i := block.entries[0].relation.row_id) is not None:
            return f"min_by({sql}, {block.own(block.entries[0], i)})"
        return f"first({sql})"

    def apply(self, op: str, made: list[tuple[str, str]], args: tuple) -> tuple[str, str]:
        kinds = {k for _, k in made}
        if op in ("and", "or", "not"):
            if kinds - {"bool", "null"}:
                raise EngineError(MISMATCH)
            texts = [f"CAST({t} AS BOOLEAN)" if k == "null" else t for t, k in made]
            return (f"(NOT {texts[0]})" if op == "not" else f"({texts[0]} {op.upper()} {texts[1]})"), "bool"
        if op in ("is-null", "is-not-null"):
            return f"({made[0][0]} {'IS NULL' if op == 'is-null' else 'IS NOT NULL'})", "bool"
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(op, *made, args), "bool"
        if op in ("+", "-", "*", "/", "%"):
            if kinds - {"int", "float", "null"}:
                raise EngineError(MISMATCH)
            kind = "float" if "float" in kinds else "int"
            name = "DOUBLE" if kind == "float" else "BIGINT"
            texts = [t if a is not None and isinstance(a, Literal) and k == kind else f"CAST({t} AS {name})" for (t, k), a in zip(made, args, strict=True)]
            if len(texts) == 1:
                return f"({op} {texts[0]})", kind
            if op == "/" and kind == "int":
                return f"({texts[0]} div {texts[1]})", kind
            if op == "%" and kind == "int" and not (isinstance(args[1], Literal) and args[1].value != -1):
                # The remainder of the least number by -1 overflows, as the quotient does.
                return f"(CASE WHEN {texts[1]} = -1L THEN ({texts[0]} div {texts[1]}) * 0L ELSE {texts[0]} % {texts[1]} END)", kind
            return f"({texts[0]} {op} {texts[1]})", kind
        return functions.call(op, made)

    def compare(self, op: str, left: tuple[str, str], right: tuple[str, str], args: tuple = (None, None)) -> str:
        (a, ka), (b, kb) = left, right
        if "null" not in (ka, kb) and ka != kb:
            if {ka, kb} == {"date", "str"}:
                for i, k in enumerate((ka, kb)):
                    if k == "str" and isinstance(args[i], Literal):
                        check_date(args[i].value)
                        a, b = (f"DATE{a}", b) if i == 0 else (a, f"DATE{b}")
                    elif k == "str":
                        t = (a, b)[i]
                        strict = f"CASE WHEN {t} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN CAST({t} AS DATE) WHEN {t} IS NOT NULL THEN CAST(raise_error(concat('invalid date: ', {t})) AS DATE) END"
                        a, b = (strict, b) if i == 0 else (a, strict)
            elif {ka, kb} != {"int", "float"}:
                raise EngineError(MISMATCH)
        return f"({a} {op} {b})"

    def like(self, e: Like, c: Context) -> tuple[str, str]:
        (v, kv), (p, kp) = self.expr(e.value, c), self.expr(e.pattern, c)
        if {kv, kp} - {"str", "null"}:
            raise EngineError(MISMATCH)
        mark = "\x01"
        if isinstance(e.pattern, Literal) and e.pattern.kind == "str":
            # Any escaped character is literal; Spark only lets wildcards and the mark be escaped.
            out, text, i = "", e.pattern.value, 0
            while i < len(text):
                ch = text[i]
                if e.escape and ch == e.escape:
                    i += 1
                    if i == len(text):
                        raise EngineError("like pattern ends with its escape character")
                    ch = text[i]
                    out += mark + ch if ch in "%_" else ch
                else:
                    out += ch
                i += 1
            p = quote(out)
        else:
            p = f"replace({p}, {quote(mark)}, {quote(mark + mark)})"
            if e.escape:
                # In turn: mark escaped characters, keep the mark of wildcards only.
                esc, hold = re.escape(e.escape), "\x02"
                p = f"regexp_replace({p}, {quote(f'(?s){esc}(.)')}, {quote(hold + '$1')})"
                p = f"CASE WHEN endswith({p}, {quote(e.escape)}) AND NOT endswith({p}, {quote(hold + e.escape)}) THEN raise_error('like pattern ends with its escape character') ELSE {p} END"
                p = f"replace(regexp_replace({p}, '{hold}([%_\\x01])', {quote(mark + '$1')}), '{hold}', '')"
        return f"({v} {'NOT ' if e.negated else ''}LIKE {p} ESCAPE {quote(mark)})", "bool"

    def aggregate(self, e: Aggregate, c: Context) -> tuple[str, str]:
        if c.in_aggregate or not c.allow_aggregates:
            raise EngineError("aggregate not allowed here")
        if e.argument is None:
            return "count(1)", "int"
        sql, kind = self.expr(e.argument, Context(c.block, in_aggregate=True))
        d = "DISTINCT " if e.distinct else ""
        if e.function == "count":
            return f"count({d}{sql})", "int"
        if e.function in ("sum", "avg"):
            if kind not in ("int", "float", "null"):
                raise EngineError(MISMATCH)
            if e.function == "sum":
                wide = "DOUBLE" if kind == "float" else "BIGINT"
                return f"sum({d}CAST({sql} AS {wide}))", "float" if kind == "float" else "int"
            return f"avg({d}CAST({sql} AS DOUBLE))", "float"
        return f"{e.function}({sql})", kind

    def subquery(self, e: Subquery, c: Context) -> tuple[str, str]:
        inner = self.query(e.query, c.block)
        if e.kind == "exists":
            return f"({'NOT ' if e.negated else ''}EXISTS ({inner.sql}))", "bool"
        if len(inner.columns) != 1:
            raise EngineError("subquery must return a single column")
        kind = inner.columns[0][1]
        if e.kind == "scalar":
            return self.running(e.query, c.block) or f"({inner.sql})", kind
        v, kv = self.expr(e.value, c)
        self.compare("=", (v, kv), ("", kind))  # types only
        if e.negated and not inner.correlated and "null" not in (kv, kind):
            # Spark broadcasts the rows of any NOT IN.  This is an anti join on equality, beside one aggregate of the
            # subquery: 0 without rows, 2 with a null among them, else 1.
            q, n = self.fresh("q"), self.fresh("q")
            flag = f"(SELECT CASE WHEN count(1) = 0 THEN 0 WHEN count({n}.o0) < count(1) THEN 2 ELSE 1 END FROM ({inner.sql}) {n})"
            same = self.compare("=", (f"{q}.o0", kind), (v, kv))
            return f"(NOT EXISTS (SELECT 1 FROM ({inner.sql}) {q} WHERE {same}) AND ({flag} = 0 OR CASE WHEN {v} IS NULL OR {flag} = 2 THEN CAST(NULL AS BOOLEAN) ELSE true END))", "bool"
        return f"({v} {'NOT ' if e.negated else ''}IN ({inner.sql}))", "bool"

    def running(self, u: Union, outside: Block) -> str | None:
        """A scalar subquery that aggregates the rows on one side of an outer value, among rows equal in other columns; None for other forms.

        Spark would join every distinct outer value with the inner table.  Here the values of both are sorted together
        and aggregated along, in one task for each value of the equal columns; only equalities remain to be correlated.
        """
        s = u.first
        if u.rest or any((q.order or q.limit is not None or q.offset) for q in (u, s)) or s.groups or s.having is not None or s.distinct or len(s.items) != 1:
            return None
        a = s.items[0][0]
        if not isinstance(a, Aggregate) or (a.distinct and a.function not in ("min", "max")):
            return None
        inside = Block(self, outside, [Entry(x.alias, "", self.lookup(x.table)) for x in s.sources])
        own = lambda e: (names := _names(e)) is not None and all(inside.find(n) for n in names)
        if not all(x.on is None or own(x.on) for x in s.sources) or not (a.argument is None or isinstance(a.argument, Name) and own(a.argument)):
            return None
        local: list[Any] = []
        equal: list[tuple[Name, tuple[Entry, int]]] = []
        bounds: list[tuple[Name, tuple[Entry, int], str]] = []
        for e in conjuncts(s.where):
            if own(e):
                local.append(e)
                continue
            if not (isinstance(e, Apply) and e.op in _TURNED and all(isinstance(n, Name) for n in e.args)):
                return None
            (mine, other), op = e.args, e.op
            if not inside.find(mine):
                mine, other, op = other, mine, _TURNED[op]
            if not (hit := inside.find(mine)) or not (found := inside.outer(other)):
                return None
            block, place = found
            if block is not outside and not (place := outside.equal.get((id(block), place[0].sql, place[1]))):
                return None
            kinds = {x.relation.columns[i][1] for x, i in (hit, place)}
            if len(kinds) > 1 or "other" in kinds:
                return None
            if op == "=":
                equal.append((mine, place))
            else:
                bounds.append((mine, place, op))
        if len(bounds) != 1 or len({id(x) for _, (x, _) in equal} | {id(bounds[0][1][0])}) > 1 or bounds[0][1][0].relation.frame is None:
            return None
        (mine, place, op), source = bounds[0], bounds[0][1][0]
        columns = [*equal, (mine, place)]
        keys = [f"k{i}" for i in range(len(columns))]

        # The outer values: of all rows that the enclosing block's conditions on that one source leave.
        far = Block(self, None, [Entry(source.alias, self.fresh("a"), source.relation)])
        self.frames[frame := self.fresh("f")] = source.relation.frame
        kept = [self.expr(e, Context(far))[0] for e in conjuncts(outside.where) if (names := _names(e)) and all((h := outside.find(n)) and h[0] is source for n in names)]
        values = ", ".join(f"{far.own(far.entries[0], i)} AS {k}" for k, (_, (_, i)) in zip(keys, columns, strict=True))
        outer = f"SELECT {values}, NULL AS v, 1 AS d FROM {{{frame}}} {far.entries[0].sql}" + (f" WHERE {' AND '.join(kept)}" if kept else "")
        where = None
        for e in local:
            where = e if where is None else Apply("and", (where, e))
        rows = self.query(Union(Select([(n, None) for n, _ in columns] + [(a.argument or Literal(1, "int"), None)], s.sources, where)))
        inner = f"SELECT {', '.join(f'o{i} AS {k}' for i, k in enumerate(keys))}, o{len(keys)} AS v, 0 AS d FROM ({rows.sql}) {self.fresh('q')}"

        whole = a.function == "sum" and rows.columns[-1][1] == "int"
        number = "DECIMAL(19, 0)" if whole else "DOUBLE"  # running sums of whole numbers may pass the range where the one asked for does not
        within = {"count": "count(v)", "sum": f"sum(CAST(v AS {number}))", "avg": "sum(CAST(v AS DOUBLE))"}.get(a.function, f"{a.function}(v)")
        along = "sum" if a.function in ("count", "avg") else a.function
        order = [f"PARTITION BY {', '.join(keys[:-1])}"] if equal else []
        order += [f"ORDER BY {keys[-1]}{' DESC' if op[0] == '>' else ''} ROWS BETWEEN UNBOUNDED PRECEDING AND {'CURRENT ROW' if '=' in op else '1 PRECEDING'}"]
        over = f"OVER ({' '.join(order)})"
        value = f"{along}(v) {over}" + (f" / nullif(sum(n) {over}, 0L)" if a.function == "avg" else "")
        grouped = f"SELECT {', '.join(keys)}, {within} AS v, count(v) AS n, max(d) AS d FROM ({outer} UNION ALL {inner}) {self.fresh('q')} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)}"
        q = self.fresh("q")
        met = " AND ".join(f"{q}.{k} = {outside.own(*place)}" for k, (_, place) in zip(keys, columns, strict=True))
        out = f"(SELECT max({q}.v) FROM (SELECT {', '.join(keys)}, {value} AS v, d FROM ({grouped}) {self.fresh('q')}) {q} WHERE {q}.d = 1 AND {met})"
        return f"coalesce({out}, 0L)" if a.function == "count" else f"CAST({out} AS BIGINT)" if whole else out

    # Queries.
    def query(self, u: Union, parent: Block | None = None) -> Query:
        if not u.rest:
            return self.block(u.first, u, parent)
        empty = Union(Select())
        out = self.block(u.first, empty, parent)
        sql, kinds, correlated = out.sql, [k for _, k in out.columns], out.correlated
        for every, s in u.rest:
            more = self.block(s, empty, parent)
            correlated |= more.correlated
            if len(more.columns) != len(kinds):
                raise EngineError("union column count mismatch")
            for i, (_, k) in enumerate(more.columns):
                if {kinds[i], k} == {"int", "float"}:
                    kinds[i] = "float"
                elif kinds[i] == "null":
                    kinds[i] = k
                elif k not in (kinds[i], "null"):
                    raise EngineError(MISMATCH)
            sql = f"({sql}) UNION {'ALL' if every else 'DISTINCT'} ({more.sql})"
        columns = [(n, k) for (n, _), k in zip(out.columns, kinds, strict=True)]
        if u.order or u.limit is not None or u.offset:
            block = Block(self, parent, [Entry("", a := self.fresh("u"), Relation(columns, None))])
            keys = []
            for e, down in u.order:
                place = next((i for i, (n, _) in enumerate(columns) if n == header(e)), None)
                text = f"{a}.o{place}" if place is not None else self.expr(e, Context(block))[0].replace(f"{a}.c", f"{a}.o")
                keys.append(f"{text} {'DESC' if down else 'ASC'}")
            sql = f"SELECT * FROM ({sql}) {a}{_tail(keys, u)}"
        return Query(sql, columns, correlated)

    def block(self, s: Select, u: Union, parent: Block | None) -> Query:
        start, wrapped = self.n, None
        while True:
            block = Block(self, parent, wrapped=wrapped)
            out = self.block_once(s, u, block)
            out.correlated = block.correlated
            if not block.passed or wrapped:
                return out
            self.n, wrapped = start, self.fresh("w") + "_"
            self.n += 1000  # names of the second attempt differ from those of the first

    def block_once(self, s: Select, u: Union, block: Block) -> Query:
        plain = Context(block)
        text_from = ""
        aliases: set[str] = set()
        for source in s.sources:
            if source.alias in aliases:
                raise EngineError(f"ambiguous table: {source.alias}")
            aliases.add(source.alias)
            rel = self.lookup(source.table)
            entry = Entry(source.alias, self.fresh("a"), rel)
            block.entries.append(entry)
            frame = self.fresh("f")
            self.frames[frame] = rel.frame
            item = f"{{{frame}}} {entry.sql}"
            if not text_from:
                text_from = item
            elif source.on is None:
                text_from += f" CROSS JOIN {item}"
            else:
                block.in_from = True
                on, kind = self.expr(source.on, plain)
                block.in_from = False
                self.boolean(kind, "on")
                text_from += f" {source.kind.upper()} JOIN {item} ON {on}"

        items: list[tuple[Any, str]] = []
        for e, alias in s.items:
            if e == "*":
                if not block.entries:
                    raise EngineError("* needs a table")
                items += [(Name(c, x.alias), c) for x in block.entries for i, (c, _) in enumerate(x.relation.columns) if i != x.relation.row_id]
            else:
                items.append((e, alias or header(e)))
        named = {alias: e for e, alias in s.items if alias}
        order = [(named.get(e.column, e) if isinstance(e, Name) and not e.owner else e, down) for e, down in u.order]

        where = ""
        if s.where is not None:
            block.note_equalities(s.where)
            sql, kind = self.expr(s.where, plain)
            self.boolean(kind, "where")
            where = f" WHERE {sql}"
        grouped = bool(s.groups) or any(_holds_aggregate(e) for e in [*(e for e, _ in items), s.having, *(e for e, _ in order)])
        keys: dict[str, str] = {}
        for g in s.groups:
            if _holds_aggregate(g):
                raise EngineError("aggregate functions are not allowed in group by")
            sql, _ = self.expr(g, plain)
            keys[sql] = sql
        c = Context(block, grouped, keys, bool(s.groups), allow_aggregates=True) if grouped else plain
        made = [self.expr(e, c) for e, _ in items]
        having = ""
        if s.having is not None:
            sql, kind = self.expr(s.having, c)
            self.boolean(kind, "having")
            having = f" HAVING {sql}" if grouped else ""
            if not grouped:
                where = f"{where} AND {sql}" if where else f" WHERE {sql}"
        sorted_by = [(self.expr(e, c)[0], down) for e, down in order]

        if block.passed:
            inner = [f"{e.sql}.c{i} AS {e.sql}_c{i}" for e in block.entries for i in range(len(e.relation.columns))]
            inner += [f"{sql} AS {name}" for sql, name in block.passed.items()]
            text_from = f"(SELECT {', '.join(inner)} FROM {text_from}) {block.wrapped}"
        body = f" FROM {text_from}" if text_from else ""
        body += where + (f" GROUP BY {', '.join(keys)}" if keys else "") + having
        cast = lambda t, k: f"CAST({t} AS STRING)" if k == "null" else t
        columns = ", ".join(f"{cast(t, k)} AS o{i}" for i, (t, k) in enumerate(made))
        result = [(n, k) for (_, n), (_, k) in zip(items, made, strict=True)]
        if s.distinct and sorted_by:
            texts = [t for t, _ in made]
            if all(t in texts for t, _ in sorted_by):
                sql = f"SELECT * FROM (SELECT DISTINCT {columns}{body}) {self.fresh('d')}"
                return Query(sql + _tail([f"o{texts.index(t)} {'DESC' if down else 'ASC'}" for t, down in sorted_by], u), result)
            if grouped or len({down for _, down in sorted_by}) > 1:
                raise EngineError("not supported: distinct ordered by columns that are not selected")
            # The first row kept of equal ones is the first in the order.
            best = ("max" if sorted_by[0][1] else "min") + f"(struct({', '.join(t for t, _ in sorted_by)})) AS k"
            outs = ", ".join(f"o{i}" for i in range(len(made)))
            inner = f"SELECT {columns}, {best}{body} GROUP BY {', '.join(t for t, _ in made)}"
            return Query(f"SELECT {outs} FROM ({inner}) {self.fresh('d')}" + _tail([f"k {'DESC' if sorted_by[0][1] else 'ASC'}"], u), result)
        if order and not s.distinct and (grouped or any(_holds(e, (Subquery,)) for e, _ in order)):
            # Spark has no correlated subqueries in ORDER BY, and no aggregates there beside HAVING: the keys are columns of a query below.
            inner = f"SELECT {columns}, {', '.join(f'{t} AS k{i}' for i, (t, _) in enumerate(sorted_by))}{body}"
            outs = ", ".join(f"o{i}" for i in range(len(made)))
            return Query(f"SELECT {outs} FROM ({inner}) {self.fresh('d')}" + _tail([f"k{i} {'DESC' if down else 'ASC'}" for i, (_, down) in enumerate(sorted_by)], u), result)
        sql = f"SELECT {'DISTINCT ' if s.distinct else ''}{columns}{body}"
        return Query(sql + _tail([f"{t} {'DESC' if down else 'ASC'}" for t, down in sorted_by], u), result)

    @staticmethod
    def boolean(kind: str, clause: str) -> None:
        if kind not in ("bool", "null"):
            raise EngineError(f"{clause} clause must evaluate to boolean")

    def frame(self, q: Query) -> DataFrame:
        df = self.spark.sql(q.sql, **{k: v for k, v in self.frames.items() if f"{{{k}}}" in q.sql})
        return df.toDF(*(n for n, _ in q.columns))


def conjuncts(e: Any) -> list[Any]:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if isinstance(e, Apply) and e.op == "and" else [e] if e is not None else []


def _names(e: Any) -> list[Name] | None:
    """The columns of an expression; None if it holds a subquery or an aggregate."""
    match e:
        case Name():
            return [e]
        case Literal():
            return []
        case Apply(_, parts):
            pass
        case Like(v, p):
            parts = (v, p)
        case _:
            return None
    found = [_names(x) for x in parts]
    return None if None in found else [n for x in found for n in x]


def _holds(e: Any, kinds: tuple[type, ...]) -> bool:
    """Whether an expression is, or has below it in its own block, a node of some kinds."""
    if isinstance(e, kinds):
        return True
    match e:
        case Apply(_, args):
            return any(_holds(a, kinds) for a in args)
        case Like(v, p):
            return _holds(v, kinds) or _holds(p, kinds)
        case Subquery(_, _, v):
            return v is not None and _holds(v, kinds)
    return False


def _holds_aggregate(e: Any) -> bool:
    return _holds(e, (Aggregate,))


def _tail(keys: list[str], u: Union) -> str:
    out = f" ORDER BY {', '.join(keys)}" if keys else ""
    if u.limit is not None:
        out += f" LIMIT {u.limit}"
    return out + (f" OFFSET {u.offset}" if u.offset else "")
