"""INSERT, UPDATE and DELETE: each makes new files of a table from the old ones, with the dialect's checks.

UPDATE and DELETE find the files that hold a row they hit (a count for each file, in one pass) and write only
those anew; INSERT adds a folder, or merges it with the small ones once there are many.
"""

from __future__ import annotations

import datetime
import re
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltql.errors import EngineError
from basaltql.plans.compiler import Compiler, check_date, relation
from basaltql.plans.syntax import Literal, Select, Source, Union, positional
from basaltql.sources.storage import ROW_ID, SMALL_PATHS, SMALL_ROWS, Database, spark_type


def coerce(e: Literal, kind: str, column: str) -> Any:
    """The value of a literal in a column of a type, or an error: nothing is converted but whole numbers to floats."""
    v = e.value
    if e.kind == "null" or e.kind == kind or kind == "text" and e.kind == "str":
        return v
    if kind == "float" and e.kind == "int":
        return float(v)
    if e.kind == "str" and (m := re.fullmatch(r"char\((\d+)\)", kind)):
        if len(v) <= int(m[1]):
            return v
        raise EngineError(f"cannot insert '{v}' into column {column}")
    if e.kind == "str" and kind == "date":
        try:
            check_date(v)
        except EngineError as bad:
            raise EngineError(f"cannot insert into column {column}: {bad}") from None
        return datetime.date.fromisoformat(v)
    raise EngineError(f"cannot insert {positional(v) if e.kind == 'float' else v} into column {column}")


def duplicate(name: str, column: str) -> EngineError:
    return EngineError(f"duplicate key: {name}({column})")


def check_literals(db: Database, name: str, table: dict[str, Any], data: list[tuple]) -> None:
    """No unique column of new rows repeats a value of its own or of the old rows; nulls never do.

    The old rows are asked for the new values only: a filter that reaches the Parquet scan, its bloom filters included.
    """
    wanted = None
    for i, c in enumerate(table["columns"]):
        values = [r[i] for r in data if c["unique"] and r[i] is not None]
        if len(set(values)) < len(values):
            raise duplicate(name, c["name"])
        if values:
            hit = F.col(f"`{c['name']}`").isin(values)
            wanted = hit if wanted is None else wanted | hit
    if wanted is not None and table["folders"] and (old := db.read(table).where(wanted).limit(1).collect()):
        column = next(c["name"] for i, c in enumerate(table["columns"]) if c["unique"] and old[0][i] in {r[i] for r in data})
        raise duplicate(name, column)


def check_unique(db: Database, name: str, table: dict[str, Any], columns: list[str]) -> None:
    """No value of these columns stands twice in the table; nulls may."""
    for c in columns:
        col = F.col(f"`{c}`")
        if db.read(table).where(col.isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
            raise duplicate(name, c)


def insert(db: Database, table: dict[str, Any], name: str, columns: list[str] | None, rows: list[list[Literal]]) -> tuple[dict[str, Any], int]:
    every = table["columns"]
    names = [c["name"] for c in every]
    for c in columns or []:
        if c not in names:
            raise EngineError(f"no such column: {c}")
        if columns.count(c) > 1:
            raise EngineError(f"column specified twice: {c}")
    chosen = columns or names
    if any(len(r) != len(chosen) for r in rows):
        raise EngineError("column count does not match value count")
    data, rid = [], table["next_rid"]
    for r in rows:
        given = dict(zip(chosen, r, strict=True))
        made = []
        for c in every:
            v = coerce(given.get(c["name"]) or Literal(*c["default"] or (None, "null")), c["kind"], c["name"])
            if v is None and c["not_null"]:
                raise EngineError(f"column {c['name']} cannot be null")
            made.append(v)
        data.append((*made, rid + len(data)))
    check_literals(db, name, table, data)
    new = db.spark.createDataFrame(data, db.schema(table)).coalesce(1)
    table = {**table, "next_rid": rid + len(data)}
    small = [p for p in table["folders"] if table.get("rows", {}).get(p, SMALL_ROWS) < SMALL_ROWS]
    if len(small) >= SMALL_PATHS:
        return db.merged(name, table, small, new, len(data)), len(data)
    # Appending adds a folder; what is there is not rewritten.
    folder = db.write(name, new, db.keys(db.manifest, name))
    return {**table, "folders": [*table["folders"], folder], "rows": {**table.get("rows", {}), folder: len(data)}}, len(data)


_FILE, _TARGET = "_file", "\0target"


def _with_matches(db: Database, table: dict[str, Any], compiler: Compiler, name: str, where: Any, extra: list[Any], paths: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The rows of some paths with hit (whether WHERE is true), their files, and the values of extra expressions on them."""
    select = Select(items=[("*", None)] + [(e, f"__set{i}") for i, e in enumerate(extra)], sources=[Source(_TARGET, name)])
    rel = relation(db.read(table, paths).withColumn(_FILE, F.col("_metadata.file_path")))  # the row number and the file go along
    # WHERE may name the table again, in a subquery: that one is whole.
    lookup = compiler.lookup
    compiler.lookup = lambda n: rel if n == _TARGET else lookup(n)
    select.items.append((where if where is not None else Literal(None, "null"), "__hit"))
    q = compiler.query(Union(select))
    if where is not None:
        compiler.boolean(q.columns[-1][1], "where")
    return compiler.frame(q), q.columns


def _touched(db: Database, table: dict[str, Any], df: DataFrame, hit: Column) -> tuple[int, list[str], list[str]]:
    """(rows hit, files that hold one, paths of all other files); files as the manifest names them."""
    counts = df.where(hit).groupBy(_FILE).agg(F.count(F.lit(1)).alias("n")).collect()
    files = [unquote(r[0]) for r in counts]
    touched = ["/".join(f.rsplit("/", 3)[1:]) for f in files]
    rest = []
    for p in table["folders"]:
        if not any(t == p or t.startswith(p + "/") for t in touched):
            rest.append(p)
        elif p not in touched:
            rest += [f"{p}/{f}" for f in db.files.files(f"{db.path}/{p}") if f.endswith(".parquet") and f"{p}/{f}" not in touched]
    return sum(r.n for r in counts), touched, rest


def update(db: Database, table: dict[str, Any], name: str, sets: list[tuple[str, Any]], where: Any, compiler: Compiler) -> tuple[dict[str, Any], int]:
    columns = {c["name"]: c for c in table["columns"]}
    for c, _ in sets:
        if c not in columns:
            raise EngineError(f"no such column: {c}")
    if not table["folders"]:
        return table, 0
    again = lambda paths: _with_matches(db, table, compiler.again(), name, where, [e for _, e in sets], paths)
    df, kinds = again(table["folders"])
    hit = F.lit(True) if where is None else F.coalesce(F.col("__hit").cast("boolean"), F.lit(False))
    values: dict[str, Column] = {}
    for i, (c, e) in enumerate(sets):
        values[c] = _assigned(columns[c], F.col(f"__set{i}"), dict(kinds)[f"__set{i}"], e)
    n, touched, rest = _touched(db, table, df, hit)
    if not n:
        return table, 0
    df, _ = again(touched)
    out = df.select(*(F.when(hit, values[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in columns), ROW_ID)
    new = {**table, "folders": [*rest, db.write(name, out, db.keys(db.manifest, name))]}
    check_unique(db, name, new, [c for c in values if columns[c]["unique"]])
    return new, n


def _assigned(column: dict[str, Any], value: Column, kind: str, e: Any) -> Column:
    """The value checked and converted as coerce() does; a wrong value fails the statement where it is computed."""
    name, want = column["name"], column["kind"]
    if isinstance(e, Literal):
        coerce(e, want, name)
    bad = lambda text: F.raise_error(F.concat(F.lit("cannot insert "), text, F.lit(f" into column {name}")))
    target = spark_type(want)
    fits = kind == "null" or kind == want or (want, kind) == ("float", "int") or kind == "str" and (want in ("text", "date") or want.startswith("char"))
    if not fits:
        raise EngineError(f"cannot insert {kind} into column {name}")
    out = value.cast(target) if want != "date" or kind == "date" else F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.cast("date")).when(value.isNotNull(), bad(value).cast("date"))
    if m := re.fullmatch(r"char\((\d+)\)", want):
        out = F.when(F.length(value) > int(m[1]), bad(value)).otherwise(out)
    if column["not_null"]:
        out = F.when(value.isNull(), F.raise_error(F.lit(f"column {name} cannot be null")).cast(target)).otherwise(out)
    return out


def delete(db: Database, table: dict[str, Any], name: str, where: Any, compiler: Compiler) -> tuple[dict[str, Any], int]:
    if where is None:
        return {**table, "folders": []}, db.read(table).count()
    if not table["folders"]:
        return table, 0
    again = lambda paths: _with_matches(db, table, compiler.again(), name, where, [], paths)[0]
    hit = F.coalesce(F.col("__hit").cast("boolean"), F.lit(False))
    n, touched, rest = _touched(db, table, again(table["folders"]), hit)
    if not n:
        return table, 0
    left = again(touched).where(~hit).select(*(F.col(f"`{c['name']}`") for c in table["columns"]), ROW_ID)
    return {**table, "folders": [*rest, db.write(name, left, db.keys(db.manifest, name))]}, n
