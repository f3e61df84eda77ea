"""The dialect's scalar functions: argument checks and the Spark SQL they stand for."""

from __future__ import annotations

from basaltql.errors import EngineError

#: name: (least, greatest number of arguments)
ARITY = {"concat": (1, 1 << 30), "upper": (1, 1), "lower": (1, 1), "length": (1, 1), "substring": (2, 3), "substr": (2, 3)}


def call(name: str, args: list[tuple[str, str]]) -> tuple[str, str]:
    """(Spark SQL, type) of a function on (Spark SQL, type) arguments."""
    if name not in ARITY:
        raise EngineError(f"unknown function: {name}")
    low, high = ARITY[name]
    if not low <= len(args) <= high:
        raise EngineError(f"{name} expects {low} argument(s), got {len(args)}")
    kinds = [k for _, k in args]
    texts = [t for t, _ in args]
    if name == "concat":
        return f"concat({', '.join(as_text(t, k) for t, k in args)})", "str"
    if kinds[0] not in ("str", "null") or any(k not in ("int", "null") for k in kinds[1:]):
        raise EngineError("type mismatch in expression")
    if name in ("upper", "lower"):
        return f"{name}(CAST({texts[0]} AS STRING))", "str"
    if name == "length":
        return f"CAST(length(CAST({texts[0]} AS STRING)) AS BIGINT)", "int"
    start = f"CAST({texts[1]} AS BIGINT)"
    size = f"CAST({texts[2]} AS BIGINT)" if len(args) == 3 else None
    # Positions are cut to what 32 bits hold; no string is longer.
    clip = lambda x: f"CAST(least({x}, 2147483647L) AS INT)"
    inner = f"substring({texts[0]}, {clip(start)}{f', {clip(size)}' if size else ''})"
    checks = f"WHEN {start} < 1 THEN raise_error('substring start must be positive') "
    if size:
        checks += f"WHEN {size} < 0 THEN raise_error('substring length must not be negative') "
    return f"CASE {checks}ELSE {inner} END", "str"


def as_text(text: str, kind: str) -> str:
    if kind == "float":
        # Positional form with at least one decimal: exponents are written out through a decimal.
        wide = f"rtrim('0', format_number({text}, '0.##############################'))"
        return f"CASE WHEN isnan({text}) THEN 'NaN' WHEN {text} = double('Infinity') THEN 'inf' WHEN {text} = double('-Infinity') THEN '-inf' WHEN abs({text}) BETWEEN 1e-3 AND 9999999D OR {text} = 0 THEN CAST({text} AS STRING) WHEN {text} IS NULL THEN NULL WHEN instr({wide}, '.') = 0 THEN concat(format_number({text}, '0'), '.0') ELSE {wide} END"
    return f"CAST({text} AS STRING)"
