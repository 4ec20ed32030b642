"""Pieces of DuckDB SQL for the comparison statements."""

from __future__ import annotations

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def digest(cols: list[str]) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || ({c})::VARCHAR, '~')" for c in cols]
    return f"sha256({' || '.join(parts)})"


def int_dir(k: str, levels: int = 4) -> str:
    digits = [f"substr('{ALPHABET}', ((({k}) >> {6 * i}) & 63)::INT + 1, 1)" for i in range(levels, 0, -1)]
    return " || '/' || ".join(digits)


def hexed(value: str, width: int) -> str:
    return f"right(repeat('0', 16) || hex({value}), {2 * width})"


def packed_int(k: str) -> str:
    """Hex of one packed integer."""
    return (
        f"CASE WHEN {k} BETWEEN -32 AND 127 THEN {hexed(k, 1)}"
        f" WHEN {k} BETWEEN 128 AND 255 THEN 'CC' || {hexed(k, 1)}"
        f" WHEN {k} BETWEEN 256 AND 65535 THEN 'CD' || {hexed(k, 2)}"
        f" WHEN {k} BETWEEN 65536 AND 4294967295 THEN 'CE' || {hexed(k, 4)}"
        f" WHEN {k} > 4294967295 THEN 'CF' || {hexed(k, 8)}"
        f" WHEN {k} >= -128 THEN 'D0' || {hexed(k, 1)}"
        f" WHEN {k} >= -32768 THEN 'D1' || {hexed(k, 2)}"
        f" WHEN {k} >= -2147483648 THEN 'D2' || {hexed(k, 4)}"
        f" ELSE 'D3' || {hexed(k, 8)} END"
    )


def packed_text(t: str) -> str:
    """Hex of one packed text."""
    n = f"strlen({t})"
    return (
        f"(CASE WHEN {n} < 32 THEN {hexed(n + ' + 160', 1)} WHEN {n} < 256 THEN 'D9' || {hexed(n, 1)}"
        f" WHEN {n} < 65536 THEN 'DA' || {hexed(n, 2)} ELSE 'DB' || {hexed(n, 4)} END || hex({t}))"
    )


def urlsafe(blob: str) -> str:
    return f"translate(to_base64({blob}), '+/', '-_')"


def filename(hex_parts: list[str]) -> str:
    return urlsafe(f"unhex('9{len(hex_parts):X}' || {' || '.join(f'({p})' for p in hex_parts)})")


def full_path(k: str) -> str:
    return f"({int_dir(k)} || '/' || {filename([packed_int(k)])})"


def double_text(x: str) -> str:
    return f"regexp_replace(({x})::VARCHAR, '\\.0$', '')"


def formatted(c: str, kind: str) -> str:
    body = {
        "text": f"CASE WHEN strlen({c}) > 50 THEN '\"' || left({c}, 47) || '...\"' ELSE '\"' || {c} || '\"' END",
        "double": double_text(c),
        "plain": f"({c})::VARCHAR",
    }[kind]
    return f"CASE WHEN {c} IS NULL THEN 'NULL' ELSE {body} END"


def differs(names: list[str], a: str = "a", b: str = "b") -> str:
    return "(" + " OR ".join(f"{a}.{n} IS DISTINCT FROM {b}.{n}" for n in names) + ")"


def op(key: str, a: str = "a", b: str = "b") -> str:
    return f"CASE WHEN {a}.{key} IS NULL THEN 'I' WHEN {b}.{key} IS NULL THEN 'D' ELSE 'U' END"


def delta(left: str, right: str, keys: list[str], names: list[str]) -> str:
    """SELECT of a flattened delta between two named tables."""
    key = keys[0]
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = [f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys] + [f"{op(key)} AS op"]
    cols += [f"a.{n} AS old_{n}" for n in names] + [f"b.{n} AS new_{n}" for n in names]
    changed = ", ".join(f"CASE WHEN a.{n} IS DISTINCT FROM b.{n} THEN '{n}' END" for n in names)
    cols.append(
        f"CASE WHEN a.{key} IS NULL OR b.{key} IS NULL THEN '' ELSE concat_ws(',', {changed}) END AS changed_columns"
    )
    return (
        f"SELECT {', '.join(cols)} FROM {left} a FULL JOIN {right} b ON {on}"
        f" WHERE a.{key} IS NULL OR b.{key} IS NULL OR {differs(names)}"
    )
