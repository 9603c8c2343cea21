"""Registered queries of BC6H, with DuckDB SQL from the public list of modes."""

from __future__ import annotations

from texloom.functions import bc_tables
from texloom.operators import decode
from texloom.plans import fixtures as X
from texloom.plans.texture_queries import query

# -- SQL: one row for each bit of a number, then arithmetic on the sums ------------------------------------------------


def _rows() -> tuple[list[str], list[str]]:
    """The modes, and the place of each bit of each number, read from the list once more."""
    modes, places = [], []
    for line in bc_tables.BC6_MODES:
        mode, base, dr, dg, db, moved, *fields = line.split()
        at = 2 if int(mode) < 2 else 5
        modes.append(f"({mode}, {base}, {dr}, {dg}, {db}, {moved})")
        for field in fields:
            low, _, high = field[2:].partition("..")
            step = 1 if int(high or low) >= int(low) else -1
            for bit in range(int(low), int(high or low) + step, step):
                places.append(f"({mode}, '{field[:2]}', {bit}, {at})")
                at += 1
    return modes, places


def _sql(signed: bool) -> tuple[str, list[str]]:
    modes, places = _rows()
    sign = lambda v, n: f"(CASE WHEN {v} >= (1 << ({n} - 1)) THEN {v} - (1 << {n}) ELSE {v} END)"
    parts = [X.BLOCKS_SQL, f"mo AS (SELECT * FROM (VALUES {', '.join(modes)}) t(mode, base, dr, dg, db, moved))", f"pl AS (SELECT * FROM (VALUES {', '.join(places)}) t(mode, name, bit, place))"]
    parts.append("bi AS (SELECT doc_id, k, block, list_transform(range(128), lambda i: (block[CAST(i // 8 + 1 AS INTEGER)] >> (i % 8)) & 1) AS bits, CASE WHEN block[1] & 3 < 2 THEN block[1] & 3 ELSE block[1] & 31 END AS mode FROM bl)")
    names = [c + e for c in "rgb" for e in "wxyz"]
    picked = ", ".join(f"sum(CASE WHEN name = '{n}' THEN bits[place + 1] << bit ELSE 0 END)::BIGINT AS v{n}" for n in names)
    parts.append(f"nu AS (SELECT doc_id, k, bits, bi.mode, {picked} FROM bi JOIN pl ON pl.mode = bi.mode GROUP BY doc_id, k, bits, bi.mode)")
    first = [f"{sign(f'v{c}w', 'base') if signed else f'v{c}w'} AS {c}0" for c in "rgb"]
    parts.append(f"n0 AS (SELECT nu.*, base, dr, dg, db, moved, {', '.join(first)} FROM nu JOIN mo USING (mode))")
    others = []
    for c in "rgb":
        for i, e in enumerate("xyz", 1):
            raw = sign(f"v{c}{e}", "d" + c)
            moved = f"(({raw} + {c}0) & ((1 << base) - 1))"
            others.append(f"CASE WHEN moved = 1 THEN {sign(moved, 'base') if signed else moved} ELSE {raw if signed else f'v{c}{e}'} END AS {c}{i}")
    parts.append(f"n1 AS (SELECT *, {', '.join(others)} FROM n0)")
    if signed:
        grown = lambda v: f"CASE WHEN base >= 16 THEN {v} ELSE sign({v}) * CASE WHEN {v} = 0 THEN 0 WHEN abs({v}) >= (1 << (base - 1)) - 1 THEN 32767 ELSE (abs({v}) * 32768 + 16384) >> (base - 1) END END"
    else:
        grown = lambda v: f"CASE WHEN base >= 15 OR {v} = 0 THEN {v} WHEN {v} = (1 << base) - 1 THEN 65535 ELSE ({v} * 65536 + 32768) >> base END"
    parts.append(f"n2 AS (SELECT doc_id, k, bits, mode, {', '.join(f'CAST({grown(c + str(i))} AS BIGINT) AS {c}{i}' for c in 'rgb' for i in range(4))}, mode NOT IN (3, 7, 11, 15) AS two, bits[78] + 2 * bits[79] + 4 * bits[80] + 8 * bits[81] + 16 * bits[82] AS part FROM n1)")
    parts.append(f"pt AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{row}{chr(39)}, {fix})' for i, (row, fix) in enumerate(zip(bc_tables.TWO[:32], bc_tables.FIX_TWO[:32], strict=True)))}) t(part, subset, fix))")
    parts.append("px AS (SELECT n2.*, p AS pixel, two AND subset[CAST(p + 1 AS INTEGER)] = '1' AS far, CASE WHEN two THEN 82 + 3 * p - (p > 0)::INT - (p > fix)::INT ELSE 65 + 4 * p - (p > 0)::INT END AS spot, CASE WHEN two THEN 3 ELSE 4 END - (p = 0 OR (two AND p = fix))::INT AS n FROM n2 JOIN pt USING (part), (SELECT unnest(range(16)) AS p))")
    weights = f"CASE WHEN two THEN {list(bc_tables.WEIGHTS[3])}[idx + 1] ELSE {list(bc_tables.WEIGHTS[4])}[idx + 1] END"
    parts.append(f"wt AS (SELECT *, CAST({weights} AS BIGINT) AS w FROM (SELECT *, CAST(list_sum(list_transform(range(n), lambda j: bits[CAST(spot + j + 1 AS INTEGER)] << j)) AS INTEGER) AS idx FROM px))")
    mixed = {c: f"((CASE WHEN far THEN {c}2 ELSE {c}0 END * (64 - w) + CASE WHEN far THEN {c}3 ELSE {c}1 END * w + 32) >> 6)" for c in "rgb"}
    parts.append(f"hf AS (SELECT doc_id, k, pixel, {', '.join(f'{v} AS {c}' for c, v in mixed.items())} FROM wt)")
    code = (lambda c: f"(CASE WHEN {c} < 0 AND ((-{c}) * 31) >> 5 > 0 THEN 32768 ELSE 0 END + ((abs({c}) * 31) >> 5))") if signed else (lambda c: f"(({c} * 31) >> 6)")
    parts.append(f"hc AS (SELECT doc_id, k, pixel, {', '.join(f'{code(c)} AS {c}' for c in 'rgb')} FROM hf)")

    def single(c: str) -> str:
        m, e = f"({c} & 1023)", f"(({c} >> 10) & 31)"
        top = f"CAST(floor(log2(greatest({m}, 1))) AS BIGINT)"
        return f"CAST(({c} >> 15) * 2147483648 + CASE WHEN {e} = 31 THEN 255 * 8388608 + {m} * 8192 WHEN {e} > 0 THEN ({e} + 112) * 8388608 + {m} * 8192 WHEN {m} = 0 THEN 0 ELSE ({top} + 103) * 8388608 + {m} * CAST(pow(2, 23 - {top}) AS BIGINT) - 8388608 END AS BIGINT)"

    shown = f"SELECT doc_id, k, CAST(pixel AS BIGINT) AS pixel, {', '.join(f'{single(c)} AS {c}' for c in 'rgb')} FROM hc"
    none = "SELECT doc_id, k, CAST(p AS BIGINT) AS pixel, 0::BIGINT AS r, 0::BIGINT AS g, 0::BIGINT AS b FROM bi, (SELECT unnest(range(16)) AS p) WHERE mode IN (19, 23, 27, 31)"
    return f"{shown} UNION ALL {none}", parts


def _query(name: str, signed: bool):
    def run(spark, sf_dir):
        return decode.block_pixels(X.block_bytes(spark, sf_dir), name)

    run.__name__, run.__doc__ = f"q_{name.lower()}_decode", "Blocks in all 14 modes and the reserved ones, as the 32 bits of their numbers."
    sql, parts = _sql(signed)
    query(sql, *parts)(run)


_query("BC6H_UF16", False)
_query("BC6H_SF16", True)
