"""SQL of linear algebra, by lists and recursion, for the oracles of the solvers."""

from __future__ import annotations


def eliminated(cells: str, right: str, n: int, tag: str = "", full: bool = True) -> str:
    """CTEs m0, g (k, m, p: the matrix [A B] after k steps of elimination and the last pivot) and x (i, j, v): A^-1 B, or, unless
    full, what forward elimination leaves of A. cells and right: names of (i, j, v)."""
    above = "list_transform(r, lambda y, c: y - r[k + 1] * m[k + 1][c] / m[k + 1][k + 1])"
    own = "list_transform(r, lambda y: y / m[k + 1][k + 1])" if full else "r"
    cases = f"WHEN q = k + 1 THEN {own} " + ("" if full else "WHEN q < k + 1 THEN r ")
    part = f"unnest(range(len(r) - {n})) AS j, unnest(r[{n} + 1:]) AS v" if full else f"unnest(range({n})) AS j, unnest(r[:{n}]) AS v"
    return f"""
    m0{tag} AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM
        (SELECT i, j, CAST(v AS DOUBLE) AS v FROM {cells} UNION ALL SELECT i, j + {n}, CAST(v AS DOUBLE) FROM {right}) GROUP BY i)),
    g{tag}(k, m, p) AS (SELECT 0, m, CAST(NULL AS DOUBLE) FROM m0{tag} UNION ALL
        SELECT k + 1, list_transform(m, lambda r, q: CASE {cases}ELSE {above} END), m[k + 1][k + 1] FROM g{tag} WHERE k < {n}),
    x{tag} AS (SELECT CAST(i AS BIGINT) AS i, {part} FROM (SELECT unnest(range({n})) AS i, unnest(m) AS r FROM g{tag} WHERE k = {n}))"""


def leading_vectors(cells: str, n: int, count: int, squarings: int = 16) -> str:
    """CTEs v1, v2, ... (v: list, l: value): leading eigenvectors of the symmetric positive (i, j, v), each by repeated squaring
    of what the ones before leave, and e (idx, col, v) of all."""
    out = [f"k1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(CAST(v AS DOUBLE) ORDER BY j) AS r FROM {cells} GROUP BY i))"]
    for c in range(1, count + 1):
        square = "list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s)))"
        trace = f"list_sum(list_transform(range(1, {n} + 1), lambda t: m[t][t]))"
        scaled = f"list_transform(m, lambda r: list_transform(r, lambda y: y / {trace}))"
        norm = "sqrt(list_dot_product(w, w))"
        out.append(f"""
    q{c}(k, m) AS (SELECT 0, {scaled} FROM k{c} UNION ALL SELECT k + 1, {scaled} FROM (SELECT k, {square} AS m FROM q{c} WHERE k < {squarings})),
    w{c} AS (SELECT m[list_position(d, list_max(d))] AS w FROM (SELECT m, list_transform(range(1, {n} + 1), lambda t: m[t][t]) AS d FROM q{c} WHERE k = {squarings})),
    u{c} AS (SELECT list_transform(w, lambda y: y / {norm}) AS v FROM w{c}),
    v{c} AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM u{c}, k{c}),
    k{c + 1} AS (SELECT list_transform(m, lambda r, a: list_transform(r, lambda y, b: y - l * v[a] * v[b])) AS m FROM k{c}, v{c})""")
    rows = " UNION ALL ".join(f"SELECT unnest(range({n})) AS idx, {c - 1} AS col, unnest(v) AS v, l FROM v{c}" for c in range(1, count + 1))
    return ", ".join([*out, f"e AS ({rows})"])
