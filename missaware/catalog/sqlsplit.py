"""SQL text of the split search, for the DuckDB oracles.

It spells out the same computation as ``missaware.operators.splits`` in plain ANSI SQL
(CTEs, GROUP BY, window functions), with the same operator order so floating-point results
agree bit for bit.  Used only by ``oracle_sql()``.
"""

from __future__ import annotations


def lit(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def long_sql(src: str, features: list[str], node: str = "1", weight: str = "1.0", masked: bool = True, tree: str = "0") -> str:
    parts = []
    for i, f in enumerate(features):
        m = f"missing_{f}" if masked else "0"
        parts.append(
            f"SELECT {tree} AS t, {node} AS node, {i} AS f, '{f}' AS fname, CAST({f} AS DOUBLE) AS v, "
            f"{m} AS m, label AS y, CAST({weight} AS DOUBLE) AS w FROM {src}"
        )
    return "\nUNION ALL ".join(parts)


def hist_sql(src: str, k: int) -> str:
    cls = ", ".join(f"sum(CASE WHEN y = {c} THEN w ELSE 0.0 END) AS c{c}" for c in range(k))
    return (
        f"SELECT t, node, f, fname, v, count(*) AS cnt, sum(w) AS wt, {cls}, sum(w * m) AS mw "
        f"FROM {src} GROUP BY t, node, f, fname, v"
    )


def cum_sql(src: str, k: int) -> str:
    part = "PARTITION BY t, node, f"
    run = f"OVER ({part} ORDER BY v ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = f"OVER ({part})"
    cols = [f"sum(cnt) {run} AS nl", f"sum(wt) {run} AS wl"]
    cols += [f"sum(c{c}) {run} AS l{c}" for c in range(k)]
    cols += [f"sum(cnt) {whole} AS n", f"sum(wt) {whole} AS W"]
    cols += [f"sum(c{c}) {whole} AS C{c}" for c in range(k)]
    cols += [f"sum(mw) {whole} AS MW", f"lead(v) OVER ({part} ORDER BY v ASC NULLS LAST) AS nxt"]
    return f"SELECT t, node, f, fname, v, {', '.join(cols)} FROM {src}"


def _sum(terms: list[str]) -> str:
    return " + ".join(terms)


def score_sql(criterion: str, k: int) -> str:
    if criterion == "gini":
        sq_l = _sum([f"l{c} * l{c}" for c in range(k)])
        sq_r = _sum([f"r{c} * r{c}" for c in range(k)])
        return f"(({sq_l}) / wl + ({sq_r}) / wr) / (wl + wr) - 1.0"
    def ent(side: str, tot: str) -> str:
        terms = [f"CASE WHEN {side}{c} > 0 THEN -({side}{c} / {tot}) * log2({side}{c} / {tot}) ELSE 0.0 END" for c in range(k)]
        return "(" + _sum(terms) + ")"

    return f"-(wl * {ent('l', 'wl')} + wr * {ent('r', 'wr')}) / (wl + wr)"


def cand_sql(src: str, k: int, criterion: str = "gini", threshold: str = "midpoint", near_equal: tuple[float, float] | None = None) -> str:
    rs = ", ".join(f"C{c} - l{c} AS r{c}" for c in range(k))
    ls = ", ".join(f"l{c}" for c in range(k))
    thr = "(v + nxt) / 2.0" if threshold == "midpoint" else "v"
    cond = "nxt IS NOT NULL AND v IS NOT NULL AND wl > 0 AND W - wl > 0"
    if near_equal is not None:
        rtol, atol = near_equal
        cond += f" AND abs(v - nxt) > {lit(atol)} + {lit(rtol)} * abs(nxt)"
    inner = (
        f"SELECT t, node, f, fname, v, {thr} AS thr, MW / W AS share, nl, wl, {ls}, n - nl AS nr, "
        f"W - wl AS wr, {rs}, n, W, MW FROM {src} WHERE {cond}"
    )
    return f"SELECT *, {score_sql(criterion, k)} AS s FROM ({inner}) q"


def rank_digits(criterion: str) -> int:
    return 12 if criterion == "gini" else 9


def best_sql(src: str, alpha: float | str, criterion: str = "gini", per_feature: bool = False) -> str:
    part = "t, node, f" if per_feature else "t, node"
    d = rank_digits(criterion)
    penalty = alpha if isinstance(alpha, str) else lit(alpha)
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round(ps, {d}) DESC, f ASC, thr ASC) AS rk "
        f"FROM (SELECT *, s - {penalty} * share AS ps FROM {src}) p) r WHERE rk = 1"
    )


def chain(src: str, features: list[str], k: int, alpha: float, criterion: str = "gini", node: str = "1", weight: str = "1.0", prefix: str = "", per_feature: bool = False, tree: str = "0", threshold: str = "midpoint") -> str:
    """CTE definitions ``{prefix}long .. {prefix}best`` (comma separated, no WITH)."""
    p = prefix
    return ",\n".join(
        [
            f"{p}long AS ({long_sql(src, features, node=node, weight=weight, tree=tree)})",
            f"{p}hist AS ({hist_sql(p + 'long', k)})",
            f"{p}cum AS ({cum_sql(p + 'hist', k)})",
            f"{p}cand AS ({cand_sql(p + 'cum', k, criterion, threshold)})",
            f"{p}best AS ({best_sql(p + 'cand', alpha, criterion, per_feature)})",
        ]
    )


def argmax_sql(cols: list[str]) -> str:
    """Index of the largest column; a tie goes to the smallest index."""
    k = len(cols)
    branches = []
    for i in range(k - 1):
        conds = [f"{cols[i]} >= {cols[j]}" for j in range(k) if j > i]
        conds += [f"{cols[i]} > {cols[j]}" for j in range(i)]
        branches.append(f"WHEN {' AND '.join(conds)} THEN {i}")
    return f"CAST(CASE {' '.join(branches)} ELSE {k - 1} END AS INTEGER)"


def _open_sql(prefix: str, k: int) -> str:
    """True when the side has weight in at least two classes (not pure)."""
    return "(" + " + ".join(f"CASE WHEN {prefix}{c} > 0 THEN 1 ELSE 0 END" for c in range(k)) + ") > 1"


def fit_sql(
    prep_sql: str,
    features: list[str],
    k: int,
    alpha: float,
    depth: int,
    criterion: str = "gini",
    weight: str = "1.0",
    trees_sql: str | None = None,
    class_weights: bool = False,
    threshold: str = "midpoint",
) -> str:
    """Whole level-wise fit as one SQL statement returning the node table
    (with ``weight_<k>`` class-weight columns when ``class_weights``).

    ``trees_sql``: a SELECT giving ``t`` and ``w`` for each (prep row, tree) with positive
    weight (forests); default one tree with weight ``weight``.
    """
    value_of = "CASE b.fname " + " ".join(f"WHEN '{f}' THEN p.{f}" for f in features) + " END"
    ctes = []
    if trees_sql is None:
        ctes.append(f"prep0 AS (SELECT *, CAST({weight} AS DOUBLE) AS w, 0 AS t, 1 AS node FROM ({prep_sql}) q)")
    else:
        ctes.append(f"prep0 AS (SELECT *, 1 AS node FROM ({trees_sql}) q)")
    cls = ", ".join(f"sum(CASE WHEN label = {c} THEN w ELSE 0.0 END) AS c{c}" for c in range(k))
    ctes.append(f"root AS (SELECT t, count(*) AS n, sum(w) AS w, {cls} FROM prep0 GROUP BY t)")
    ctes.append(
        f"open0 AS (SELECT p.* FROM prep0 p JOIN root r ON p.t = r.t WHERE {_open_sql('r.c', k)})"
    )
    for d in range(depth):
        ctes.append(chain(f"open{d}", features, k, alpha, criterion, node="node", weight="w", prefix=f"l{d}_", tree="t", threshold=threshold))
        if d + 1 < depth:
            ctes.append(
                f"side{d + 1} AS (SELECT p.* EXCLUDE (node), 2 * p.node + CASE WHEN {value_of} <= b.thr THEN 0 ELSE 1 END AS node, "
                f"{_open_sql('b.l', k)} AS lopen, {_open_sql('b.r', k)} AS ropen "
                f"FROM open{d} p JOIN l{d}_best b ON p.t = b.t AND p.node = b.node)"
            )
            ctes.append(
                f"open{d + 1} AS (SELECT * EXCLUDE (lopen, ropen) FROM side{d + 1} "
                f"WHERE (node % 2 = 0 AND lopen) OR (node % 2 = 1 AND ropen))"
            )
    argmax_root = argmax_sql([f"r.c{c}" for c in range(k)])
    parts = [
        f"SELECT CAST(r.t AS BIGINT) AS tree, CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth, b.fname AS feature, "
        f"b.thr AS threshold, CAST(r.n AS BIGINT) AS n, r.w AS weight, CAST({argmax_root} AS BIGINT) AS prediction, "
        f"round(b.ps, 6) AS score, round(b.share, 6) AS missing_share, b.fname IS NULL AS is_leaf"
        + "".join(f", r.c{c} AS weight_{c}" for c in range(k) if class_weights)
        + " FROM root r LEFT JOIN l0_best b ON r.t = b.t AND b.node = 1"
    ]
    for d in range(depth):
        lcols = ", ".join(f"l{c} AS c{c}" for c in range(k))
        rcols = ", ".join(f"r{c} AS c{c}" for c in range(k))
        kids = (
            f"SELECT t, 2 * node AS node, nl AS n, wl AS w, {lcols} FROM l{d}_best "
            f"UNION ALL SELECT t, 2 * node + 1 AS node, nr AS n, wr AS w, {rcols} FROM l{d}_best"
        )
        am = argmax_sql([f"c.c{c}" for c in range(k)])
        if d + 1 < depth:
            nb, join = "nb", f"LEFT JOIN l{d + 1}_best nb ON c.t = nb.t AND c.node = nb.node"
            feat = "nb.fname, nb.thr, round(nb.ps, 6), round(nb.share, 6), nb.fname IS NULL"
        else:
            join = ""
            feat = "CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), true"
        parts.append(
            f"SELECT CAST(c.t AS BIGINT), CAST(c.node AS BIGINT), CAST({d + 1} AS BIGINT), "
            + feat.split(", ")[0] + ", " + feat.split(", ")[1]
            + f", CAST(c.n AS BIGINT), c.w, CAST({am} AS BIGINT), "
            + ", ".join(feat.split(", ")[2:])
            + "".join(f", c.c{c}" for c in range(k) if class_weights)
            + f" FROM ({kids}) c {join}"
        )
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


def walk_sql(prep_sql: str, tree_sql: str, features: list[str], depth: int, where: str = "true") -> str:
    """CTEs ``prep``, ``nodes`` and ``at0`` .. ``at<depth>``: every row (where ``where`` holds for row
    ``p`` and tree ``t``) with the leaf it reaches in every tree and whether it tested a missing value."""
    value = "CASE t.feature " + " ".join(f"WHEN '{f}' THEN r.{f}" for f in features) + " END"
    flag = "CASE t.feature " + " ".join(f"WHEN '{f}' THEN r.missing_{f}" for f in features) + " ELSE 0 END"
    out = (
        f"prep AS ({prep_sql}), nodes AS ({tree_sql}), "
        f"at0 AS (SELECT p.*, t.tree, CAST(1 AS BIGINT) AS leaf, 0 AS miss FROM prep p, (SELECT DISTINCT tree FROM nodes) t WHERE {where})"
    )
    for d in range(depth):
        out += (
            f", at{d + 1} AS (SELECT r.* EXCLUDE (leaf, miss), CASE WHEN t.is_leaf THEN r.leaf WHEN {value} <= t.threshold THEN 2 * r.leaf ELSE 2 * r.leaf + 1 END AS leaf, "
            f"greatest(r.miss, {flag}) AS miss FROM at{d} r JOIN nodes t ON r.tree = t.tree AND r.leaf = t.node)"
        )
    return out
