"""Oracle SQL of the linear boosting operators on one feature of the
embeddings (x, label y, domain): each round's fit is a closed form (weighted
least squares) or a fixed number of unrolled Newton steps (logistic)."""

from __future__ import annotations

ROUNDS = 6
STEPS = 12  # Newton steps a fit; it settles in fewer
EPS = 2.220446049250313e-16

EMB = """e AS (SELECT vec_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS dom, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) AS s FROM embeddings),
z AS (SELECT vec_id, dom, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, {y} AS y, count(*) OVER () AS n FROM e)"""


def _rows(binary: bool) -> str:
    return "WITH " + EMB.format(y="CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END" if binary else "s")


def _newton(name: str, rows: str, start: str) -> str:
    """CTEs ``name``_0 .. ``name``_STEPS of (b0, b1) for rows (x, y, w)."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT CAST(b0 AS DOUBLE) AS b0, CAST(b1 AS DOUBLE) AS b1 FROM {start})"]
    for k in range(STEPS):
        out.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0,
  b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM (
  SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(w * (p - y)) AS g0, sum(w * (p - y) * x) + any_value(b1) AS g1,
    sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + 1 AS h11
  FROM (SELECT r.*, b.b0, b.b1, 1 / (1 + exp(-(b.b0 + b.b1 * r.x))) AS p FROM {rows} r, {name}_{k} b)))""")
    return ",\n".join(out)


def _ols(name: str, rows: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT my - mx * c / v AS b0, c / v AS b1 FROM (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my,
  sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * (sum(w * y) / sum(w)) AS c,
  sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w)) AS v FROM {rows}))"""


def logistic_sql() -> str:
    return (_rows(True) + ",\nw0 AS MATERIALIZED (SELECT *, 1.0 AS w FROM z),\n" + _newton("b", "w0", "(SELECT 0 AS b0, 0 AS b1)")
            + f",\nprob AS (SELECT vec_id, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM w0, b_{STEPS})\n")


def tradaboost_sql(binary: bool) -> str:
    """Rounds i: w{i} (rows with weights of mean 1), f{i} (fit), p{i} (rows
    with prediction and error), e{i} (target error and model weight)."""
    out = [_rows(binary), "w0 AS MATERIALIZED (SELECT *, CAST(1.0 AS DOUBLE) AS w FROM z)"]
    beta_s = f"(1 / (1 + sqrt(2 * ln((SELECT count(*) FROM z WHERE dom = 0)) / {ROUNDS})))"
    for i in range(ROUNDS):
        if binary:
            out += [_newton(f"f{i}", f"w{i}", "(SELECT 0 AS b0, 0 AS b1)" if not i else f"f{i - 1}_{STEPS}")]
            fit, p, scale = f"f{i}_{STEPS}", "1 / (1 + exp(-(f.b0 + f.b1 * r.x)))", "1.0"
        else:
            out.append(_ols(f"f{i}", f"w{i}"))
            fit, p, scale = f"f{i}", "f.b0 + f.b1 * r.x", f"max(abs(p - y)) OVER () + {EPS!r}"
        out.append(f"p{i} AS MATERIALIZED (SELECT *, abs(p - y) / ({scale}) AS err FROM (SELECT r.*, {p} AS p FROM w{i} r, {fit} f))")
        out.append(f"""e{i} AS MATERIALIZED (SELECT err, -ln(err / (2 - err) + {EPS!r}) + 2 * {EPS!r} AS a FROM (
  SELECT sum(w * err) / sum(w) AS err FROM p{i} WHERE dom = 1))""")
        if i < ROUNDS - 1:
            out.append(f"""w{i + 1} AS MATERIALIZED (SELECT vec_id, dom, x, y, n, w * n / sum(w) OVER () AS w FROM (
  SELECT vec_id, dom, x, y, n, CASE WHEN dom = 0 THEN w * power({beta_s}, p{i}.err) ELSE w * power(e.err / (2 - e.err), -p{i}.err) END AS w FROM p{i}, e{i} e))""")
    return ",\n".join(out)


def _late() -> str:
    half = ROUNDS // 2
    return " UNION ALL ".join(f"SELECT vec_id, p, a FROM p{i}, e{i}" for i in range(half, ROUNDS))


def vote_sql() -> str:
    return f"""late AS ({_late()}),
vote AS (SELECT vec_id, CASE WHEN sum(p * a) > sum((1 - p) * a) THEN 1 ELSE 0 END AS prediction FROM late GROUP BY vec_id)
"""


def weights_sql() -> str:
    return f"\nSELECT vec_id, dom AS domain, round(w, 6) AS weight FROM w{ROUNDS - 1}"


def median_sql() -> str:
    return f"""late AS ({_late()}),
cum AS (SELECT vec_id, p, sum(a) OVER (PARTITION BY vec_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS c, sum(a) OVER (PARTITION BY vec_id) AS t FROM late),
med AS (SELECT vec_id, min(p) AS prediction FROM cum WHERE c >= 0.5 * t - 1e-12 GROUP BY vec_id)
"""


def fixed_source_sql() -> str:
    """K13 from equal weights: the source keeps its mass, target weights
    times β^(1 − err) are scaled to the rest."""
    out = [_rows(False), "w0 AS MATERIALIZED (SELECT *, CAST(1.0 AS DOUBLE) / n AS w FROM z)",
           "src AS MATERIALIZED (SELECT sum(w) AS m FROM w0 WHERE dom = 0)"]
    for i in range(ROUNDS):
        out.append(_ols(f"f{i}", f"w{i}"))
        out.append(f"p{i} AS MATERIALIZED (SELECT *, abs(p - y) / (max(abs(p - y)) OVER () + {EPS!r}) AS err FROM (SELECT r.*, f.b0 + f.b1 * r.x AS p FROM w{i} r, f{i} f))")
        out.append(f"e{i} AS MATERIALIZED (SELECT sum(w * err) AS err FROM p{i})")
        if i < ROUNDS - 1:
            out.append(f"""t{i} AS MATERIALIZED (SELECT p.vec_id, dom, x, y, n, CASE WHEN dom = 0 THEN w ELSE w * power(e.err / (2 - e.err), 1 - p.err) END AS w FROM p{i} p, e{i} e),
w{i + 1} AS MATERIALIZED (SELECT vec_id, dom, x, y, n, CASE WHEN dom = 0 THEN w ELSE w * (1 - src.m) / (SELECT sum(w) FROM t{i} WHERE dom = 1) END AS w FROM t{i}, src)""")
    rounds = " UNION ALL ".join(f"SELECT {i} AS round, err FROM e{i}" for i in range(ROUNDS))
    out.append(f"rounds AS (SELECT round, err AS error, -ln(err / (2 - err) + {EPS!r}) + 2 * {EPS!r} AS weight FROM ({rounds}))\n")
    return ",\n".join(out)
