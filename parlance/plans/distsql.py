"""Oracle SQL of the dataset distances N02-N05: power steps and a matrix
square root (Newton-Schulz) as joins over (i, j, v) tables."""

from __future__ import annotations

EPS = 2.220446049250313e-16
ROOT_STEPS = 45  # Newton-Schulz steps; the least eigenvalue gains 9/4 a step


def cells(emb: str, standardise: bool) -> str:
    """x (vec_id, domain, i, v); with one mean and deviation over all cells of
    both domains, if asked for."""
    raw = f"raw AS (SELECT vec_id, domain, unnest(features) AS v, unnest(range(len(features))) AS i FROM emb)"
    if not standardise:
        return f"WITH {emb}, {raw}, x AS MATERIALIZED (SELECT * FROM raw)"
    return (f"WITH {emb}, {raw}, mu AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM raw), "
            "x AS MATERIALIZED (SELECT vec_id, domain, i, (v - m) / sd AS v FROM raw, mu)")


def power(emb: str, standardise: bool, steps: int = 20) -> str:
    """Growth of the last of ``steps`` power steps on the difference of the
    domains' Gram matrices, from the vector of ones."""
    out = [cells(emb, standardise), """g AS MATERIALIZED (SELECT a.i, b.i AS j, avg(CASE WHEN a.domain = 0 THEN a.v * b.v END)
  - avg(CASE WHEN a.domain <> 0 THEN a.v * b.v END) AS m FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.i, b.i)""",
           "v0 AS (SELECT DISTINCT i, 1.0 AS v FROM x)"]
    for k in range(steps):
        out.append(f"w{k} AS MATERIALIZED (SELECT g.i, sum(m * v) AS v FROM g JOIN v{k} ON v{k}.i = g.j GROUP BY g.i)")
        out.append(f"v{k + 1} AS MATERIALIZED (SELECT i, v / ((SELECT max(abs(v)) FROM w{k}) + {EPS!r}) AS v FROM w{k})")
    return ",\n".join(out) + f"\nSELECT max(abs(v)) / {{d}} AS value FROM w{steps - 1}".replace("{d}", "(SELECT count(*) FROM v0)" if standardise else "1")


def _times(a: str, b: str) -> str:
    return f"(SELECT p.i, q.j, sum(p.v * q.v) AS v FROM {a} p JOIN {b} q ON p.j = q.i GROUP BY p.i, q.j)"


def frechet(emb: str, standardise: bool) -> str:
    """‖μs − μt‖² + tr(Σs) + tr(Σt) − 2 tr((Σs Σt)^½)."""
    out = [cells(emb, standardise),
           "c AS MATERIALIZED (SELECT a.domain, a.i, b.i AS j, covar_samp(a.v, b.v) AS v FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.domain, a.i, b.i)",
           "cs AS (SELECT i, j, v FROM c WHERE domain = 0), ct AS (SELECT i, j, v FROM c WHERE domain = 1)",
           f"a AS MATERIALIZED {_times('cs', 'ct')}", "s AS (SELECT sqrt(sum(v * v)) AS f FROM a)",
           "y0 AS MATERIALIZED (SELECT i, j, v / f AS v FROM a, s)", "z0 AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM a)"]
    for k in range(ROOT_STEPS):
        out.append(f"t{k} AS MATERIALIZED (SELECT i, j, (CASE WHEN i = j THEN 3.0 ELSE 0.0 END - v) / 2 AS v FROM {_times(f'z{k}', f'y{k}')})")
        out.append(f"y{k + 1} AS MATERIALIZED {_times(f'y{k}', f't{k}')}")
        out.append(f"z{k + 1} AS MATERIALIZED {_times(f't{k}', f'z{k}')}")
    means = "(SELECT sum((ms - mt) * (ms - mt)) FROM (SELECT avg(CASE WHEN domain = 0 THEN v END) AS ms, avg(CASE WHEN domain <> 0 THEN v END) AS mt FROM x GROUP BY i))"
    trace = f"(SELECT sum(v) FROM c WHERE i = j) - 2 * (SELECT sum(v) FROM y{ROOT_STEPS} WHERE i = j) * (SELECT sqrt(f) FROM s)"
    return ",\n".join(out) + f"\nSELECT ({means} + {trace}) / " + ("(SELECT max(i) + 1 FROM x)" if standardise else "1") + " AS value"
