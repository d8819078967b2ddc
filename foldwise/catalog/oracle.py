"""DuckDB text of the bindings, as named CTEs that a query's oracle text can refer to."""

from __future__ import annotations

import re


def uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 6))::BIGINT / 16777216.0e0)"


def folds_sql(source: str, groups: str, repeat: str, fold: str, target: int, repeats: int, purpose: str) -> str:
    """Plain window formulation of the repeated stratified folds."""
    on = groups
    return f"""
SELECT s.*, r.r AS {repeat},
       CAST((row_number() OVER (PARTITION BY {on}, r.r ORDER BY y, md5({purpose} || '|' || r.r || '|' || id), id) - 1)
            % least({target}, k.minority) + 1 AS INTEGER) AS {fold}
FROM {source} s
JOIN (SELECT {on}, least(sum(y), count(*) - sum(y)) AS minority FROM {source} GROUP BY {on}) k USING ({on})
CROSS JOIN (SELECT unnest(range(1, {repeats} + 1)) AS r) r
WHERE k.minority >= 2"""


CTES: dict[str, str] = {
    "b_sample": """
SELECT c_mktsegment AS cohort, CAST(c_custkey AS VARCHAR) AS id, CAST(c_acctbal > 4500 AS INTEGER) AS y
FROM customer""",
    "b_cust": """
SELECT c_mktsegment AS cohort, CAST(c_custkey AS VARCHAR) AS id, CAST(c_acctbal > 4500 AS INTEGER) AS y,
       CAST(coalesce(n, 0) AS DOUBLE) AS f_orders, spend AS f_spend, top AS f_max, c_acctbal AS f_bal,
       CAST(coalesce(pending, 0) AS DOUBLE) AS f_pending, CAST(NULL AS DOUBLE) AS f_void
FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spend, max(o_totalprice) AS top,
         count(*) FILTER (o_orderstatus = 'P') AS pending
  FROM orders GROUP BY 1) o ON c_custkey = o_custkey""",
    "b_cell": """
SELECT cohort, id, feature,
       CASE WHEN substr(md5('miss' || feature || id), 1, 1) <> '0' THEN value END AS value
FROM (FROM b_cust UNPIVOT INCLUDE NULLS (value FOR feature IN (f_orders, f_spend, f_max, f_bal, f_pending, f_void)))""",
    "b_fold": folds_sql("b_sample", "cohort", "repeat", "outer_fold", 5, 5, "'outer'"),
    "b_pred": f"""
SELECT cohort, scenario, method, id, repeat, outer_fold, y AS y_true,
       round(1 / (1 + exp(-(gain * (y * 2 - 1) + 4.0e0 * ({uniform("'pred|' || scenario || '|' || method || '|' || repeat || '|' || id")} - 0.5e0)))), 4) AS p
FROM b_fold CROSS JOIN (VALUES ('primary', 'nested', 0.3e0), ('primary', 'non_nested', 0.7e0),
                               ('knn', 'nested', 0.25e0), ('knn', 'non_nested', 0.65e0)) m(scenario, method, gain)""",
    "b_hold": f"""
SELECT cohort, id, CAST(split AS INTEGER) AS split, CASE WHEN split = 1 THEN 'fixed' ELSE 'repeated' END AS split_role,
       CASE WHEN rn <= CASE WHEN y = 1 THEN quota1 ELSE test - quota1 END THEN 'test' ELSE 'train' END AS subset,
       y AS y_true,
       round(1 / (1 + exp(-(0.4e0 * (y * 2 - 1) + 4.0e0 * ({uniform("'hold|' || split || '|' || id")} - 0.5e0)))), 4) AS p
FROM (SELECT s.*, split, row_number() OVER (PARTITION BY cohort, split, y ORDER BY md5('holdout|' || split || '|' || id), id) AS rn
      FROM b_sample s CROSS JOIN (SELECT unnest(range(1, 26)) AS split)) x
JOIN (SELECT *, (test * pos) // n + CASE WHEN test - (test * pos) // n - (test * neg) // n > 0
                                          AND (test * pos) % n > (test * neg) % n THEN 1 ELSE 0 END AS quota1
      FROM (SELECT *, (n * 3 + 9) // 10 AS test
            FROM (SELECT cohort, count(*)::BIGINT AS n, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg FROM b_sample GROUP BY 1))) q
USING (cohort)""",
}


def compose(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with exactly the CTEs it needs, in dependency order."""
    pool = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in pool:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(pool[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({pool[name].strip()})" for name in needed)
    recursive = "RECURSIVE " if any("UNION ALL -- recursive" in pool[n] for n in needed) else ""
    return f"WITH {recursive}{ctes}\n{body.strip()}"
