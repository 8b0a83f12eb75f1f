"""SQL fragments of the derived tables, shared by the result statements."""

from __future__ import annotations

import re

ACT = """(CASE WHEN smoker = 'yes'
  THEN (3038.0 + age*59.0 + greatest(bmi-25.0,0.0)*118.2 + children*675.0 + greatest(bmi-25.0,0.0)*age*8.0)*3.5
  ELSE 3038.0 + age*59.0 + greatest(bmi-25.0,0.0)*118.2 + children*675.0 END
  * CASE region WHEN 'northeast' THEN 1.05 WHEN 'southeast' THEN 1.02 WHEN 'northwest' THEN 0.97 ELSE 1.0 END)"""


def blend_sql(ml="ml_pred", act="act_pred", threshold="7500.0", ratio="0.70", window="1000.0"):
    weight = f"""CASE WHEN {ml}*0.5+{act}*0.5 >= {threshold} THEN 1.0
      WHEN {act} <= {threshold}-{window} THEN {ratio}
      ELSE {ratio} + (1.0-{ratio})*(({act}-({threshold}-{window}))/{window}) END"""
    return f"greatest(least(({weight})*{ml} + (1.0-({weight}))*{act}, {ml}*1.10), {ml}*0.75)"


CTES = {
    "per_customer": (
        "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey"),
    "policy_base": """SELECT c_custkey AS policy_id, CAST(18 + (c_custkey * 37) % 63 AS INT) AS age,
      CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
      16.0 + ((c_custkey * 7919) % 3100) / 100.0 AS bmi,
      CAST(coalesce(n_orders, 0) % 6 AS INT) AS children,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'yes' ELSE 'no' END AS smoker,
      CASE n_regionkey % 4 WHEN 0 THEN 'northeast' WHEN 1 THEN 'northwest'
        WHEN 2 THEN 'southeast' ELSE 'southwest' END AS region, c_acctbal
      FROM customer LEFT JOIN per_customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "policies": """SELECT policy_id, age, sex, bmi, children, smoker, region,
      greatest(1121.0, (1500.0 + 95.0*age + 60.0*greatest(bmi - 25.0, 0.0) + 400.0*children)
       * CASE WHEN smoker = 'yes' THEN 3.4 ELSE 1.0 END + 0.12*c_acctbal) AS charges FROM policy_base""",
    "learned": "SELECT *, charges * (0.70 + ((policy_id*13) % 61)/100.0) AS ml_pred FROM policies",
    "rated": f"SELECT *, {ACT} AS act_pred FROM learned",
    "priced": f"SELECT *, {blend_sql()} AS hybrid_pred FROM rated",
    "scored": "SELECT policy_id, charges AS y_true, ml_pred, act_pred, hybrid_pred FROM priced",
    "raw_records": """SELECT policy_id,
      CASE WHEN policy_id % 29 = 0 THEN 'abc' WHEN policy_id % 41 = 0 THEN '130' WHEN policy_id % 47 = 0 THEN '25.7' ELSE CAST(age AS VARCHAR) END AS age,
      CASE WHEN policy_id % 31 = 0 THEN ' MALE ' ELSE sex END AS sex,
      CASE WHEN policy_id % 23 = 0 THEN NULL ELSE printf('%.2f', bmi) END AS bmi,
      CASE WHEN policy_id % 43 = 0 THEN '21' WHEN policy_id % 53 = 0 THEN '2.9' ELSE CAST(children AS VARCHAR) END AS children, smoker,
      CASE WHEN policy_id % 37 = 0 THEN 'north' ELSE region END AS region FROM policies""",
    "duplicated": """SELECT * FROM policies UNION ALL
      SELECT policy_id + 1000000000000, age, sex, bmi, children, smoker, region, charges
      FROM policies WHERE smoker = 'yes'""",
    "noted": """SELECT *, CASE policy_id % 11 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN '-5' WHEN 2 THEN 'cmd|calc'
      WHEN 3 THEN ' @home' WHEN 4 THEN 'Use PowerShell now' WHEN 5 THEN '  ' WHEN 6 THEN NULL
      ELSE 'renewal' END AS note FROM policies""",
    "requests": "SELECT event_id, ts, event_type, value AS latency, event_type <> 'error' AS ok, event_type = 'signup' AS rejected FROM events",
    "shifted": """SELECT policy_id, age + 3 AS age, sex, bmi, children, smoker,
      CASE WHEN policy_id % 4 = 0 THEN 'southeast' ELSE region END AS region, charges FROM policies""",
    "stacked": """SELECT policy_id, 'ml' AS model, y_true, ml_pred AS price FROM scored
      UNION ALL SELECT policy_id, 'hybrid', y_true, hybrid_pred FROM scored""",
    "priced_econ": """SELECT *, price - y_true AS error,
      CASE WHEN y_true > 0 THEN (price - y_true)/y_true ELSE 0.0 END AS share, price*1.15 AS revenue,
      price - y_true + 0.15*price - 25.0 AS gross_profit FROM stacked""",
    "churned": """SELECT *, CASE WHEN error > 0 THEN least(greatest(share-0.40,0.0), 0.80) ELSE 0.0 END AS churn_probability,
      CASE WHEN error < 0 THEN least(abs(error)*0.3, revenue*0.2)
        + CASE WHEN abs(share) > 0.5 THEN 200.0 ELSE 0.0 END ELSE 0.0 END AS underpricing_penalty,
      CASE WHEN abs(share) <= 0.15 THEN 150.0 WHEN abs(share) <= 0.30 THEN 75.0 ELSE 0.0 END AS accuracy_bonus
      FROM priced_econ""",
    "costed": "SELECT *, churn_probability*(y_true*1.5 + 200.0) AS churn_cost FROM churned",
    "economics": """SELECT *, gross_profit - churn_cost - underpricing_penalty + accuracy_bonus AS net_profit,
      abs(share) <= 0.30 AS accurate FROM costed""",
}


def _needs(text: str, extra: dict) -> set[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", text))
    return {n for n in list(CTES) + list(extra) if n in words}


def with_ctes(body: str, **extra: str) -> str:
    """Prefix a statement with exactly the derived tables it names, in order.

    A body that starts with a comma adds tables of its own before its SELECT.
    """
    pool = {**CTES, **extra}
    wanted: list[str] = []

    def add(name: str):
        if name in wanted:
            return
        for n in _needs(pool[name], extra):
            if n != name:
                add(n)
        wanted.append(name)

    roots = _needs(body, extra)
    for n in roots:
        add(n)
    if not wanted:
        body = body.lstrip()
        return "WITH " + body[1:] if body.startswith(",") else body
    head = "WITH " + ",\n".join(f"{n} AS ({pool[n]})" for n in wanted)
    body = body.lstrip()
    return head + ("" if body.startswith(",") else "\n") + body
