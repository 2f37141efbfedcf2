"""Rows of all seven reporting domains: projected, compared on every key, written out and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan import contracts as C
from factspan.operators import history, reporting
from factspan.plans import controls
from factspan.queries.base import query, table
from factspan.session import stage

_SQL_KINDS = {"string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
              "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _cell(position: int, name: str, kind: str, sql: bool) -> str:
    """A value of order ``k`` for a column: null in one row of eleven, else of a few kinds."""
    text = {
        "string": f"'{name}-' || ((k + {position}) % 5)" if sql else f"concat('{name}-', cast((k + {position}) % 5 as string))",
        "double": f"((k + {position}) % 7) / 2.0",
        "date": f"(DATE '2020-01-01' + ((k + {position}) % 9)::INTEGER)" if sql
        else f"date_add(DATE '2020-01-01', cast((k + {position}) % 9 as int))",
        "boolean": f"(k + {position}) % 2 = 0",
        "timestamp": "TIMESTAMP '2024-01-01 00:00:00'",
        "timestamp_ntz": "TIMESTAMP '2024-01-01 00:00:00'",
    }[kind]
    return f"CASE WHEN (k + {position}) % 11 <> 0 THEN {text} END"


def _fixed(domain: str, sql: bool) -> dict[str, str]:
    number = "CAST(k AS VARCHAR)" if sql else "cast(k as string)"
    return {
        "domain": f"'{domain}'", "observation_id": f"concat('o', {number})", "fact_id": f"concat('f', {number})",
        "release_id": f"concat('r', {number.replace('k', 'k % 3')})",
    }


def _columns(domain: str, sql: bool) -> dict[str, str]:
    fixed = _fixed(domain, sql)
    fields = C.domain_schema(domain).fields
    return {
        f.name: fixed.get(f.name) or _cell(i, f.name, f.dataType.simpleString(), sql) for i, f in enumerate(fields)
    }


def domain_batches(spark, sf_dir) -> dict[str, DataFrame]:
    """A seventh of all orders dressed as rows of each domain, written out and read back."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    out = {}
    for number, domain in enumerate(sorted(C.DOMAIN_LAYOUT)):
        kinds = {f.name: f.dataType for f in C.domain_schema(domain).fields}
        rows = orders.where(F.col("k") % len(C.DOMAIN_LAYOUT) == number)
        cells = [F.expr(e).cast(kinds[n]).alias(n) for n, e in _columns(domain, False).items()]
        out[domain] = stage(rows.select(*cells), f"rows-{domain}")
    return out


def _json_sql(domain: str) -> str:
    cells, kinds = _columns(domain, True), {f.name: f.dataType.simpleString() for f in C.domain_schema(domain).fields}
    parts = []
    for name in sorted(C.DISPLAY_DIMENSIONS[domain]):
        value = f"CAST(CAST(({cells[name]}) AS {_SQL_KINDS[kinds[name]]}) AS VARCHAR)"
        quoted = f"'\"' || {value} || '\"'" if kinds[name] in ("string", "date") else value
        parts.append(f"'\"{name}\":' || coalesce({quoted}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _long_sql() -> str:
    parts = []
    for number, domain in enumerate(sorted(C.DOMAIN_LAYOUT)):
        value = _columns(domain, True)["value"]
        parts.append(
            f"SELECT '{domain}' AS projected_domain, 'o' || k AS observation_id, 'r' || (k % 3) AS release_id, "
            f"CAST({value} AS DOUBLE) AS value, {_json_sql(domain)} AS display_dimensions "
            f"FROM (SELECT o_orderkey AS k FROM orders) WHERE k % {len(C.DOMAIN_LAYOUT)} = {number}"
        )
    return " UNION ALL ".join(parts)


@query(_long_sql())
def project_all_domains(spark, sf_dir):
    long = reporting.project_long(domain_batches(spark, sf_dir))
    return long.select("projected_domain", "observation_id", "release_id", "value", "display_dimensions")


def _lists_sql() -> str:
    rows = []
    for domain, layout in C.DOMAIN_LAYOUT.items():
        shown = list(C.DISPLAY_DIMENSIONS[domain])
        omitted = [n for n in layout.fieldNames() if n not in shown]
        rows.append(f"('{domain}', '{','.join(shown)}', '{','.join(omitted)}')")
    return ", ".join(rows)


@query(f"""
WITH long AS ({_long_sql()}), lists(d, shown, omitted) AS (VALUES {_lists_sql()})
SELECT projected_domain, count(DISTINCT release_id) AS releases, count(*) AS rows, any_value(shown) AS shown,
       any_value(omitted) AS omitted FROM long JOIN lists ON d = projected_domain GROUP BY 1
""")
def projection_of_all_domains(spark, sf_dir):
    """Shown and left-out dimensions of every domain by name, with its releases and rows."""
    found = reporting.projection_metadata(reporting.project_long(domain_batches(spark, sf_dir)))
    return found.select(
        "projected_domain", "releases", "rows", F.array_join("selected_dimensions", ",").alias("shown"),
        F.array_join("omitted_dimensions", ",").alias("omitted"),
    )


@query(f"WITH long AS ({_long_sql()}) SELECT DISTINCT projected_domain, release_id FROM long")
def source_releases(spark, sf_dir):
    return reporting.source_releases(reporting.project_long(domain_batches(spark, sf_dir)))


@query(f"""
WITH long AS ({_long_sql()} UNION ALL SELECT projected_domain, observation_id, release_id, value, display_dimensions
              FROM ({_long_sql()}) WHERE projected_domain = 'demographic')
SELECT observation_id, count(*) AS rows FROM long GROUP BY 1 HAVING count(*) > 1
""")
def repeated_observations(spark, sf_dir):
    """Observations given twice: one domain's rows come in again."""
    batches = domain_batches(spark, sf_dir)
    long = reporting.project_long(batches)
    again = reporting.project_domain(batches["demographic"], "demographic")
    return reporting.repeated_observations(history.strict_union(long, again))


# --- birth comparison on every key ----------------------------------------------


def _birth_key(sql: bool) -> dict[str, str]:
    """Every column of the comparison key as text of order ``k``; the commune tells the rows apart."""
    kinds = {f.name: f.dataType.simpleString() for f in C.domain_schema("demographic").fields}
    cells = {n: _cell(i, n, kinds[n], sql) for i, n in enumerate(C.COMPARISON_KEY)}
    month = "DATE '2020-01-01' + INTERVAL 1 MONTH * ((k % 24)::INTEGER + {})" if sql else "add_months(DATE '2020-01-01', cast(k % 24 + {} as int))"
    number = "CAST(k AS VARCHAR)" if sql else "cast(k as string)"
    return {
        **cells, "variable": "'births'", "semantic_kind": "'count'", "unit": "'event'", "date_basis": "'birth_occurrence_month'",
        "period_start": month.format(0), "period_end": month.format(1), "commune": f"concat('c', {number})",
    }


def _births_sql(side: str, value: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in C.domain_schema("demographic").fields}
    listed = ", ".join(f"CAST(({e}) AS {_SQL_KINDS[kinds[n]]}) AS {n}" for n, e in _birth_key(True).items())
    return f"{side} AS (SELECT {listed}, CAST({value} AS DOUBLE) AS value FROM (SELECT o_orderkey AS k FROM orders))"


@query(f"""
WITH {_births_sql('counted', 'k % 13')}, {_births_sql('published', 'k % 13 + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END')}
SELECT c.commune, c.period_start, c.value AS counted_value, p.value AS control_value, c.value - p.value AS difference,
       CASE WHEN c.value = p.value THEN 'matched_coyuntural' ELSE 'different_coyuntural' END AS status
FROM counted c JOIN published p ON {" AND ".join(f"c.{n} IS NOT DISTINCT FROM p.{n}" for n in C.COMPARISON_KEY)}
""")
def births_on_every_key(spark, sf_dir):
    """Counted against published births on all 32 columns that tell a cell apart, null or not."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    kinds = {f.name: f.dataType for f in C.domain_schema("demographic").fields}

    def side(value, role, parity):
        key = [F.expr(e).cast(kinds[n]).alias(n) for n, e in _birth_key(False).items()]
        fixed = {"observation_role": F.lit(role), "parity_scope": F.lit(parity), "provisional": F.lit(True)}
        rows = orders.select(*key, value.cast("double").alias("value"), *[c.alias(n) for n, c in fixed.items()])
        return stage(rows, "births")

    counted = side(F.col("k") % 13, "observed_fact", "unknown_order")
    changed = F.col("k") % 13 + F.when(F.col("k") % 17 == 0, 1).otherwise(0)
    found = controls.compare_births(counted, side(changed, "diagnostic_control", "all_orders"), "coyuntural_monthly")
    return found.select("commune", "period_start", "counted_value", "control_value", "difference", "status")
