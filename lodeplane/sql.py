"""Read-only SQL over named tables, guarded by the parsed plan instead of by patterns on the text."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MAX_LENGTH, DEFAULT_LIMIT, MAX_LIMIT = 4000, 100, 1000
#: Functions that reach outside of the tables (fixed values).
DENIED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "read_files", "python_udf"}


@dataclass
class SqlResult:
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    truncated: bool = False
    error: str | None = None
    hint: str | None = None


class Refused(ValueError):
    pass


def _walk(node):
    yield node
    for get in ("children", "innerChildren"):
        seq = getattr(node, get)()
        for i in range(seq.size()):
            yield from _walk(seq.apply(i))


def _expressions(node):
    seq = node.expressions()
    for i in range(seq.size()):
        yield from _walk(seq.apply(i))


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of the tables a statement reads, without its own common table expressions. Raises on anything but a query."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001
        raise Refused(f"cannot be parsed: {str(e).splitlines()[0][:200]}") from None
    named, own = set(), set()
    todo = [plan]
    while todo:
        for node in _walk(todo.pop()):
            kind = node.getClass().getSimpleName()
            full = node.getClass().getName()
            if "UnresolvedWith" in kind:
                seq = node.cteRelations()
                for i in range(seq.size()):
                    own.add(seq.apply(i)._1().lower())
            elif kind == "UnresolvedRelation":
                named.add(node.tableName().lower())
            elif kind in ("UnresolvedTableValuedFunction", "UnresolvedTVF"):
                raise Refused("table functions are not allowed")
            elif ".command." in full or kind.endswith(("Command", "Statement")) or kind.startswith(("Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Truncate", "Set", "Show", "Describe", "Refresh", "Cache", "Uncache", "Analyze", "Repair", "Replace", "Load", "Use")) and not kind.startswith(("SetOperation",)):
                raise Refused("only queries are allowed")
            if hasattr(node, "expressions"):
                try:
                    for e in _expressions(node):
                        name = e.getClass().getSimpleName()
                        if name == "UnresolvedFunction" and e.nameParts().mkString(".").lower() in DENIED_FUNCTIONS:
                            raise Refused(f"function {e.nameParts().mkString('.')} is not allowed")
                        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery"):
                            for get in ("plan", "query"):
                                try:
                                    inner = getattr(e, get)()
                                    todo.append(inner.plan() if inner.getClass().getSimpleName() == "ListQuery" else inner)
                                    break
                                except Refused:
                                    raise
                                except Exception:  # noqa: BLE001
                                    continue
                            else:
                                raise Refused("a subquery cannot be checked")
                except Refused:
                    raise
                except Exception as e:  # noqa: BLE001
                    raise Refused(f"an expression cannot be checked: {str(e).splitlines()[0][:100]}") from None
    return named - own


def guarded(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The DataFrame of a query over the given tables; raises ``Refused`` with the reason otherwise."""
    if not isinstance(sql, str) or not sql.strip():
        raise Refused("the query is empty")
    if len(sql) > MAX_LENGTH:
        raise Refused(f"the query is longer than {MAX_LENGTH} characters")
    text = re.sub(r";\s*$", "", sql.strip())
    used = relations(spark, text)
    allowed = {n.lower() for n in tables}
    if bad := sorted(used - allowed):
        raise Refused(f"table {bad[0]} is not allowed; allowed are {', '.join(sorted(allowed))}")
    for name in used:
        next(df for n, df in tables.items() if n.lower() == name).createOrReplaceTempView(name)
    return spark.sql(text)


def safe_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], limit: int = DEFAULT_LIMIT) -> SqlResult:
    """Run a guarded query and collect at most ``limit`` rows (1 to 1000), saying whether there were more; never raises."""
    cap = min(MAX_LIMIT, max(1, limit))
    try:
        df = guarded(spark, sql, tables)
        rows = df.limit(cap + 1).collect()
        return SqlResult(df.columns, [r.asDict(True) for r in rows[:cap]], len(rows) > cap)
    except Refused as e:
        return SqlResult(error=str(e), hint="Only SELECT and WITH over the listed tables are allowed.")
    except Exception as e:  # noqa: BLE001
        return SqlResult(error=str(e).splitlines()[0][:300], hint="Check the names of columns with describe().")


def describe(tables: Mapping[str, DataFrame]) -> list[dict]:
    """Columns and types of the tables."""
    return [{"table": n, "column": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for n, df in tables.items() for f in df.schema.fields]
