"""Reports, actions and the other tables of the model, derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.schema import RULES

BARRIERS = ("Lockout Not Applied", "Gas Testing Not Completed", "Permit Not Obtained", "Fall Protection Missing", "Guard Removed", "Barricade Missing", "Supervision Missing", "PPE Not Worn", "Communication Failure", "Procedure Not Followed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: str, size: int, values: dict[int, str]) -> str:
    return f"CASE {key} % {size} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


#: Column expressions that Spark and DuckDB read alike.
REPORT_EXPRESSIONS = {
    "report_id": "cast(o_orderkey AS {string})",
    "description": "lower(o_orderpriority) || ' work near ' || lower(c_mktsegment) || ' in ' || n_name",
    "site": "r_name",
    "unit": "n_name",
    "area": "c_mktsegment",
    "activity": "o_orderpriority",
    "category": _case("o_orderkey", len(RULES), dict(enumerate(RULES))),
    "barrier_failure": _case("o_orderkey", 14, {**dict(enumerate(BARRIERS)), 10: "Unspecified", 11: "Unknown Barrier Failure", 12: "Unknown"}),
    "risk_score": "cast((o_orderkey * 37) % 101 AS int)",
    "risk_level": "CASE WHEN (o_orderkey * 37) % 101 >= 80 THEN 'CRITICAL' WHEN (o_orderkey * 37) % 101 >= 60 THEN 'HIGH' WHEN (o_orderkey * 37) % 101 >= 30 THEN 'MEDIUM' ELSE 'LOW' END",
    "sif_potential": "CASE (o_orderkey * 7) % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'UNKNOWN' ELSE 'NO' END",
    "created_at": "o_orderdate",
}
ACTION_EXPRESSIONS = {
    "report_id": "cast(l_orderkey AS {string})",
    "line": "l_linenumber",
    "status": "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'OPEN' WHEN l_returnflag = 'R' THEN 'OVERDUE' WHEN l_linestatus = 'O' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END",
    "amount": "l_extendedprice",
}


def _columns(expressions: dict[str, str], dialect: str) -> list[str]:
    return [f"{e.format(string='string' if dialect == 'spark' else 'varchar')} AS {n}" for n, e in expressions.items()]


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' places as reports."""
    read = lambda t: table(spark, sf_dir, t)
    # nation has 25 rows and region 5 by definition, so both may be broadcast.
    places = F.broadcast(read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")))
    joined = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(*_columns(REPORT_EXPRESSIONS, "spark"), "date_format(o_orderdate, 'yyyy-MM-dd') AS date")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_columns(ACTION_EXPRESSIONS, "spark"), "date_format(l_shipdate, 'yyyy-MM-dd') AS deadline")


REPORTS_SQL = "r AS (SELECT " + ", ".join(_columns(REPORT_EXPRESSIONS, "duckdb")) + ", strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
ACTIONS_SQL = "a AS (SELECT " + ", ".join(_columns(ACTION_EXPRESSIONS, "duckdb")) + ", strftime(l_shipdate, '%Y-%m-%d') AS deadline FROM lineitem)"

# Parts of narratives, picked by remainders of the event's id.
FRAGMENTS = (
    (5, ("A contract worker", "The technician", "Two workers", "The supervisor", "An office employee at the desk")),
    (7, ("entered the tank.", "was welding near the pipeline;", "climbed the scaffold", "stopped the entry before any exposure.", "serviced the breaker panel and then", "stood under a suspended load", "didn't stop the forklift")),
    (11, ("without gas testing.", "without a valid permit.", "while LOTO was not applied.", "with no harness.", "after the permit was checked.", "but later entered without isolation.", "not without PPE.", "and maybe the valve leaked.", "and the work was stopped by the supervisor.", "before gas testing.", "with all controls in place.")),
    (3, ("Nobody was injured.", "It is unclear if acid spilled.", "Work continued.")),
)


def _parts(key: str) -> str:
    return " || ' ' || ".join(_case(key, size, {k: v.replace("'", "''") for k, v in enumerate(values)}) for size, values in FRAGMENTS)


NARRATIVE_EXPRESSIONS = {
    "event_id": "event_id",
    "site": "'Site ' || cast(user_id % 5 AS {string})",
    "description": f"CASE WHEN event_id % 97 = 0 THEN 'No permit' WHEN event_id % 89 = 0 THEN NULL ELSE {_parts('event_id')} END",
    "severity": _case("user_id", 5, {0: "Critical", 1: "High", 2: "Medium", 3: "low"}),
    "report_type": _case("user_id", 7, {0: "Near Miss", 1: "Unsafe Act", 2: "Unsafe Condition", 3: "Incident"}),
}


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as free-text reports."""
    return table(spark, sf_dir, "events").selectExpr(*[c.replace("''", r"\'") for c in _columns(NARRATIVE_EXPRESSIONS, "spark")])


NARRATIVES_SQL = "d AS (SELECT " + ", ".join(_columns(NARRATIVE_EXPRESSIONS, "duckdb")) + " FROM events)"
