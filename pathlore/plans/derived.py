"""Views that stand in for records which the driver's tables don't have, in DataFrame functions and in SQL.

A reflection is derived from each event by rule: its texts are phrases that the id picks, its
numbers come from the id and the value, and its outcome from the type. Elements of a screen are
derived from the parts, and clicks from the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.session import table

PHRASES = [
    "Click the save button first and then check the dialog",
    "Always be careful and think about the thing",
    "Use cmd shift p instead of the top menu because it was hidden",
    "The agent tried the wrong window and it failed with an error",
    "Open the browser app and navigate to the url of the website",
    "Search the web for flights then open every result",
    "It was observed that the second tab worked successfully",
    "wait here",
    "You should press enter when the exact field is selected",
    "We discovered a workaround: avoid the nested menu since the scroll strategy is effective after loading the whole list",
    "Remind me of the calendar meeting and mail a summary",
    "Type the text in the center of the window, otherwise retry",
    "Ensure the critical element is visible before you drag it",
    "Play some music and check the battery of the system",
    "Launch the terminal application and compile the project",
    "maybe remember this item button",
    "Close all windows and quit",
    "Select the first icon from the dropdown menu if it is there",
    "Capture a screenshot of the desktop",
    "Note that the directory was unexpectedly moved, bypass it due to the lock",
    "Edit the document in the folder and send an email message",
    "",
]
_N = len(PHRASES)


def phrase(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PHRASES)), (i % _N + 1).cast("int"))


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def sql_phrase(i: str) -> str:
    return f"({sql_list(PHRASES)})[({i}) % {_N} + 1]"


TOOLS = ["click", "type", "key", "bash", "scroll"]


def reflections(spark, sf_dir: str) -> DataFrame:
    """(id, session, task, lessons, failures, strategies, tools, outcome, iterations, loops, stagnations, confidence, cost, kind, ts)."""
    i, value = F.col("event_id"), F.col("value")
    none = F.array().cast("array<string>")
    tool = F.array(*map(F.lit, TOOLS))
    return table(spark, sf_dir, "events").select(
        i.alias("id"),
        F.col("user_id").alias("session"),
        phrase(i).alias("task"),
        F.when(i % 11 == 0, none).when(i % 3 == 0, F.array(phrase(i * 7 + 1))).otherwise(F.array(phrase(i * 7 + 1), phrase(i * 13 + 5))).alias("lessons"),
        F.when(i % 2 == 0, F.array(F.lit("x"))).otherwise(none).alias("failures"),
        F.when(i % 5 == 0, F.array(F.lit("y"))).otherwise(none).alias("strategies"),
        F.slice(tool, (i % 4 + 1).cast("int"), (i % 5).cast("int")).alias("tools"),
        F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "unknown").otherwise("success").alias("outcome"),
        (i % 25).alias("iterations"),
        F.when(i % 4 == 0, 1).otherwise(0).alias("loops"),
        F.when(i % 6 == 0, 1).otherwise(0).alias("stagnations"),
        F.least(value / 100, F.lit(1.0)).alias("confidence"),
        (value / 50).alias("cost"),
        F.col("event_type").alias("kind"),
        "ts",
    )


REFLECTIONS = f"""r AS (SELECT event_id AS id, user_id AS session, {sql_phrase("event_id")} AS task,
  CASE WHEN event_id % 11 = 0 THEN []::VARCHAR[] WHEN event_id % 3 = 0 THEN [{sql_phrase("event_id * 7 + 1")}] ELSE [{sql_phrase("event_id * 7 + 1")}, {sql_phrase("event_id * 13 + 5")}] END AS lessons,
  CASE WHEN event_id % 2 = 0 THEN ['x'] ELSE [] END AS failures, CASE WHEN event_id % 5 = 0 THEN ['y'] ELSE [] END AS strategies,
  ({sql_list(TOOLS)})[event_id % 4 + 1 : event_id % 4 + event_id % 5] AS tools,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'unknown' ELSE 'success' END AS outcome, event_id % 25 AS iterations,
  (event_id % 4 = 0)::INT AS loops, (event_id % 6 = 0)::INT AS stagnations, least(value / 100, 1.0) AS confidence, value / 50 AS cost, event_type AS kind, ts FROM events)"""


ROLES = ["AXButton", "AXTextField", "AXMenuItem", "AXCheckBox", "AXLink", "AXTable"]
PLACES = ["toolbar", "sidebar", "dialog"]


def elements(spark, sf_dir: str) -> DataFrame:
    """(key, role, label, path, x, y, w, h, actions): an element for each part, its place by its key."""
    k = F.col("p_partkey")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (k % len(ROLES) + 1).cast("int"))
    label = F.when(k % 17 != 0, F.col("p_name"))
    place = F.element_at(F.array(*map(F.lit, PLACES)), (k % len(PLACES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("key"),
        role.alias("role"),
        label.alias("label"),
        F.concat_ws("/", F.lit("/AXApplication/AXWindow"), place, F.concat(role, F.coalesce(F.concat(F.lit("["), label, F.lit("]")), F.lit("")))).alias("path"),
        (k * 37 % 1900).alias("x"),
        (k * 101 % 1000).alias("y"),
        (k % 7 * 10).alias("w"),
        (k % 5 * 8).alias("h"),
        F.when(k % 4 == 0, F.array(F.lit("AXShowMenu"))).when(k % 5 == 0, F.array(F.lit("AXSetValue"))).otherwise(F.array(F.lit("AXPress"))).alias("actions"),
    )


ELEMENTS = f"""el AS (SELECT p_partkey AS key, ({sql_list(ROLES)})[p_partkey % {len(ROLES)} + 1] AS role, CASE WHEN p_partkey % 17 <> 0 THEN p_name END AS label,
  '/AXApplication/AXWindow/' || ({sql_list(PLACES)})[p_partkey % {len(PLACES)} + 1] || '/' || ({sql_list(ROLES)})[p_partkey % {len(ROLES)} + 1] || coalesce('[' || CASE WHEN p_partkey % 17 <> 0 THEN p_name END || ']', '') AS path,
  p_partkey * 37 % 1900 AS x, p_partkey * 101 % 1000 AS y, p_partkey % 7 * 10 AS w, p_partkey % 5 * 8 AS h,
  CASE WHEN p_partkey % 4 = 0 THEN ['AXShowMenu'] WHEN p_partkey % 5 = 0 THEN ['AXSetValue'] ELSE ['AXPress'] END AS actions FROM part)"""


def clicks(spark, sf_dir: str) -> DataFrame:
    """(click, x, y): a click for each event."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("click"), (i * 53 % 1950).alias("x"), (i * 29 % 1050).alias("y"))


CLICKS = "cl AS (SELECT event_id AS click, event_id * 53 % 1950 AS x, event_id * 29 % 1050 AS y FROM events)"
