"""Queries on the job service's records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.frames import order_jobs

Q: dict = {}
SQL: dict[str, str] = {}
JOBS = """jobs AS (SELECT o_orderkey id, o_custkey scene, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'running' END status, CAST(left(o_orderpriority,1) AS INT) stage, o_orderdate created_at, CAST(o_orderkey%101 AS INT) progress FROM orders)"""


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart, jobs that were queued or running have failed."""
    lost = F.col("status").isin("queued", "running")
    return jobs.withColumns({"error": F.when(lost, "service restarted"), "status": F.when(lost, "failed").otherwise(F.col("status"))})


def tail(log: DataFrame, keys: list[str], order: list, n: int = 70) -> DataFrame:
    """The last ``n`` rows of each log, with their place from the end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def progress(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Progress never falls: the running maximum."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("shown", F.max("progress").over(w))


# What a log line holds, the progress it means, and the stage's name.
MARKERS = [("[grid]", 15, "构建点云网格"), ("[dsm]", 30, "构建 DSM"), ("[extract]", 45, "提取坡顶坡脚"), ("[multiscale]", 55, "多尺度增强"), ("[link", 65, "线段续接"), ("[validate]", 75, "高差验证"), ("[auto-gap]", 85, "自动补线"), ("[done]", 95, "输出成果")]


def staged(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, line) with progress and stage after each line: the greatest progress so far, the last marked stage (of a line with several markers the last listed)."""
    hits = F.array_compact(F.array(*(F.when(F.contains(F.lower("line"), F.lit(m)), F.struct(F.lit(p).alias("progress"), F.lit(name).alias("stage"))) for m, p, name in MARKERS)))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = log.withColumn("_hits", hits)
    return marked.withColumns({"progress": F.max(F.array_max(F.transform("_hits", lambda h: h.progress))).over(w), "stage": F.last(F.try_element_at("_hits", F.lit(-1)).stage, True).over(w)}).drop("_hits")


def job_id(unique: Column) -> Column:
    """A job's id from a text of at least twelve hexadecimal digits, such as a UUID."""
    return F.concat(F.lit("SLOPE-"), F.substring(F.regexp_replace(F.lower(unique), "-", ""), 1, 12))


def stamped(time: Column) -> Column:
    """A job's created_at."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def elapsed(start: Column, end: Column) -> Column:
    """Seconds, to the hundredth."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.round((micros(end) - micros(start)) / F.lit(1e6), 2)


def load_jobs(spark, pattern: str) -> DataFrame:
    """Job records from JSON files; files that cannot be read as a record are left out."""
    jobs = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema("id string, status string, scene string, name string, progress double, stage string, source string, input string, params map<string,string>, created_at string, logs array<string>, files array<string>, result string, error string, elapsed_s double, _corrupt string").json(pattern)
    return recovered(jobs.where("_corrupt is null and id is not null").drop("_corrupt"))


def _keep(name, sql):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


@_keep("q_jobs_recover", f"WITH {JOBS} SELECT id, CASE WHEN status IN ('queued','running') THEN 'failed' ELSE status END status, CASE WHEN status IN ('queued','running') THEN 'service restarted' END error FROM jobs")
def q_jobs_recover(spark, d):
    return recovered(order_jobs(spark, d)).select("id", "status", "error")


@_keep("q_jobs_latest", f"WITH {JOBS} SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id DESC")
def q_jobs_latest(spark, d):
    return order_jobs(spark, d).orderBy(F.desc("created_at"), F.desc("id")).select("id", "status", "created_at")


@_keep("q_log_tail", "SELECT user_id, event_id, back FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) back FROM events) WHERE back<=70")
def q_log_tail(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts")
    return tail(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "back")


@_keep("q_progress", "SELECT user_id, event_id, max(CAST(value AS INT)%101) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) shown FROM (SELECT *, floor(value) fv FROM events)".replace("CAST(value AS INT)", "CAST(fv AS INT)"))
def q_progress(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts", (F.floor("value").cast("int") % 101).alias("progress"))
    return progress(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "shown")


@_keep("q_job_counts", f"WITH {JOBS} SELECT stage, count(*) FILTER (status='succeeded') succeeded, count(*) FILTER (status IN ('queued','running')) active, max(progress) progress FROM jobs GROUP BY stage")
def q_job_counts(spark, d):
    return order_jobs(spark, d).groupBy("stage").agg(F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status").isin("queued", "running")).alias("active"), F.max("progress").alias("progress"))


_LOG = "CASE event_id%11 WHEN 0 THEN 'x [GRID] cells=' WHEN 1 THEN '[dsm] slope' WHEN 2 THEN '[extract] 3' WHEN 3 THEN '[multiscale] +1' WHEN 4 THEN '[link/enhanced] pass' WHEN 5 THEN '[validate]' WHEN 6 THEN '[auto-gap] 0' WHEN 7 THEN '[done] [grid]' ELSE 'plain' END"
_MARKED = " ".join(f"WHEN contains(lower(line), '{m}') THEN {k}" for k, (m, *_) in reversed(list(enumerate(MARKERS))))
_STAGE = " ".join(f"WHEN {k} THEN '{name}'" for k, (_, _, name) in enumerate(MARKERS))
_DONE = ", ".join(f"CASE WHEN contains(lower(line), '{m}') THEN {p} ELSE -1 END" for m, p, _ in MARKERS)


@_keep("q_job_stages", f"""SELECT user_id, event_id, nullif(max(p) OVER w, -1) progress, CASE last_value(k IGNORE NULLS) OVER w {_STAGE} END stage FROM (SELECT *, CASE {_MARKED} END k, greatest({_DONE}) p FROM (SELECT user_id, ts, event_id, {_LOG} line FROM events)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def q_job_stages(spark, d):
    """Progress and stage after every line of logs."""
    log = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", F.expr(_LOG).alias("line"))
    return staged(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "progress", "stage")


@_keep("q_job_records", "SELECT 'SLOPE-' || left(md5(o_orderkey::VARCHAR), 12) id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') created_at, round((epoch_us(o_orderdate + to_milliseconds(o_orderkey*4))-epoch_us(o_orderdate))/1e6, 2) elapsed_s FROM orders")
def q_job_records(spark, d):
    """Ids, stamps and elapsed seconds of jobs."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    end = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 4000)
    return o.select(job_id(F.md5(F.col("o_orderkey").cast("string"))).alias("id"), stamped(F.col("o_orderdate")).alias("created_at"), elapsed(F.col("o_orderdate"), end).alias("elapsed_s"))
