"""Rollouts and results: roll-ups, truncation, cadence, speed, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERALL = "__overall__"
#: fixed values: tasks, in the order in which ranks take them, and the most steps of a rollout of each
STEP_LIMITS = {
    "PnPCounterToCab": 500, "PnPCabToCounter": 500, "PnPCounterToSink": 700, "PnPSinkToCounter": 500, "PnPCounterToMicrowave": 600, "PnPMicrowaveToCounter": 500, "PnPCounterToStove": 500, "PnPStoveToCounter": 500,
    "OpenSingleDoor": 500, "CloseSingleDoor": 500, "OpenDoubleDoor": 1000, "CloseDoubleDoor": 700, "OpenDrawer": 500, "CloseDrawer": 500, "TurnOnStove": 500, "TurnOffStove": 500,
    "TurnOnSinkFaucet": 500, "TurnOffSinkFaucet": 500, "TurnSinkSpout": 500, "CoffeeSetupMug": 600, "CoffeeServeMug": 600, "CoffeePressButton": 300, "TurnOnMicrowave": 500, "TurnOffMicrowave": 500,
}


def success_rollup(rows: DataFrame, task: str, successes: Column, rollouts: Column) -> DataFrame:
    """(task, num_success_rollouts, num_rollouts, success_rate) for each task and overall; rates of 4 digits, half to even."""
    named = rows.select(F.col(task).alias("task"), successes.cast("long").alias("s"), rollouts.cast("long").alias("n"))
    rolled = named.rollup("task").agg(F.sum("s").alias("num_success_rollouts"), F.sum("n").alias("num_rollouts"), F.grouping("task").alias("g"))
    rate = F.coalesce(F.bround(F.try_divide(F.col("num_success_rollouts").cast("double"), F.col("num_rollouts").cast("double")), 4), F.lit(0.0))
    return rolled.filter("g = 1 or task is not null").select(F.when(F.col("g") == 1, OVERALL).otherwise(F.col("task")).alias("task"), "num_success_rollouts", "num_rollouts", rate.alias("success_rate"))


def rollup_files(names: DataFrame, rates: DataFrame) -> DataFrame:
    """Counts from video names, the rate from the result text, with a check of one against the other."""
    counted = names.groupBy("task").agg(F.count_if(F.col("name").contains("_success.mp4")).alias("num_success_rollouts"), F.count("*").alias("num_rollouts"))
    both = rates.join(counted, "task", "left").na.fill(0, ["num_success_rollouts", "num_rollouts"])
    return both.withColumn("agrees", F.abs(F.col("success_rate") - F.try_divide(F.col("num_success_rollouts").cast("double"), F.col("num_rollouts"))) < 5e-5)


def truncate_rollouts(steps: DataFrame, success: Column, limit: Column) -> DataFrame:
    """Steps up to the first success of a rollout, or up to its limit."""
    w = Window.partitionBy("episode")
    first = F.min(F.when(success, F.col("frame"))).over(w)
    return steps.withColumn("first_success", first).filter((F.col("frame") <= F.coalesce(F.col("first_success"), F.col("frame"))) & (F.col("frame") < limit))


def speed(log: DataFrame, run: str, step: str, seconds: str, max_steps: int, window: int = 10) -> DataFrame:
    """Steps a second over the last ``window`` rows of a run, and the seconds left; steps over 0 only."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(-(window - 1), 0)
    steps, time = F.col(step) - F.first(step).over(w), F.col(seconds) - F.first(seconds).over(w)
    rows = log.filter(F.col(step) > 0).withColumn("speed", F.when((F.count("*").over(w) < 2) | (time <= 0), 0.0).otherwise(steps / time))
    return rows.withColumn("eta", F.when(F.col("speed") > 0, (max_steps - F.col(step)) / F.col("speed")))


def dispatch(requests: DataFrame, ready: DataFrame) -> DataFrame:
    """The k-th request goes to the k-th ready worker of its queue (column ``queue``): equal ranks are joined. Requests
    without a worker stay, with NULL."""
    rank = F.row_number().over(Window.partitionBy("queue").orderBy("ts", "id"))
    asked = requests.withColumn("k", rank).select("queue", "k", F.col("id").alias("request_id"), F.col("ts").alias("request_ts"))
    free = ready.withColumn("k", rank).select("queue", "k", F.col("id").alias("worker_id"), F.col("ts").alias("ready_ts"))
    return asked.join(free, ["queue", "k"], "left").withColumn("dispatch_ts", F.when(F.col("ready_ts").isNotNull(), F.greatest("request_ts", "ready_ts")))


def queue_depth(events: DataFrame, change: Column) -> DataFrame:
    """Running sum of arrivals and departures of each queue."""
    return events.withColumn("depth", F.sum(change).over(Window.partitionBy("queue").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)))


def valid_seeds(candidates: DataFrame, start: int, stable: Column, n: int) -> DataFrame:
    """The first n stable seeds from ``start`` on."""
    return candidates.filter((F.col("seed") >= start) & stable).orderBy("seed").limit(n)


def task_of(rank: Column, tasks: dict[str, int] | None = None) -> Column:
    """Tasks go round over the ranks."""
    names = list(tasks or STEP_LIMITS)
    return F.get(F.array(*map(F.lit, names)), F.pmod(rank, F.lit(len(names))).cast("int"))


def with_limit(rows: DataFrame, tasks: dict[str, int] | None = None) -> DataFrame:
    """Adds ``step_limit`` by task (a table of a few rows); a task without one is an error."""
    table = rows.sparkSession.createDataFrame(list((tasks or STEP_LIMITS).items()), "task string, step_limit int")
    found = rows.join(F.broadcast(table), "task", "left")
    return found.withColumn("step_limit", F.coalesce("step_limit", F.raise_error(F.concat(F.lit("no step limit for "), F.col("task"))).cast("int")))


def first_batches(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first n batches (column ``batch``) of a validation run."""
    return rows.filter(F.col("batch") < n)


def waiting(dispatched: DataFrame) -> DataFrame:
    """Adds how long a worker stood idle before its request, and a request before its worker."""
    return dispatched.withColumns({"idle": F.col("dispatch_ts") - F.col("ready_ts"), "waited": F.col("dispatch_ts") - F.col("request_ts")})
