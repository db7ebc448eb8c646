"""Demonstration tables with fixed shapes: seeded, and made in parallel from a range of ids."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import rint_int
from tidemark.sources.files import time_series


def _between(seed: int, low: float, high: float) -> Column:
    return low + (high - low) * F.rand(seed)


def _pick(seed: int, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def room_readings(spark: SparkSession, as_of: datetime, days: int = 60, step: timedelta = timedelta(seconds=5), sensors: int = 4, seed: int = 1) -> DataFrame:
    """(time, sensor_id, temperature in [0, 100), cpu in [0, 1)): every sensor at every step, both ends included."""
    grid = time_series(spark, as_of - timedelta(days=days), as_of, step).crossJoin(F.broadcast(spark.range(1, sensors + 1)))
    return grid.select(F.col("ts").alias("time"), F.col("id").cast("int").alias("sensor_id"), _between(seed, 0, 100).alias("temperature"), F.rand(seed + 1).alias("cpu"))


def _ranges(seed: int, ranges: dict[str, tuple[float, float]]) -> list[Column]:
    """A column for each name, drawn evenly from [low, high)."""
    return [_between(seed + k, low, high).alias(name) for k, (name, (low, high)) in enumerate(ranges.items())]


#: Ranges that measured values of a production line are drawn from.
LINE_RANGES = {"ideal_cycle_time_seconds": (0.5, 0.85), "performance": (0.85, 1.0), "quality": (0.95, 1.0), "temperature_c": (55.0, 65.0), "vibration_mm_s": (1.0, 4.0), "noise_db": (65.0, 80.0), "energy_kwh": (0.001, 0.003)}


def oee_readings(spark: SparkSession, as_of: datetime, days: int = 7, step: timedelta = timedelta(seconds=5), lines: int = 3, seed: int = 2) -> DataFrame:
    """Effectiveness of production lines: availability = runtime / planned; oee is drawn afresh, as are good parts.

    Each kind of downtime takes none of a step or a share of it; runtime is what they leave, never below zero.
    """
    seconds = int(step.total_seconds())
    grid = time_series(spark, as_of - timedelta(days=days), as_of, step).crossJoin(F.broadcast(spark.range(1, lines + 1)))
    hour = F.hour("ts")

    def downtime(k: int, often: float) -> Column:
        return F.when(F.rand(k) < often, F.ceil(F.rand(k + 1) * seconds)).otherwise(0).cast("short")

    def parts(k: int) -> Column:
        return F.when(F.col("runtime_seconds") > 0, rint_int(F.rand(k) * F.col("runtime_seconds"))).otherwise(0)

    shift = F.when(hour.between(6, 13), 1).when(hour.between(14, 21), 2).otherwise(3).cast("short")
    rows = grid.select(
        F.col("ts").alias("time"),
        F.concat(F.lit("LINE-"), F.col("id")).alias("line_id"),
        shift.alias("shift"),
        F.lit(seconds).cast("short").alias("planned_time_seconds"),
        downtime(seed, 0.02).alias("planned_downtime_seconds"),
        downtime(seed + 2, 0.01).alias("unplanned_downtime_seconds"),
        *_ranges(seed + 10, LINE_RANGES),
    )
    runtime = F.greatest(F.lit(0), F.col("planned_time_seconds") - F.col("planned_downtime_seconds") - F.col("unplanned_downtime_seconds"))
    rows = rows.withColumn("runtime_seconds", runtime.cast("short")).withColumn("availability", F.col("runtime_seconds") / F.col("planned_time_seconds"))
    afresh = [_between(seed + 30 + k, *LINE_RANGES[x]) for k, x in enumerate(("performance", "quality"))]
    return rows.select("*", parts(seed + 40).alias("actual_output"), parts(seed + 41).alias("good_output"), (F.col("availability") * afresh[0] * afresh[1]).alias("oee"))


#: Ranges that a well's readings are drawn from; pressures stay above 8000 at the head and 12000 below.
WELL_RANGES = {"oil_rate": (100.0, 600.0), "gas_rate": (800.0, 4000.0), "water_rate": (50.0, 350.0), "wellhead_pressure": (8000.0, 12000.0), "wellhead_temperature": (140.0, 187.0), "downhole_pressure": (12000.0, 15500.0)}


def well_readings(spark: SparkSession, as_of: datetime, days: int = 90, wells: int = 20, seed: int = 3) -> DataFrame:
    """A reading of each well every quarter of an hour of whole days up to midnight before as_of."""
    end = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    grid = time_series(spark, end - timedelta(days=days), end - timedelta(seconds=1), timedelta(minutes=15)).crossJoin(F.broadcast(spark.range(1, wells + 1)))
    choke = _pick(seed + 20, [float(x) for x in range(16, 48, 4)])
    return grid.select(F.col("ts").alias("time"), F.col("id").cast("int").alias("well_id"), *_ranges(seed, WELL_RANGES), choke.alias("choke_size"))


#: Stages of each job; where the last stage of a job starts before now and how far stages stand
#: apart, in minutes; a stage's pump time in minutes is 110 + (3 stage number + 7 job) mod 20; a stage whose
#: number times its job divides by 15 screens out.
JOB_STAGES = (25, 22, 30, 28, 20)
LAST_START, APART = 121, 180
PUMP_LEAST, PUMP_STAGE, PUMP_JOB, PUMP_SPAN = 110, 3, 7, 20
SCREENOUT = 15
#: By the end of which share of a stage its proppant concentration is which.
STEPS = ((0.25, 0.0), (0.40, 0.25), (0.55, 0.5), (0.65, 1.0), (0.75, 1.5), (0.88, 2.0), (1.0, 0.0))
#: Ranges of a stage's other readings.
PUMP_RANGES = {"bottomhole_pressure_psi": (8000.0, 11000.0), "hydrostatic_pressure_psi": (7700.0, 9700.0), "slurry_density_ppg": (8.3, 9.8)}


def frac_stages(spark: SparkSession, as_of: datetime) -> DataFrame:
    """125 stages of five jobs, numbered in order; the last stage of each job ends about as_of."""
    rows = [(job, k, n) for job, n in enumerate(JOB_STAGES, 1) for k in range(1, n + 1)]
    stages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "id int, job_id int, stage_number int, total_stages int")
    number, job = F.col("stage_number"), F.col("job_id")
    back = F.make_dt_interval(mins=LAST_START + APART * (F.col("total_stages") - number))
    pump = PUMP_LEAST + (PUMP_STAGE * number + PUMP_JOB * job) % PUMP_SPAN
    result = F.when(number * job % SCREENOUT == 0, "Screenout").otherwise("Completed")
    return stages.select("id", "job_id", "stage_number", (F.lit(as_of).cast("timestamp_ntz") - back).alias("stage_start_time"), pump.cast("int").alias("pump_time_minutes"), result.alias("stage_result"))


def pump_schedule(stages: DataFrame, parts: int = 7) -> DataFrame:
    """Equal parts of each stage."""
    return stages.select(F.col("id").alias("stage_id"), F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("substage_number"), "stage_start_time", "pump_time_minutes")


def frac_telemetry(stages: DataFrame, seed: int = 4) -> DataFrame:
    """Twelve readings a minute of each stage's pump time: concentration goes up in steps and drops for the flush,
    pressure follows it, and the rate rises and falls in the stage's first and last tenth."""
    n = F.col("pump_time_minutes") * 12
    rows = stages.select("id", "stage_start_time", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    share = F.col("k") / F.col("n")
    level = F.element_at(F.filter(F.array(*[F.struct(F.lit(end).alias("end"), F.lit(ppg).alias("ppg")) for end, ppg in STEPS]), lambda x: share < x["end"]), 1)["ppg"]
    ramp = F.least(F.lit(1.0), share * 10, (1 - share) * 10)
    return rows.select(
        (F.col("stage_start_time") + F.make_dt_interval(secs=F.col("k") * 5)).alias("time"),
        F.col("id").alias("stage_id"),
        (500 + 5500 * ramp + 500 * level + _between(seed, 0, 400)).alias("treating_pressure_psi"),
        (75 * ramp + _between(seed + 1, 0, 1)).alias("slurry_rate_bpm"),
        (level + _between(seed + 2, 0, 0.02)).alias("proppant_concentration_ppg"),
        *_ranges(seed + 3, PUMP_RANGES),
    )


def wearable_readings(spark: SparkSession, as_of: datetime, days: int = 30, step: timedelta = timedelta(seconds=5), devices: int = 4, seed: int = 5) -> DataFrame:
    """Vital signs; whole numbers are rounded, so both ends of a range come up."""
    grid = time_series(spark, as_of - timedelta(days=days), as_of, step).crossJoin(F.broadcast(spark.range(1, devices + 1)))
    activity = F.when(F.rand(seed) < 0.4, "resting").when(F.rand(seed + 1) < 0.7, "walking").when(F.rand(seed + 2) < 0.9, "running").otherwise("cycling")
    return grid.select(
        F.col("ts").alias("time"),
        F.col("id").cast("int").alias("device_id"),
        (60 + rint_int(F.rand(seed + 3) * 40)).alias("heart_rate"),
        (110 + rint_int(F.rand(seed + 4) * 30)).alias("blood_pressure_systolic"),
        (70 + rint_int(F.rand(seed + 5) * 20)).alias("blood_pressure_diastolic"),
        _between(seed + 6, 95, 100).alias("spo2"),
        _between(seed + 7, 36.1, 37.2).alias("body_temperature"),
        activity.alias("activity_level"),
    )


#: A daily wave of this height with its zero at six o'clock, a shift on weekdays and on weekends, and
#: the deviation of the noise, of temperature and humidity; humidity is kept between 20 and 80.
WAVE, WEEKDAY, WEEKEND, NOISE = (3.0, -5.0), (1.0, -2.0), (-2.0, 5.0), (0.5, 2.0)
HUMIDITY = (20.0, 80.0)


def climate_readings(spark: SparkSession, as_of: datetime, days: int = 60, sensors: int = 20, seed: int = 6) -> DataFrame:
    """(timestamp, sensor_id, temperature, humidity) of rooms: a sensor's own level, a daily wave, weekends and noise."""
    rooms = spark.range(1, sensors + 1).select("id", _between(seed, 18, 24).alias("t"), _between(seed + 1, 40, 60).alias("h"))
    grid = time_series(spark, as_of - timedelta(days=days), as_of - timedelta(minutes=1), timedelta(minutes=1)).crossJoin(F.broadcast(rooms))
    turn = F.sin(((F.hour("ts") * 60 + F.minute("ts")) / 720 - 0.5) * math.pi)
    free = F.weekday("ts") >= 5
    warm, damp = (F.col(c) + WAVE[k] * turn + F.when(free, WEEKEND[k]).otherwise(WEEKDAY[k]) + NOISE[k] * F.randn(seed + 2 + k) for k, c in enumerate("th"))
    damp = F.least(F.lit(HUMIDITY[1]), F.greatest(F.lit(HUMIDITY[0]), damp))
    return grid.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.format_string("sensor_%02d", "id").alias("sensor_id"), F.round(warm, 2).alias("temperature"), F.round(damp, 2).alias("humidity"))
