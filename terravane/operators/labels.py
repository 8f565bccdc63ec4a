"""Rule-based stand-in labels for days without verified events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators import windows
from terravane.operators.windows import SeriesKey


@dataclass(frozen=True)
class ProxyThresholds:
    flood_day: float
    flood_week: float
    wet_day: float
    flood_streak: int
    dry_day: float
    drought_streak: int
    drought_rain_anomaly: float
    drought_temperature_anomaly: float
    cyclone_rain: float
    cyclone_temperature: float


def proxy_labels(
    frame: DataFrame,
    key: SeriesKey,
    limits: ProxyThresholds,
    rain: str = "precipitation",
    temperature: str = "temperature",
    warm_is_dry: bool = True,
) -> DataFrame:
    """flood_risk: wet day, wet week or wet streak.  drought_risk: dry streak with too little
    rain and a temperature anomaly.  cyclone_risk: rain with warmth.

    Months come before all that goes by day, so a task sorts its rows twice and not three times.
    """
    months = windows.dealt(frame, key).withColumns(
        {
            "_rain_anomaly": windows.month_anomaly(key, rain),
            "_temperature_anomaly": windows.month_anomaly(key, temperature),
        }
    )
    days = windows.streak(
        months.withColumn("_week", windows.rolling_sum(key, rain, 7)),
        key,
        {"_wet": F.col(rain) >= limits.wet_day, "_dry": F.col(rain) <= limits.dry_day},
    )
    warm = F.col("_temperature_anomaly")
    warm = warm >= limits.drought_temperature_anomaly if warm_is_dry else warm <= limits.drought_temperature_anomaly
    flood = (
        (F.col(rain) >= limits.flood_day)
        | (F.col("_week") >= limits.flood_week)
        | (F.col("_wet") >= limits.flood_streak)
    )
    drought = (
        (F.col("_dry") >= limits.drought_streak)
        & (F.col("_rain_anomaly") <= limits.drought_rain_anomaly)
        & warm
    )
    cyclone = (F.col(rain) >= limits.cyclone_rain) & (F.col(temperature) >= limits.cyclone_temperature)
    return days.withColumns(
        {
            "flood_risk": F.coalesce(flood, F.lit(False)).cast("int"),
            "drought_risk": F.coalesce(drought, F.lit(False)).cast("int"),
            "cyclone_risk": F.coalesce(cyclone, F.lit(False)).cast("int"),
            "label_method": F.lit("proxy"),
        }
    ).drop("_week", "_rain_anomaly", "_temperature_anomaly", "_wet", "_dry")
