"""When the rows of a batch were observed, if only the batch's end is known: an interval and a place in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in seconds: bounds of a batch's interval, of a first batch's; what is added to the gap and to the span, and the span's factor.
FLOOR, CEILING, FIRST_CEILING, GAP_PAD, SPAN_PAD, SPAN_FACTOR = 300.0, 3600.0, 7200.0, 300.0, 180.0, 1.35
#: m/s across and in height, by phase; seconds that an accepted row is uncertain by at least, alone and among others, and at most.
ACROSS, HEIGHT = {"ASC": 160.0, "DES": 180.0, "LVR": 230.0, None: 200.0}, {"ASC": 8.0, "DES": 10.0, "LVR": 5.0, None: 7.5}
LATENCY, ALONE, AMONG, NARROW = 90.0, 180.0, 240.0, 300.0


def _of_phase(table: dict) -> Column:
    out = F.lit(table[None])
    for phase, v in table.items():
        if phase:
            out = F.when(F.col("phase") == phase, v).otherwise(out)
    return out


def _within(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def row_times(rows: DataFrame) -> DataFrame:
    """rows with q10_us, q50_us, q90_us, uncertainty_s, driver, grade and clipped.

    rows: us (end of the batch), n and nth (place in it), prior_s, gap_s (to the previous batch, null for the first),
    hspan_m, vspan_m, phase, accepted, sampling_s, cross_km, vertical_m, estimate_us. An interval never passes the
    batch's end. Rows that are not accepted spread over the batch's interval, later ones nearer its end.
    """
    c = F.col
    prior = _within(F.coalesce(c("prior_s"), F.lit(FLOOR)), FLOOR, CEILING)
    way = F.greatest(F.coalesce(c("hspan_m"), F.lit(0.0)) / _of_phase(ACROSS), F.abs(F.coalesce(c("vspan_m"), F.lit(0.0))) / _of_phase(HEIGHT))
    span = _within(way * SPAN_FACTOR + SPAN_PAD, FLOOR, CEILING)
    cap = _within(F.when(c("gap_s") > 0, c("gap_s") + GAP_PAD).otherwise(FIRST_CEILING), FLOOR, FIRST_CEILING)
    free = F.greatest("__prior", "__span")
    width = F.greatest(F.lit(FLOOR), F.least(free, c("__cap"), F.lit(CEILING)))
    doubt = F.greatest(F.lit(LATENCY), F.coalesce(c("sampling_s"), F.lit(0.0)) * 0.5, F.coalesce(c("cross_km"), F.lit(0.0)) * 12, F.coalesce(c("vertical_m"), F.lit(0.0)) * 0.05, F.when(c("n") <= 1, ALONE).otherwise(AMONG))
    progress = _within((c("nth") - 1) / F.greatest(F.lit(1.0), c("n") - 1.0), 0.0, 1.0)
    micros = lambda s: F.round(s * 1000000).cast("long")
    driver = F.when(c("__cap") < free, "previous_batch_gap").when(c("__span") > c("__prior"), "physical_span").otherwise("confidence")
    t = rows.withColumns({"__prior": prior, "__span": span, "__cap": cap}).withColumns({"__width": width, "driver": driver, "__half": micros(_within(doubt, LATENCY, NARROW) / 2), "__mid": F.least("estimate_us", "us")})
    pick = lambda own, batch: F.when(c("accepted"), own).otherwise(batch)
    t = t.withColumns({
        "q10_us": pick(c("__mid") - c("__half"), c("us") - micros(c("__width"))), "q50_us": pick(c("__mid"), c("us") - micros(c("__width") - c("__width") * (0.25 + 0.55 * progress))), "q90_us": pick(F.least(c("us"), c("__mid") + c("__half")), c("us")),
    })
    known = c("prior_s")
    grade = pick(F.when(known <= 300, "B_narrow").otherwise("C_narrow"), F.when(known <= 900, "C_interval").when(known <= 1800, "D_wide").otherwise("R_rejected"))
    more = {"uncertainty_s": pick((c("q90_us") - c("q10_us")) / 1e6, c("__width")), "grade": grade, "clipped": F.coalesce(c("estimate_us") > c("us"), F.lit(False))}
    return t.withColumns(more).drop("__prior", "__span", "__cap", "__width", "__half", "__mid")
