"""Column builders for weather, fuel moisture and wind."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Published constants that results depend on.
#: Magnus form of saturation vapour pressure: Pa, slope, degrees Celsius.
MAGNUS = (610.94, 17.625, 243.04)
#: Van Wagner and Pickett's equilibria in percent: factor, power, factor of exp(0.1 humidity), for drying and wetting.
DRYING, WETTING = (0.942, 0.679, 0.4994e-4), (0.618, 0.753, 0.4540e-4)
#: Solar declination: amplitude and phase in radians.
DECLINATION = (0.409, 1.39)
#: Standard atmosphere: degrees Celsius at sea level, fall per metre, metres of density altitude per degree.
ATMOSPHERE = (15.0, 0.0065, 36.576)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 below low, 1 above high, linear between."""
    return clip((x - low) / (high - low), 0.0, 1.0)


def saturation_vapour_pressure_pa(celsius: Column) -> Column:
    """Magnus form; at its pole the limit from above, 0."""
    a, b, c = MAGNUS
    return F.when(celsius + c == 0, 0.0).otherwise(a * F.exp(b * celsius / (celsius + c)))


def vapour_pressure_deficit_pa(celsius: Column, humidity_pct: Column) -> Column:
    return saturation_vapour_pressure_pa(celsius) * (1 - clip(humidity_pct / 100, 0.0, 1.0))


def day_length_hours(latitude_deg: Column, day_of_year: Column) -> Column:
    """Hours of daylight from latitude and day of the year."""
    a, phase = DECLINATION
    declination = a * F.sin(2 * math.pi * day_of_year / 365 - phase)
    return 24 / F.pi() * F.acos(clip(-F.tan(F.radians(latitude_deg)) * F.tan(declination), -1.0, 1.0))


def wind_components(speed: Column, from_deg: Column) -> tuple[Column, Column]:
    """(eastward, northward) of a wind named by where it comes from."""
    return -speed * F.sin(F.radians(from_deg)), -speed * F.cos(F.radians(from_deg))


def wind_from(u: Column, v: Column) -> tuple[Column, Column]:
    """(speed, direction it comes from) of eastward and northward components."""
    return F.hypot(u, v), F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def circular_mean_deg(angle: Column) -> Column:
    """Aggregate: mean direction of angles in degrees."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle))))), F.lit(360.0))


def moisture_equilibria(celsius: Column, humidity_pct: Column) -> tuple[Column, Column]:
    """(upper, lower) moisture in kg/kg to which a fine fuel dries and wets; between them it stays as it is."""
    h = clip(humidity_pct, 0.0, 100.0)
    heat = 0.18 * (21.1 - celsius) * (1 - F.exp(-0.115 * h))
    drying, wetting = (a * F.pow(h, F.lit(b)) + c * F.exp(0.1 * h) + heat for a, b, c in (DRYING, WETTING))
    return clip(F.greatest(drying, wetting) * 0.01, 0.0, 3.0), clip(F.least(drying, wetting) * 0.01, 0.0, 3.0)


def rain_response(rain_mm_h: Column, lag_hours: float, saturation: float = 2.5, soaking: float = 14.0, threshold: float = 0.05, full: float = 8.0) -> tuple[Column, Column]:
    """(moisture that rain leads to, null without rain; rate a minute at which fuel nears its target)."""
    excess = F.greatest(rain_mm_h - threshold, F.lit(0.0))
    rate = F.when(excess > 0, (1 - F.exp(-excess / full)) / (soaking * lag_hours * 60)).otherwise(1 / (lag_hours * 60))
    return F.when(excess > 0, saturation), rate


def moisture_step(moisture: Column, upper: Column, lower: Column, rain_mm_h: Column, lag_hours: float, minutes: Column) -> Column:
    """Moisture after some minutes: towards the nearer equilibrium with a time lag, or in rain towards saturation, slower."""
    target, rate = rain_response(rain_mm_h, lag_hours)
    dry = F.greatest(F.least(moisture, upper), lower)
    return clip(moisture + (F.coalesce(target, dry) - moisture) * -F.expm1(-minutes * rate), 0.0, 3.0)


def curing_fraction(live_moisture: Column) -> Column:
    """Share of herbaceous fuel that counts as dead: none above 120 % live moisture, all at 30 %."""
    return clip((1.20 - live_moisture) / 0.90, 0.0, 1.0)


def downscaled(celsius: Column, humidity_pct: Column, elevation: Column, reference: Column, lapse: float = -0.0065) -> tuple[Column, Column]:
    """(temperature, humidity) at an elevation from those at a reference: a lapse rate, with vapour pressure kept. Air so cold that
    it holds no vapour is saturated."""
    there = celsius + lapse * (elevation - reference)
    vapour, most = humidity_pct / 100 * saturation_vapour_pressure_pa(celsius), saturation_vapour_pressure_pa(there)
    return there, F.when(most == 0, 100.0).otherwise(clip(100 * vapour / F.nullif(most, F.lit(0.0)), 0.0, 100.0))


def half_life(value: Column, elapsed: Column, life: Column) -> Column:
    """What remains of value after elapsed time."""
    return value * F.pow(F.lit(0.5), elapsed / life)


def ignition_hazard(rate: Column, residence: Column, treatment: Column, minutes: Column, cell: Column) -> Column:
    return clip(1 - F.exp(-F.greatest(F.lit(0.0), rate * residence * treatment * minutes / cell)), 0.0, 1.0)


def density_altitude_m(pressure_altitude_m: Column, celsius: Column) -> Column:
    """Pressure altitude plus 120 feet for each degree above the standard atmosphere."""
    base, fall, per_degree = ATMOSPHERE
    return pressure_altitude_m + per_degree * (celsius - (base - fall * pressure_altitude_m))
