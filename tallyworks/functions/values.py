"""Coercion, money, scores, dates and JSON as column expressions. Bad input is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.7
# Score bands and size floors in dollars.
ALERT_AT, NOTABLE_AT, ROUTINE_MAX = 70, 40, 34
FLOORS = {"resolved_private": 100_000_000, "small_business_setaside": 50_000_000, "sub_floor_unlisted": 25_000_000}
#: Dollars per million tokens (input, output) by model; a parameter wherever it is used.
RATES = {"small": (1.0, 5.0), "large": (5.0, 25.0)}


def store_int(c: Column) -> Column:
    """Whole number of text with "," and "$", cut towards zero."""
    v = F.nullif(F.trim(F.regexp_replace(c.cast("string"), "[,$]", "")), F.lit("")).try_cast("double")
    return F.when(F.lower(c.cast("string")) == "true", 1).when(F.lower(c.cast("string")) == "false", 0).otherwise(v.try_cast("bigint")).cast("bigint")


def store_double(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")


def store_bool(c: Column) -> Column:
    """true, t, 1, yes, y; blank is null; all else false."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(F.nullif(s, F.lit("")).isNull(), F.lit(None).cast("boolean")).otherwise(s.isin("true", "t", "1", "yes", "y"))


def store_date(c: Column) -> Column:
    return F.nullif(F.trim(F.substring(c.cast("string"), 1, 10)), F.lit("")).try_cast("date")


def store_utc(c: Column) -> Column:
    """Offset applied, then without zone."""
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("timestamp").cast("timestamp_ntz")


def store_json(c: Column) -> Column:
    """Valid JSON text as it is; other text as a JSON string."""
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(c.isNull() | F.try_parse_json(c).isNotNull(), c).otherwise(quoted)


def model_int(c: Column) -> Column:
    """First number in the text, rounded half to even."""
    m = F.regexp_extract(F.replace(c.cast("string"), F.lit("$"), F.lit("")), r"(-?\d[\d,]*(?:\.\d+)?)", 1)
    return F.bround(F.nullif(F.replace(m, F.lit(","), F.lit("")), F.lit("")).try_cast("double"), 0).try_cast("bigint")


def model_bool(c: Column) -> Column:
    """Known spellings; other text is null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "yes", "y", "1"), True).when(s.isin("false", "no", "n", "0"), False)


def dollars_with_unit(number: Column, unit: Column) -> Column:
    """1.5 million as 1500000, cut towards zero."""
    times = F.when(F.lower(unit) == "billion", 1e9).when(F.lower(unit) == "million", 1e6).otherwise(1.0)
    return (F.replace(number, F.lit(","), F.lit("")).try_cast("double") * times).try_cast("bigint")


def _in_units(v: Column, cut: int, digits: int) -> Column:
    """A whole number >= 0 divided by ``cut``, printed with ``digits`` decimals as C and Python do.

    They round the binary quotient, half to even; Java's formatter rounds its shortest decimal spelling half up, which differs on
    ties. On a tie the quotient, scaled by a power of two, is compared with the true value in whole numbers.
    """
    unit, wide = cut // 10**digits, "decimal(19,0)"
    rest, x = v % unit, v.cast("double") / float(cut)
    whole = ((v - rest) / unit).cast("bigint")
    scale = F.when(x < 1024, F.lit(2**52)).otherwise(F.lit(2**42))
    binary = (x * scale).cast("bigint").cast(wide) * F.lit(cut).cast("decimal(13,0)")
    true = v.cast(wide) * scale.cast("decimal(16,0)")
    tie = (binary > true) | ((binary == true) & (whole % 2 == 1))
    up = (2 * rest > unit) | ((2 * rest == unit) & tie)
    return F.format_string(f"%,.{digits}f", (whole + up.cast("bigint")) / float(10**digits))


def _scaled(c: Column, cuts: list[tuple[int, int, str]]) -> Column:
    """Compact form of the size of a whole number; below the last cut it is printed whole."""
    v = F.abs(c.cast("bigint"))
    out = F.format_string("%,d", v)
    for cut, digits, unit in reversed(cuts):
        out = F.when(v >= cut, F.concat(_in_units(v, cut, digits), F.lit(unit))).otherwise(out)
    return out


_B, _M, _K = (10**9, 1, "B"), (10**6, 1, "M"), (10**3, 1, "K")


def usd(c: Column) -> Column:
    """Compact dollars of a change: $1.5M; null as "-"."""
    return F.coalesce(F.when(c.isNotNull(), F.concat(F.lit("$"), F.when(c < 0, "-").otherwise(""), _scaled(c, [_B, _M, _K]))), F.lit("-"))


def usd_view(c: Column) -> Column:
    """Compact dollars of a table: the sign first, trillions too; null as a dash."""
    return F.coalesce(F.when(c.isNotNull(), F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), _scaled(c, [(10**12, 1, "T"), _B, _M, _K]))), F.lit("—"))


def usd_fact(c: Column) -> Column:
    """Dollars of a fact line: two decimals for billions, whole dollars below a million; null as "unstated"."""
    return F.coalesce(F.when(c.isNotNull(), F.concat(F.lit("$"), F.when(c < 0, F.format_string("%,d", c.cast("bigint"))).otherwise(_scaled(c, [(10**9, 2, "B"), _M])))), F.lit("unstated"))


def percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.0f%%", c * 100)).otherwise("—")


def confidence(c: Column) -> Column:
    """0.87 as "0.87"; null as a dash."""
    number = c.try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.2f", number)).otherwise("—")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def tier_for(score: Column) -> Column:
    return F.when(score >= ALERT_AT, "alert").when(score >= NOTABLE_AT, "notable").otherwise("routine")


def routine_score(amount: Column, ceiling: Column) -> Column:
    """1 to 34, growing with the amount; rounded half to even."""
    part = F.bround(ROUTINE_MAX * F.least(F.lit(1.0), amount / ceiling), 0).cast("int")
    return F.when(F.coalesce(amount, F.lit(0)) <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(ROUTINE_MAX), part))).cast("int")


def price(model: Column, tokens_in: Column, tokens_out: Column, rates: dict[str, tuple[float, float]] = RATES) -> Column:
    """Dollars of a call; 0 for an unknown model."""
    cost = F.lit(None).cast("double")
    for name, (a, b) in rates.items():
        cost = F.coalesce(cost, F.when(model == name, (tokens_in * a + tokens_out * b) / 1e6))
    return F.round(F.coalesce(cost, F.lit(0.0)), 6)


def calls(items: Column, size: int) -> Column:
    return F.ceil(items / size).cast("long")


def estimated_tokens(chars: Column) -> tuple[Column, Column]:
    """Input tokens of a text, and the output expected of it."""
    tin = F.floor(chars / 3.7).cast("long")
    return tin, F.floor(tin * 0.68).cast("long")


def token_budget(n: Column, base: int, each: int, cap: int) -> Column:
    return F.least(F.lit(cap).cast("long"), (F.lit(base) + n * each).cast("long"))


def needs_escalation(confidence: Column) -> Column:
    """Below the limit, or no number."""
    c = confidence.try_cast("double")
    return c.isNull() | (c < LOW_CONFIDENCE)


def as_list(c: Column) -> Column:
    """JSON array of strings; a scalar or bad JSON as a list of one; null and blank as an empty list."""
    parsed = F.from_json(c, "array<string>")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<string>")).when(F.trim(c).startswith("[") & F.try_parse_json(c).isNotNull(), parsed).otherwise(F.array(c))


def exploded(answers: DataFrame, field: str, names: list[str], payload: str = "payload") -> DataFrame:
    """The objects of an answer's array (``{"field": [...]}``): its other columns, ``pos`` in the array, and ``names`` as text. No such array, no rows."""
    items = F.from_json(F.get_json_object(payload, f"$.{field}"), f"array<struct<{', '.join(f'{n}: string' for n in names)}>>")
    rest = [c for c in answers.columns if c != payload]
    return answers.select(*rest, F.posexplode(items).alias("pos", "item")).where("item IS NOT NULL").select(*rest, "pos", *[F.col("item")[n].alias(n) for n in names])


def as_object(c: Column) -> Column:
    """JSON object as a map of strings; anything else as an empty map."""
    ok = F.trim(c).startswith("{") & F.try_parse_json(c).isNotNull()
    return F.coalesce(F.when(ok, F.from_json(c, "map<string,string>")), F.create_map().cast("map<string,string>"))


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def now_utc(at: Column | None = None) -> Column:
    """An instant, the query's own unless given, as ISO seconds in UTC."""
    moment = F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone())
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def pretty_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MMM d, yyyy"), F.lit("—"))


def iso_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
