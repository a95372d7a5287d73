"""Column functions on money, dates, civil time and business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/Sao_Paulo"


def to_cents(c: Column) -> Column:
    """Cents of a number, or of a text in Brazilian form; half up; negative and unreadable values are null."""
    t = F.regexp_replace(F.replace(c.cast("string"), F.lit("R$"), F.lit("")), r"[\s\x{A0}]", "")
    plain = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    value = plain.try_cast("decimal(38,18)")
    return F.when(value >= 0, (F.round(value, 2) * 100).cast("long"))


def number_to_cents(c: Column) -> Column:
    """Cents of a numeric column; its shortest text is rounded, not its binary value."""
    value = c.cast("string").try_cast("decimal(38,18)")
    return F.when(value >= 0, (F.round(value, 2) * 100).cast("long"))


def format_brl(cents: Column) -> Column:
    whole = F.translate(F.format_number(F.floor(cents / 100), 0), ",", ".")
    return F.when(cents.isNull(), "não informado").otherwise(F.concat(F.lit("R$ "), whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")))


def format_br_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit("não informada"))


def parse_feed_date(*cs: Column) -> Column:
    """The first of the columns that holds an ISO date or yyyyMMddHHmmss."""
    iso = [F.try_to_date(F.regexp_extract(c, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd") for c in cs]
    packed = [F.try_to_date(F.regexp_extract(c, "^([0-9]{8})[0-9]{6}$", 1), "yyyyMMdd") for c in cs]
    return F.coalesce(*[x for pair in zip(iso, packed) for x in pair])


def parse_br_date(c: Column) -> Column:
    return F.try_to_date(F.regexp_extract(c, "([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "dd/MM/yyyy")


def filing_date(c: Column, cnj_year: Column) -> Column:
    """The date of a cover unless it is more than a year off the number's: then it is of a redistribution."""
    day = parse_br_date(c)
    return F.when(F.abs(F.year(day) - cnj_year.cast("int")) <= 1, day)


def add_months(ts: Column, n: Column) -> Column:
    """Same day and time, the last day of a shorter month."""
    return ts + F.make_ym_interval(F.lit(0), n)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def month_start(ts: Column, zone: str = ZONE) -> Column:
    return F.trunc(local_date(ts, zone), "month")


def day_start_utc(ts: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(local_date(ts, zone).cast("timestamp"), zone)


def hearing_ts(day: Column, hour: Column, zone: str = ZONE) -> Column:
    """Local court time in UTC: a bad date is null, a bad hour midnight."""
    date = F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd")
    at = F.when(F.substring(hour, 1, 5).rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.substring(hour, 1, 5)).otherwise("00:00")
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), at), F.lit("yyyy-MM-dd HH:mm")), zone)


def calendar(spark: SparkSession, start: str, end: str, holidays: tuple[str, ...] = ()) -> DataFrame:
    """(d, is_biz, biz_idx, next_idx): business days so far, and the index of the first business day not before d.

    One row a day: some thousand rows for any range of years, so it may be broadcast.
    """
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS d")
    biz = ~F.dayofweek("d").isin(1, 7)
    if holidays:
        biz = biz & ~F.date_format("d", "yyyy-MM-dd").isin(*holidays)
    days = days.withColumn("is_biz", biz)
    so_far = F.sum(F.col("is_biz").cast("int")).over(Window.orderBy("d"))
    return days.withColumn("biz_idx", so_far).withColumn("next_idx", F.when(F.col("is_biz"), F.col("biz_idx")).otherwise(F.col("biz_idx") + 1))


def business_days(cal: DataFrame) -> DataFrame:
    """(idx, biz_day): the business days by number."""
    return cal.where("is_biz").select(F.col("biz_idx").alias("idx"), F.col("d").alias("biz_day"))


def next_business_day(df: DataFrame, cal: DataFrame, day: str, out: str) -> DataFrame:
    """``out``: ``day`` itself if it is a business day, else the next one."""
    a = F.broadcast(cal.select(F.col("d").alias(day), F.col("next_idx").alias("idx")))
    return df.join(a, day, "left").join(F.broadcast(business_days(cal).withColumnRenamed("biz_day", out)), "idx", "left").drop("idx")


def add_business_days(df: DataFrame, cal: DataFrame, day: str, n: str, out: str) -> DataFrame:
    """``out``: the ``n``-th business day after ``day``, which doesn't count itself."""
    a = F.broadcast(cal.select(F.col("d").alias(day), F.col("biz_idx").alias("from_")))
    joined = df.join(a, day, "left").withColumn("idx", F.col("from_") + F.col(n))
    return joined.join(F.broadcast(business_days(cal).withColumnRenamed("biz_day", out)), "idx", "left").drop("idx", "from_")


def deadline_end(df: DataFrame, cal: DataFrame, day: str, days: str, nature: str, out: str) -> DataFrame:
    """``out``: end of a deadline. A publication counts from the business day after it was made available; corridos count
    every day and roll forward to a business day, others business days alone; no days or fewer than one give null."""
    df = df.withColumn("day_after_", F.date_add(day, 1))
    df = next_business_day(df, cal, "day_after_", "published_")
    n = F.when(F.col(days) >= 1, F.col(days))
    df = df.withColumn("n_", n).withColumn("plain_", F.expr("date_add(published_, n_)"))
    df = next_business_day(df, cal, "plain_", "running_")
    df = add_business_days(df, cal, "published_", "n_", "working_")
    return df.withColumn(out, F.when(F.col(nature) == "corridos", F.col("running_")).otherwise(F.col("working_"))).drop("day_after_", "published_", "n_", "plain_", "running_", "working_")


def date_windows(start: Column, end: Column, n: int) -> Column:
    """The inclusive range cut into slices of n days: array<struct<first, last>>."""
    starts = F.sequence(start, end, F.make_dt_interval(F.lit(n)))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(F.date_add(s, n - 1), end).alias("last")))
