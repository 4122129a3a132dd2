"""Customer value: frequency, repeat purchase, cohorts and RFM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallworks.functions.expressions import (
    calendar_days,
    money,
    month_label,
    months_apart,
    pct,
)
from stallworks.operators.grain import (
    DELIVERED,
    known_valid,
    order_value,
    person_activity,
    person_days,
    person_months,
    valid_orders,
)
from stallworks.operators.ranking import with_rank, written
from stallworks.operators.shaping import (
    histogram,
    mean_and_lower_median,
    share_of_total,
    top_k,
)
from stallworks.sources.tables import Tables

# Width of the logarithmic bins in which RFM looks for its cut in amounts.
_BINS_PER_DOUBLING = 64


def cust_id_vs_person(t: Tables) -> DataFrame:
    """Order-level ids against real people; each count reads only its own column."""
    customers = t["customers"]
    return customers.agg(
        F.count_distinct("customer_id").alias("customer_ids"),
        F.count("*").alias("customer_rows"),
    ).select(
        "customer_ids",
        customers.agg(F.count_distinct("customer_unique_id")).scalar().alias("persons"),
        "customer_rows",
    )


def cust_frequency(t: Tables, status: str = DELIVERED) -> DataFrame:
    counts = (
        person_activity(t, status)
        .groupBy(F.col("orders").alias("order_cnt"))
        .agg(F.count("*").alias("persons"))
    )
    return share_of_total(counts, "persons", "pct").orderBy("order_cnt")


def cust_repeat_rate(t: Tables, min_orders: int = 2, status: str = DELIVERED) -> DataFrame:
    return (
        person_activity(t, status)
        .agg(
            F.count("*").alias("buyers"),
            F.count_if(F.col("orders") >= min_orders).alias("repeat_buyers"),
        )
        .withColumn("repeat_pct", pct(F.col("repeat_buyers"), F.col("buyers")))
    )


def cust_new_by_month(t: Tables, status: str = DELIVERED) -> DataFrame:
    return (
        person_activity(t, status)
        .groupBy(F.col("first_month").alias("month"))
        .agg(F.count("*").alias("new_persons"))
        .orderBy("month")
        .select(month_label(F.col("month")).alias("first_ym"), "new_persons")
    )


def repeat_gaps(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Histogram of the days between a person's neighbouring orders.

    Gaps are differences of dates, so orders fold into (person, day) counts first: n
    orders on one day are n - 1 gaps of zero, and each day adds one gap to the day
    before. A person then owns at most one row per calendar day, however many orders.
    """
    days = person_days(t, status)
    before = F.lag("day").over(Window.partitionBy("person").orderBy("day"))
    steps = days.withColumn("gap", F.datediff("day", before)).select(
        F.inline(
            F.array(
                F.struct(F.col("gap").alias("gap"), F.lit(1).cast("bigint").alias("times")),
                F.struct(F.lit(0).alias("gap"), (F.col("orders") - 1).alias("times")),
            )
        )
    )
    return histogram(steps.filter(F.col("gap").isNotNull()), "gap", weight=F.col("times"))


def cust_repeat_gap(t: Tables, status: str = DELIVERED) -> DataFrame:
    return mean_and_lower_median(
        repeat_gaps(t, status), "avg_gap", "median_gap", "gaps"
    ).drop("gaps")


def cust_cohort_retention(t: Tables, status: str = DELIVERED) -> DataFrame:
    """People of each first-purchase month who buy again in later months.

    The window sees distinct (person, month) rows, so a person is one row per month at most.
    """
    months = person_months(t, status)
    cohort = F.min("month").over(Window.partitionBy("person"))
    active = (
        months.withColumn("cohort", cohort)
        .groupBy("cohort", "month")
        .agg(F.count("*").alias("users"))
    )
    # The cohort's own month holds all of its people, and is its earliest row.
    size = F.first("users").over(Window.partitionBy("cohort").orderBy("month"))
    return (
        active.withColumn("cohort_size", size)
        .orderBy("cohort", "month")
        .select(
            month_label(F.col("cohort")).alias("first_ym"),
            month_label(F.col("month")).alias("purchase_ym"),
            (months_apart(F.col("cohort"), F.col("month")) + 1).alias("period"),
            "users",
            "cohort_size",
            pct(F.col("users"), F.col("cohort_size")).alias("retention_pct"),
        )
    )


def person_rfm(t: Tables, status: str = DELIVERED) -> DataFrame:
    """person -> days since the last purchase (from the latest one of all), orders, GMV in cents."""
    placed = valid_orders(t["orders"], status).select(
        "order_id", "customer_id", "order_purchase_timestamp"
    )
    values = order_value(known_valid(t["order_items"], status)).select("order_id", "gmv")
    valued = placed.join(values, "order_id", "left")
    per_customer = valued.groupBy("customer_id").agg(
        F.max("order_purchase_timestamp").alias("last"),
        F.count("*").alias("f_orders"),
        F.sum("gmv").alias("m_gmv"),
    )
    people = t["customers"].select("customer_id", F.col("customer_unique_id").alias("person"))
    per_person = (
        per_customer.join(people, "customer_id")
        .groupBy("person")
        .agg(
            F.max("last").alias("last"),
            F.sum("f_orders").alias("f_orders"),
            F.sum("m_gmv").alias("m_gmv"),
        )
    )
    latest = placed.agg(F.max("order_purchase_timestamp")).scalar()
    return per_person.select(
        "person",
        calendar_days(F.col("last"), latest).cast("bigint").alias("r_days"),
        "f_orders",
        "m_gmv",
    )


def rfm_bands(t: Tables, top_pct: int = 30, status: str = DELIVERED) -> DataFrame:
    """Every person with R, F and M bands; the best ``top_pct`` percent are near/high.

    Smaller keys are better. An unknown last purchase sorts first and an unknown amount last, as
    NULLs do in ascending and descending order; ties go by person. A measure needs only its cut,
    the key of the last person inside the top share, against which all people are compared
    without a join. The cut is found in two steps: a histogram over bins that keep the order
    (days, orders, logarithms of amounts: bounded whatever the number of people) tells the bin
    it is in, and only the people of that bin are ranked.
    """
    people = written(person_rfm(t, status))
    m = F.col("m_gmv")
    keys = {"r": F.col("r_days"), "f": -F.col("f_orders"), "m": -m}
    bins = {
        "r": F.col("r_days"),
        "f": -F.col("f_orders"),
        "m": -F.signum(m) * F.floor(F.log2(F.abs(m) + 1) * _BINS_PER_DOUBLING),
    }

    def position(name: str) -> Column:
        key = keys[name]
        unknown = key.isNotNull() if name == "r" else key.isNull()
        return F.struct(unknown.alias("side"), key.alias("key"), F.col("person"))

    entries = people.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("measure"),
                        F.coalesce(bins[name].cast("bigint"), F.lit(0)).alias("bin"),
                        position(name).alias("at"),
                    )
                    for name in keys
                ]
            )
        )
    ).select("measure", "bin", "at.*")
    order = Window.partitionBy("measure").orderBy("side", "bin")
    upto = F.sum("n").over(order)
    inside = F.expr(f"sum(n) OVER (PARTITION BY measure) * {int(top_pct)} DIV 100")
    edges = (
        entries.groupBy("measure", "side", "bin")
        .agg(F.count("*").alias("n"))
        .select("measure", "side", "bin", (upto - F.col("n")).alias("before"), upto.alias("upto"),
                inside.alias("inside"))
        .filter("before < inside AND inside <= upto")
        .select("measure", "side", "bin", (F.col("inside") - F.col("before")).alias("nth"))
    )
    # Three rows at most, one per measure.
    tied = entries.join(F.broadcast(edges), ["measure", "side", "bin"]).drop("bin")
    ranked = with_rank(tied, *[F.col(c) for c in ("measure", "side", "key", "person")])
    starts = ranked.groupBy("measure").agg(F.min("rn").alias("first_rn"))
    cut_rows = ranked.join(F.broadcast(starts), "measure").filter("rn = first_rn - 1 + nth")
    place = F.struct("side", "key", "person")
    cut = cut_rows.agg(
        F.struct(*[F.max(F.when(F.col("measure") == name, place)).alias(name) for name in keys])
    ).scalar()

    def banded(name: str, best: str, rest: str) -> Column:
        # A NULL cut means that nobody is inside; the comparison is then not true.
        is_inside = position(name) <= cut.getField(name)
        return F.when(is_inside, best).otherwise(rest).alias(f"{name}_band")

    return people.select(
        "person",
        "r_days",
        "f_orders",
        "m_gmv",
        banded("r", "near", "far"),
        banded("f", "high", "low"),
        banded("m", "high", "low"),
    )


def cust_rfm(t: Tables, top_pct: int = 30, k: int = 20, status: str = DELIVERED) -> DataFrame:
    bands = rfm_bands(t, top_pct, status)
    return top_k(bands, k, F.desc_nulls_last("m_gmv"), F.col("person")).withColumn(
        "m_gmv", money(F.col("m_gmv"))
    )
