"""Accounts, keys, quotas, payments and tickets as tables.

Times are text in ISO form or timestamps, days are UTC dates; money is decimal(14,2).

Defined results: an account without a known plan, or one whose plan has run out, has the free plan; an own limit that is
null or negative gives way to the plan's; repeated payments and events count once; ties in time go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The plan of an account that has none; days a paid plan lasts beyond its period; states of payments that count.
FREE, GRACE_DAYS = "free", 3
PAID = {"COMPLETED": "paid", "PARTIALLY_REFUNDED": "partially refunded", "REFUNDED": "refunded"}
#: States of a suggestion, and the tickets that stand for them where none is set.
STATUSES, TICKETS = ["pending", "accepted", "dismissed"], ["open", "in_progress", "resolved", "closed"]
TICKET_OF = {"pending": "open", "accepted": "in_progress", "dismissed": "closed"}


# ---- plans and limits -------------------------------------------------------------------


def offers(plans: DataFrame) -> DataFrame:
    """(key, plan, label, interval, price, currency, requests, reads) of every plan (prices: struct<month, year, currency>) and interval with a price."""
    each = F.array(*[F.struct(F.lit(i).alias("interval"), F.col(f"prices.{i}").cast("decimal(14,2)").alias("price")) for i in ("month", "year")])
    sold = plans.select("plan", "label", F.coalesce("prices.currency", F.lit("USD")).alias("currency"), "requests", "reads", F.inline(each)).filter("price > 0")
    return sold.select(F.concat_ws("-", "plan", "interval").alias("key"), "plan", "label", "interval", "price", "currency", "requests", "reads")


def with_limits(accounts: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """accounts (plan, plan_until, own_requests, own_reads) with the plan in force and its limits."""
    known = plans.select(F.col("plan").alias("__plan"), F.col("label").alias("plan_label"), F.col("requests").alias("__requests"), F.col("reads").alias("__reads"))
    named = accounts.join(known.select(F.col("__plan").alias("plan"), F.lit(True).alias("__known")), "plan", "left")
    over = F.coalesce(F.col("plan_until") < now, F.lit(False))
    in_force = named.withColumn("__plan", F.when(F.col("__known") & ~over, F.col("plan")).otherwise(FREE)).join(known, "__plan", "left")
    own = lambda c, plan: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.col(plan))
    return in_force.withColumns({"effective_plan": F.col("__plan"), "limit_requests": own("own_requests", "__requests"), "limit_reads": own("own_reads", "__reads")}).drop("__plan", "__known", "__requests", "__reads")


def account_listing(users: DataFrame, accounts: DataFrame, keys: DataFrame, usage: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """Every user (uid, created, ...) with plan, limits, number of keys and the day's usage; who has none of these has the defaults."""
    counted = keys.groupBy("uid").agg(F.count("*").alias("keys"))
    used = usage.groupBy("uid").agg(F.sum("requests").alias("requests"), F.sum("reads").alias("reads"))
    joined = users.join(accounts, "uid", "left").join(counted, "uid", "left").join(used, "uid", "left")
    full = with_limits(joined.fillna({"plan": FREE}), plans, now)
    return full.fillna(0, ["keys", "requests", "reads"])


def newest_first(df: DataFrame, time: str, key: str, n: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc_nulls_last(time), key)
    return out if n is None else out.limit(n)


# ---- quotas -----------------------------------------------------------------------------


def spent(calls: DataFrame, keys: list[str], order: list[str], requests: Column, reads: Column) -> DataFrame:
    """calls (is_read) with admitted: a call is rejected beyond the requests of its keys, a reading one also beyond their reads; rejected ones do not count.

    The first ``reads`` reading calls and all others may pass, and of these the first ``requests`` do.
    """
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    nth_read = F.sum(F.col("is_read").cast("int")).over(w)
    eligible = ~F.col("is_read") | (nth_read <= reads)
    marked = calls.withColumn("__eligible", eligible)
    nth = F.sum(F.col("__eligible").cast("int")).over(w)
    return marked.withColumn("admitted", F.col("__eligible") & (nth <= requests)).drop("__eligible")


def flushed(store: DataFrame, pending: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """The stored counters with the pending increments added."""
    return store.select(*keys, *counters).unionByName(pending.select(*keys, *counters)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


# ---- payments ---------------------------------------------------------------------------


def gapless_numbers(df: DataFrame, series: Column, day: Column, order: list[str], name: str = "n") -> DataFrame:
    """df with a number from 1 without gaps in each series, by day and then order.

    Ranks are taken within a day, and the days' counts are summed up: no window holds more than a day of a series.
    """
    marked = df.withColumns({"__series": series, "__day": day})
    days = marked.groupBy("__series", "__day").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__series").orderBy("__day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("__series", "__day").orderBy(*order))
    numbered = marked.withColumn("__rank", rank).join(days.withColumn("__before", before).drop("__n"), ["__series", "__day"])
    return numbered.withColumn(name, (F.col("__before") + F.col("__rank")).cast("long")).drop("__series", "__day", "__before", "__rank")


def recorded(invoices: DataFrame, payments: DataFrame, prefix: str = "RP", width: int = 4) -> DataFrame:
    """(tx, number, status, year, ...) of all payments: known ones keep number and take the new state, which never leaves ``refunded``; new ones are numbered on.

    invoices: (tx, number, year, nth, status); payments: (tx, state, paid_at).
    """
    counts = payments.filter(F.col("state").isin(*PAID))
    state = F.element_at(F.create_map(*[F.lit(x) for p in PAID.items() for x in p]), F.col("state"))
    latest = counts.withColumn("status", state).groupBy("tx").agg(F.max_by("status", F.struct((F.col("status") == "refunded").cast("int").alias("gone"), "paid_at", "status")).alias("status"), F.min("paid_at").alias("paid_at"))
    known = invoices.withColumnRenamed("status", "__old").join(latest.select("tx", "status"), "tx", "left")
    kept = known.withColumn("status", F.when(F.col("__old") == "refunded", "refunded").otherwise(F.coalesce("status", "__old"))).select("tx", "number", "year", "nth", "status")
    year = F.year(F.to_timestamp("paid_at"))
    fresh = gapless_numbers(latest.join(invoices.select("tx"), "tx", "left_anti").withColumn("year", year), F.col("year"), F.to_date(F.to_timestamp("paid_at")), ["paid_at", "tx"], "__n")
    last = invoices.groupBy("year").agg(F.max("nth").alias("__last"))
    numbered = fresh.join(last, "year", "left").withColumn("nth", F.coalesce("__last", F.lit(0)).cast("long") + F.col("__n"))
    number = F.concat_ws("-", F.lit(prefix), F.col("year").cast("string"), F.when(F.length(F.col("nth").cast("string")) >= width, F.col("nth").cast("string")).otherwise(F.lpad(F.col("nth").cast("string"), width, "0")))
    return kept.unionByName(numbered.withColumn("number", number).select("tx", "number", "year", "nth", "status"))


def month_summary(invoices: DataFrame) -> DataFrame:
    """(month, currency, count, paid, refunded, net), newest month first by these columns."""
    back = F.col("status") == "refunded"
    money = lambda c, when, name: F.coalesce(F.sum(F.when(when, F.col(c).cast("decimal(14,2)"))), F.lit(0).cast("decimal(24,2)")).alias(name)
    return invoices.groupBy(F.substring("paid_at", 1, 7).alias("month"), "currency").agg(F.count("*").alias("count"), money("amount", ~back, "paid"), money("amount", back, "refunded"), money("net", ~back, "net"))


def recurring(subscriptions: DataFrame) -> DataFrame:
    """One row: active subscriptions and what they bring in a month."""
    monthly = F.col("price").cast("decimal(14,2)") / F.when(F.col("interval") == "year", 12).otherwise(1)
    active = F.col("status") == "ACTIVE"
    return subscriptions.agg(F.count_if(active).alias("active"), F.round(F.coalesce(F.sum(F.when(active, monthly)), F.lit(0)), 2).cast("decimal(14,2)").alias("mrr"))


def updated_plans(accounts: DataFrame, invoices: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """accounts (uid, plan, plan_until, plan_source) after payments: the plan of the latest paid period's end or next billing, and three days more.

    Where an admin has set the plan it stays; an account that was paid for and no longer is becomes free.
    """
    paid = invoices.filter(F.col("status").isin("paid", "partially refunded")).select("uid", "plan", F.col("period_end").alias("until"))
    billed = subscriptions.filter("status = 'ACTIVE'").select("uid", "plan", F.col("next_billing").alias("until"))
    last = paid.unionByName(billed).filter("until is not null").groupBy("uid").agg(F.max_by("plan", F.struct("until", "plan")).alias("__plan"), F.max("until").alias("__until"))
    joined = accounts.join(last, "uid", "left")
    own, has = F.coalesce(F.col("plan_source") == "admin", F.lit(False)), F.col("__plan").isNotNull()
    ended = ~has & F.coalesce(F.col("plan_source") == "billing", F.lit(False))
    until = F.timestamp_add("DAY", F.lit(GRACE_DAYS), F.col("__until"))
    pick = lambda c, new, gone: F.when(own, F.col(c)).when(has, new).when(ended, gone).otherwise(F.col(c))
    new = {"plan": pick("plan", F.col("__plan"), F.lit(FREE)), "plan_until": pick("plan_until", until, F.lit(None).cast("timestamp")), "plan_source": pick("plan_source", F.lit("billing"), F.lit("billing"))}
    return joined.select("uid", *[c.alias(n) for n, c in new.items()])


def handled_events(events: DataFrame, seen: DataFrame, invoices: DataFrame) -> DataFrame:
    """(id, subscription) of provider events not seen before, each once: a subscription's own id, a sale's agreement, or a refund's by its sale's invoice."""
    fresh = events.dropDuplicates(["id"]).join(seen.select("id"), "id", "left_anti")
    sold = invoices.select(F.col("tx").alias("sale_id"), F.col("subscription").alias("__by_sale"))
    kind = F.col("resource_type")
    found = F.when(kind == "subscription", F.col("resource_id")).when(kind == "sale", F.col("agreement_id")).when(kind == "refund", F.col("__by_sale"))
    return fresh.join(sold, "sale_id", "left").select("id", found.alias("subscription"))


# ---- tickets ----------------------------------------------------------------------------


def ticket_of(ticket: Column, status: Column) -> Column:
    named = F.element_at(F.create_map(*[F.lit(x) for p in TICKET_OF.items() for x in p]), status)
    return F.coalesce(F.nullif(ticket, F.lit("")), F.when(status.isin(*TICKET_OF), named), F.lit("open"))


def tickets(suggestions: DataFrame, status: str = "all", ticket: str = "all") -> DataFrame:
    """Suggestions of a status and ticket, with ticket and row_count in place of their rows (published, planned: arrays)."""
    told = suggestions.withColumn("ticket", ticket_of(F.col("ticket"), F.col("status")))
    chosen = told.filter((F.lit(status) == "all") | (F.col("status") == status)).filter((F.lit(ticket) == "all") | (F.col("ticket") == ticket))
    rows = F.when(F.col("published").isNotNull() | F.col("planned").isNotNull(), F.coalesce(F.size("published"), F.lit(0)) + F.coalesce(F.size("planned"), F.lit(0)))
    return chosen.withColumn("row_count", rows).drop("published", "planned")


# ---- paths ------------------------------------------------------------------------------

#: Pages of an account and of the admins, and the paths that need neither.
ADMIN_PAGES, ACCOUNT_PAGES = ["/dashboard", "/label", "/benchmark", "/models", "/media", "/helpdesk", "/users", "/billing"], ["/account", "/invoice"]
ACCOUNT_PATHS = r"^/api/account(/.*)?$|^/api/billing/(me|subscriptions(/[^/]+/(activate|cancel))?|invoices/[^/]+)$"
OPEN_PATHS = {"GET": r"^/api/openapi\.json$|^/api/auth/(config|me)$|^/api/billing/config$", "POST": r"^/api/auth/(session|logout)$|^/api/billing/webhook$"}
READING_PATHS = r"^/api/roster/upload$|^/api/acars/read$|^/api/ocr/upload$"
PUBLIC_PATHS = {"GET": r"^/api/airports(/[^/]+(/weather)?)?$", "POST": r"^/api/(roster|acars)/(suggestions|corrections)$|^/api/(night-time/calc|calendar/export|route-map)$|" + READING_PATHS}


def path_class(method: Column, path: Column) -> Column:
    """open, public, reading (public and counted as a read), account, admin or page, of a request's method and path; case and slashes at the end do not matter."""
    p = F.regexp_replace(F.lower(path), "/+$", "")
    p, m = F.when(p == "", "/").otherwise(p), F.when(F.upper(method) == "HEAD", "GET").otherwise(F.upper(method))
    of = lambda table: F.coalesce(*[F.when(m == k, p.rlike(v)) for k, v in table.items()], F.lit(False))
    return (
        F.when(of(OPEN_PATHS), "open").when((m == "POST") & p.rlike(READING_PATHS), "reading").when(of(PUBLIC_PATHS), "public").when(p.rlike(ACCOUNT_PATHS) | p.isin(ACCOUNT_PAGES), "account")
        .when(p.startswith("/api/") | p.isin(ADMIN_PAGES), "admin").otherwise("page")
    )
