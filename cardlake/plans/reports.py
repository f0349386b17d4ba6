"""Registered queries on entities, periods, versions, tests with their tail probabilities, and checks of features."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.operators import drift, evaluation, experiments, feedback, metrics, models, stats
from cardlake.operators import features as ft
from cardlake.operators.quantiles import so_far, with_quantiles
from cardlake.plans import sql
from cardlake.plans.decisions import _ACTION, _DAILY, _ENDS, daily_metrics, responses
from cardlake.plans.monitoring import _CONSENSUS, _VARIANT, given, sides
from cardlake.plans.queries import _SIDES, query, r6, scored
from cardlake.sources import records, versions
from cardlake.sources.tables import read, transactions

# ---- entities ----

_HOURS = {"user": "user_id", "device": "device", "email": "p_email"}
_FIRST = {"account": "user_id", "card": "card1", "merchant": "user_id, product", "address": "addr1"}
_D = "86400000000.0::DOUBLE"


@query(f"""SELECT transaction_id, {", ".join(f"sum(f_{a}) OVER (PARTITION BY {k} ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING)::BIGINT AS {a}" for a, k in
       (("emails_per_card", "card1"), ("cards_per_email", "p_email"), ("merchants_per_user_month", "user_id, date_trunc('month', ts)"), ("cards_per_user", "user_id")))},
       {", ".join(f"count(*) OVER (PARTITION BY {k}, CAST(ts AS DATE) ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING) AS day_count_{n}" for n, k in (("email", "p_email"), ("card", "card1"), ("product", "product")))},
       round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY card1))) / {_D}, 6) AS days_of_card, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY addr1))) / {_D}, 6) AS days_of_address
       FROM (SELECT *, {", ".join(f"CASE WHEN row_number() OVER (PARTITION BY {k} ORDER BY ts, transaction_id) = 1 THEN 1 ELSE 0 END AS f_{a}" for a, k in
       (("emails_per_card", "card1, p_email"), ("cards_per_email", "p_email, card1"), ("merchants_per_user_month", "user_id, date_trunc('month', ts), product"), ("cards_per_user", "user_id, card1")))} FROM txn)""")  # fmt: skip
def entity_counts_of_the_day_and_so_far(spark, sf_dir):
    """Distinct cards, e-mails and merchants so far by entity, counts of the day so far, and days since first use. Rows meet by card, then by user, as windows; keys of few values are summed up by parts of time."""
    t = transactions(spark, sf_dir).select("transaction_id", "ts", "user_id", "card1", "p_email", "product", "addr1", F.to_date("ts").alias("day"), F.date_trunc("month", "ts").alias("month"))
    ordered = ("day", "ts", "transaction_id")  # the day's rows and all rows of a key share a sort
    cards = t.repartition("card1").withColumns({"of_pair": ft.first_seen("card1", "p_email"), "of_card": ft.first_seen("card1", "user_id")})
    cards = cards.withColumns({"emails_per_card": F.sum("of_pair").over(ft.in_time("card1", order=ordered)), "_first": F.min("ts").over(ft.in_time("card1", order=ordered)), "day_count_card": F.count("*").over(ft.in_time("card1", "day"))})
    users = cards.repartition("user_id").withColumn("of_month", ft.first_seen("user_id", "month", "product"))
    users = users.withColumns({"merchants_per_user_month": F.sum("of_month").over(ft.in_time("user_id", "month")), "cards_per_user": F.sum("of_card").over(ft.in_time("user_id", order=("month", "ts", "transaction_id")))})
    held = records.stored(users.drop("user_id", "card1", "month", "of_card", "of_month"), "entities")
    one = F.lit(1)
    told = so_far(held, {"cards_per_email": (("p_email",), F.col("of_pair")), "day_count_email": (("p_email", "day"), one), "day_count_product": (("product", "day"), one)}, {"_address": ("addr1",)}, order=ordered)
    since = lambda c: r6((F.unix_micros("ts") - F.unix_micros(c)) / 86_400_000_000.0)
    counts = ("emails_per_card", "cards_per_email", "merchants_per_user_month", "cards_per_user", "day_count_email", "day_count_card", "day_count_product")
    return told.select("transaction_id", *counts, since("_first").alias("days_of_card"), since("_address").alias("days_of_address"))


@query(f"""SELECT transaction_id, {", ".join(f"round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY {k}))) / {_D}, 6) AS days_since_{n}" for n, k in _FIRST.items())},
       {", ".join(f"round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {k} ORDER BY ts, transaction_id))) / 3600000000.0::DOUBLE, 6) AS hours_since_{n}" for n, k in _HOURS.items())} FROM txn""")  # fmt: skip
def time_deltas_by_entity(spark, sf_dir):
    """Days since an entity was first seen and hours since its last transaction. Rows meet by card, device and user, as windows; addresses and e-mails, of few values, are taken by parts of time."""
    t = transactions(spark, sf_dir).select("transaction_id", "ts", "user_id", "card1", "product", "addr1", "device", "p_email")
    t = t.repartition("card1").withColumn("card", F.min("ts").over(Window.partitionBy("card1"))).drop("card1")
    of = lambda *k: Window.partitionBy(*k).orderBy("ts", "transaction_id")
    t = t.repartition("device").withColumn("of_device", F.lag("ts").over(of("device"))).drop("device")
    t = t.repartition("user_id").withColumns({"account": F.min("ts").over(ft.in_time("user_id")), "user": F.lag("ts").over(of("user_id")), "merchant": F.min("ts").over(Window.partitionBy("user_id", "product"))})
    held = records.stored(t.drop("user_id", "product"), "entities")
    told = so_far(held, {}, {"address": ("addr1",)}, {"email": ("p_email",)})
    since = lambda c, unit: r6((F.unix_micros("ts") - F.unix_micros(c)) / unit)
    hours = {"user": "user", "device": "of_device", "email": "email"}
    return told.select("transaction_id", *[since(n, 86_400_000_000.0).alias(f"days_since_{n}") for n in _FIRST], *[since(c, 3.6e9).alias(f"hours_since_{n}") for n, c in hours.items()])


@query("""SELECT transaction_id, round(d / a::DOUBLE, 6) AS day_share FROM (SELECT transaction_id, sum(fd) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING) AS d,
       sum(fa) OVER (PARTITION BY user_id ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING) AS a FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), product ORDER BY ts, transaction_id) = 1 THEN 1 ELSE 0 END AS fd,
       CASE WHEN row_number() OVER (PARTITION BY user_id, product ORDER BY ts, transaction_id) = 1 THEN 1 ELSE 0 END AS fa FROM txn))""")  # fmt: skip
def merchant_share_of_the_day(spark, sf_dir):
    """Distinct merchants of the day so far among all of the user's so far."""
    t = transactions(spark, sf_dir).repartition("user_id").withColumn("day", F.to_date("ts"))
    t = t.withColumns({"fd": ft.first_seen("user_id", "day", "product"), "fa": ft.first_seen("user_id", "product")})
    upto = lambda *k: Window.partitionBy(*k).orderBy("ts", "transaction_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("transaction_id", r6(F.sum("fd").over(upto("user_id", "day")) / F.sum("fa").over(upto("user_id"))).alias("day_share"))


@query("""SELECT transaction_id, round(CASE WHEN n > 0 THEN (SELECT count(*) FROM txn AS e WHERE e.user_id = t.user_id AND (e.ts, e.transaction_id) < (t.ts, t.transaction_id) AND e.amount < t.amount) / n::DOUBLE END, 6) AS percentile
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, transaction_id) - 1 AS n FROM txn) AS t""")  # fmt: skip
def amount_percentile_of_user(spark, sf_dir):
    """The share of the user's earlier transactions with smaller amounts; no later one has a part in it."""
    ranked = ft.rank_before(transactions(spark, sf_dir).select("transaction_id", "user_id", "ts", "amount"), "user_id", "amount")
    return ranked.select("transaction_id", r6(F.when(F.col("earlier") > 0, F.col("smaller") / F.col("earlier"))).alias("percentile"))


@query("""SELECT transaction_id, round(amount * velocity, 6) AS amount_velocity, round(amount / greatest(hour(ts), 1)::DOUBLE, 6) AS amount_per_hour, CAST(is_high_amount AND is_unusual_hour AS INT) AS high_and_unusual FROM feat""", sql.PROFILE)
def interaction_features(spark, sf_dir):
    from cardlake.plans.queries import profiled

    both = (F.col("is_high_amount") & F.col("is_unusual_hour")).cast("int")
    return profiled(spark, sf_dir).select("transaction_id", r6(F.col("amount") * F.col("velocity")).alias("amount_velocity"), r6(F.col("amount") / F.greatest("hour", F.lit(1))).alias("amount_per_hour"), both.alias("high_and_unusual"))


# ---- checks of features ----


@query("SELECT transaction_id, coalesce(try_cast(CASE WHEN transaction_id % 7 = 0 THEN '' WHEN transaction_id % 11 = 0 THEN product ELSE CAST(k AS VARCHAR) END AS DOUBLE), 0) AS number FROM txn")
def safe_numeric_cast(spark, sf_dir):
    """Texts that are empty or no number are 0."""
    text = F.when(F.col("transaction_id") % 7 == 0, "").when(F.col("transaction_id") % 11 == 0, F.col("product")).otherwise(F.col("k").cast("string"))
    return models.aligned(transactions(spark, sf_dir).withColumn("number", text), ("number",)).select("transaction_id", F.col("f_number").alias("number"))


_CODE = "('0x' || substr(md5(coalesce({c}, 'unknown')), 1, 12))::BIGINT % 1000"


@query(f"SELECT transaction_id, product, ({_CODE.format(c='product')})::INT AS product_code, p_email, ({_CODE.format(c='p_email')})::INT AS email_code FROM txn")
def hash_encode_category(spark, sf_dir):
    return transactions(spark, sf_dir).select("transaction_id", "product", ft.hash_code("product").alias("product_code"), "p_email", ft.hash_code("p_email").alias("email_code"))


@query("SELECT transaction_id, amount AS f_amount, CAST(k AS DOUBLE) AS f_k, 0.0::DOUBLE AS f_distance, 0.0::DOUBLE AS f_p_email FROM txn")
def feature_vector_alignment(spark, sf_dir):
    """A model's features in its order; one that the table lacks, or that is no number, is 0."""
    names = ("amount", "k", "distance", "p_email")
    return models.aligned(transactions(spark, sf_dir), names).select("transaction_id", *[f"f_{c}" for c in names])


@query("SELECT transaction_id, CASE WHEN k = 0 THEN 0 ELSE round(greatest(least(3 * fraud_score - 0.2::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE), 6) END::DOUBLE AS score FROM scored", sql.SCORED)
def clipped_scores(spark, sf_dir):
    """Scores that are no number or infinite (here those with k = 0) are 0, others lie between 0 and 1."""
    raw = F.when((F.col("k") == 0) & F.col("is_rapid"), float("nan")).when(F.col("k") == 0, float("inf")).otherwise(3 * F.col("fraud_score") - 0.2)
    return scored(spark, sf_dir).select("transaction_id", r6(models.clipped(raw)).alias("score"))


_OLD, _NEW = ("amount", "k", "addr1", "dt", "user_id"), ("amount", "k", "addr1", "dt", "card1")


@query(f"SELECT f AS feature, round(r, 6) AS reference, round(c, 6) AS current FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{f}{chr(39)} AS f, avg({f}) FILTER (WHERE ref = 1) AS r, avg({f}) FILTER (WHERE ref = 0) AS c FROM sides' for f in ('addr1', 'amount', 'dt', 'k'))})", _SIDES)
def feature_set_intersection(spark, sf_dir):
    """Means of the features that the reference and the current rows both have; fewer than 80 % in common is an error."""
    both = sides(spark, sf_dir)
    names = drift.common_features(_OLD, _NEW)
    side = lambda f, ref: F.avg(F.when(F.col("is_reference") == ref, F.col(f)))
    one = both.agg(*[side(f, ref).alias(f"{f}:{ref}") for f in names for ref in (True, False)])
    rows = [F.struct(F.lit(f).alias("feature"), r6(F.col(f"`{f}:True`")).alias("reference"), r6(F.col(f"`{f}:False`")).alias("current")) for f in names]
    return one.select(F.inline(F.array(*rows)))


# ---- profiles ----


@query("SELECT feature, count(DISTINCT value) AS n_distinct, round(1 - count(value) / count(*)::DOUBLE, 6) AS missing FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM txn" for c in ("product", "device", "p_email")) + ") GROUP BY 1")
def categorical_summary(spark, sf_dir):
    names = ["product", "device", "p_email"]
    by = transactions(spark, sf_dir).select(*names).unpivot([], names, "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n"))
    there = F.col("value").isNotNull()
    return by.groupBy("feature").agg(F.count_if(there).alias("n_distinct"), r6(F.try_divide(F.sum(F.when(~there, F.col("n")).otherwise(0)), F.sum("n"))).alias("missing"))


_TABLES = (("product", "product"), ("hour", "CAST(hour(ts) AS VARCHAR)"), ("day", "CAST(isodow(ts) - 1 AS VARCHAR)"), ("p_email", "p_email"))


@query("SELECT feature, value, round(n / sum(n) OVER (PARTITION BY feature)::DOUBLE, 6) AS share FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {e} AS value, count(*) AS n FROM txn GROUP BY 2" for f, e in _TABLES) + ")")
def frequency_tables(spark, sf_dir):
    """Shares of products, hours, week days and e-mail domains; missing domains are a value."""
    t = transactions(spark, sf_dir).select("product", F.hour("ts").cast("string").alias("hour"), F.weekday("ts").cast("string").alias("day"), "p_email")
    counts = t.unpivot([], t.columns, "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.select("feature", "value", r6(F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("share"))


@query("""SELECT value, round(n / t::DOUBLE, 6) AS share FROM (SELECT product AS value, count(*) AS n, sum(count(*)) OVER () AS t, row_number() OVER (ORDER BY count(*) DESC, product) AS nth FROM txn WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1) WHERE nth <= 10""")
def baseline_categories(spark, sf_dir):
    counts = transactions(spark, sf_dir).filter("ts < '2024-01-16'").groupBy(F.col("product").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.orderBy(F.desc("n"), "value").limit(10).crossJoin(F.broadcast(total)).select("value", r6(F.col("n") / F.col("t")).alias("share"))  # one row


_EDGES = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


@query("SELECT le::DOUBLE AS le, count(*) FILTER (WHERE amount <= le) AS n FROM txn, (VALUES " + ", ".join(f"({e})" for e in _EDGES) + ") t(le) GROUP BY 1")
def latency_histogram(spark, sf_dir):
    one = transactions(spark, sf_dir).agg(*[F.count_if(F.col("amount") <= e).alias(str(e)) for e in _EDGES])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(str(e)).alias("n")) for e in _EDGES])))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, round(avg(is_fraud), 6) AS fraud_rate, round(count(*) FILTER (WHERE s >= 0.3 AND is_fraud = 0) / greatest(count(*) FILTER (WHERE is_fraud = 0), 1)::DOUBLE, 6) AS fpr
       FROM (SELECT *, round(fraud_score, 6) AS s FROM scored) GROUP BY 1""", sql.SCORED)  # fmt: skip
def rates_by_window(spark, sf_dir):
    legit = F.col("is_fraud") == 0
    by = scored(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return by.agg(r6(F.avg("is_fraud")).alias("fraud_rate"), r6(F.count_if(legit & (r6("fraud_score") >= 0.3)) / F.greatest(F.count_if(legit), F.lit(1))).alias("fpr"))


@query("SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS users, true AS is_close FROM txn GROUP BY 1")
def distinct_sketches(spark, sf_dir):
    """Users by day from hourly sketches that are merged, against the exact number: within a twentieth."""
    t = transactions(spark, sf_dir)
    hourly = t.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("sketch"))
    daily = hourly.groupBy(F.to_date("hour").alias("date")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = t.groupBy(F.to_date("ts").alias("date")).agg(F.countDistinct("user_id").alias("users"))
    return daily.join(exact, "date").select("date", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.col("users") / 20).alias("is_close"))


@query("SELECT hour(ts) AS hour, count(*) AS transactions, round(sum(is_fraud) / greatest(count(*), 1)::DOUBLE, 6) AS fraud_rate FROM txn WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def fraud_rate_by_hour_in_range(spark, sf_dir, start: str = "2024-01-05", end: str = "2024-01-20"):
    """The range is filtered on the stored column, so it reaches the scan."""
    e = read(spark, sf_dir, "events").filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    fraud = (F.get_json_object("props", "$.k").cast("int") < 3).cast("int")
    by = e.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("transactions"), F.sum(fraud).alias("p"))
    return by.select("hour", "transactions", r6(F.col("p") / F.greatest("transactions", F.lit(1))).alias("fraud_rate")).orderBy("hour")


#: Days that each table is kept, and the parts that expire as a whole.
AGES = {"transactions": (730, "month"), "features": (365, "month"), "results": (180, "month"), "risk": (90, "month"), "profiles": (30, "day"), "velocity": (1, "day")}


@query("SELECT t AS name, count(*) FILTER (WHERE ts >= m - to_days(d)) AS kept, count(*) FILTER (WHERE CASE p WHEN 'month' THEN date_trunc('month', ts) >= date_trunc('month', m - to_days(d)) ELSE CAST(ts AS DATE) >= CAST(m - to_days(d) AS DATE) END) AS stored FROM txn, (SELECT max(ts) AS m FROM txn), (VALUES " + ", ".join(f"('{k}', {d}, '{p}')" for k, (d, p) in AGES.items()) + ") v(t, d, p) GROUP BY 1")
def retention_by_table(spark, sf_dir):
    """Six tables by their ages: parts that ended before expire by a commit record alone (stored: the rows left), and readers leave out the rest (kept)."""
    t = transactions(spark, sf_dir).select("transaction_id", "user_id", "ts", "amount")
    as_of, parts = t.agg(F.max("ts").alias("m")).first()[0], []
    for name, (days, part) in AGES.items():
        table = versions.Table(spark, records.scratch(spark, name), t.schema, part)
        table.append(t)
        limit = F.lit(as_of) - F.expr(f"interval {days} days")
        day = (as_of - timedelta(days=days)).strftime("%Y-%m-%d") if as_of else "0001-01-01"
        table.expire(day)
        parts.append(table.read(since=day).agg(F.lit(name).alias("name"), F.count_if(F.col("ts") >= limit).alias("kept")).crossJoin(table.read().agg(F.count("*").alias("stored"))))  # one row each
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM txn WHERE EXISTS (SELECT 1 FROM acted WHERE action = 'immediate_block' AND acted.user_id = txn.user_id AND txn.ts > acted.ts AND txn.ts <= acted.ts + INTERVAL 1 DAY)""", _ACTION)
def unexpired_blocks(spark, sf_dir):
    """Transactions of users under a block that had not expired: the user's latest block before each one decides."""
    from cardlake.operators import alerts as al

    blocks = al.routed(responses(spark, sf_dir)).filter("blocks").select("user_id", "ts", F.lit(None).cast("long").alias("transaction_id"), F.col("expires_at"))
    both = transactions(spark, sf_dir).select("user_id", "ts", "transaction_id", F.lit(None).cast("timestamp").alias("expires_at")).unionByName(blocks)
    until = F.max("expires_at").over(Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1))
    held = both.withColumn("until", until).filter("transaction_id is not null and until >= ts")
    return held.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# ---- feedback ----


@query("""SELECT CASE WHEN q >= 0.8 THEN 'high' WHEN q >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(consensus), 4) AS consensus FROM (
       SELECT transaction_id, consensus, round(least(1.0::DOUBLE, (consensus + least(0.2::DOUBLE, count(*) * 0.1::DOUBLE)) * avg(accuracy) * avg(confidence)), 6) AS q FROM fb JOIN agreed USING (transaction_id) GROUP BY 1, 2) GROUP BY 1""", _CONSENSUS)  # fmt: skip
def feedback_quality_bands(spark, sf_dir):
    as_of = transactions(spark, sf_dir).agg(F.max("ts").alias("as_of"))
    q = r6("quality")
    return feedback.weights(given(spark, sf_dir), as_of).groupBy(F.when(q >= 0.8, "high").when(q >= 0.6, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("consensus"), 4).alias("consensus"))


@query("""SELECT count(*) AS n, round(avg(CAST(label = 'fraud' AS INT)), 6) AS fraud_rate, round(avg(q), 4) AS quality FROM (SELECT transaction_id, agreed.label, least(1.0::DOUBLE, (consensus + least(0.2::DOUBLE, count(*) * 0.1::DOUBLE)) * avg(accuracy) * avg(confidence)) AS q
       FROM fb JOIN agreed USING (transaction_id) GROUP BY 1, 2, consensus)""", _CONSENSUS)  # fmt: skip
def training_batch_summary(spark, sf_dir):
    fb = given(spark, sf_dir)
    w = feedback.weights(fb, transactions(spark, sf_dir).agg(F.max("ts").alias("as_of"))).select("transaction_id", "quality")
    both = feedback.consensus(fb).join(w, "transaction_id")
    return both.agg(F.count("*").alias("n"), r6(F.avg((F.col("label") == "fraud").cast("int"))).alias("fraud_rate"), F.round(F.avg("quality"), 4).alias("quality"))


# ---- evaluation ----

_CELLS = "count(*) FILTER (WHERE s >= 0.3 AND is_fraud = 1) AS tp, count(*) FILTER (WHERE s < 0.3 AND is_fraud = 0) AS tn, count(*) FILTER (WHERE s >= 0.3 AND is_fraud = 0) AS fp, count(*) FILTER (WHERE s < 0.3 AND is_fraud = 1) AS fn"
_RATES = {"precision": "tp / greatest(tp + fp, 1)::DOUBLE", "recall": "tp / greatest(tp + fn, 1)::DOUBLE", "f1": "2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE", "accuracy": "(tp + tn) / greatest(tp + tn + fp + fn, 1)::DOUBLE", "fpr": "fp / greatest(fp + tn, 1)::DOUBLE", "fnr": "fn / greatest(tp + fn, 1)::DOUBLE"}
_AUC = "(SELECT {g}, sum((n - p) * (hit - p / 2.0::DOUBLE)) / nullif(max(ap * (an - ap)), 0) AS auc FROM (SELECT *, sum(p) OVER (PARTITION BY {g} ORDER BY s DESC) AS hit, sum(p) OVER (PARTITION BY {g}) AS ap, sum(n) OVER (PARTITION BY {g}) AS an FROM (SELECT {e}, fraud_score AS s, count(*) AS n, sum(is_fraud) AS p FROM scored GROUP BY ALL)) GROUP BY ALL)"
_VERSION = "'v' || CAST(user_id % 2 AS VARCHAR) AS version"


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumns({"version": F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")), "date": F.to_date("ts")})


@query(f"""SELECT date, version, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT date, version, volume::DOUBLE AS volume, fraud_rate, latency, p95, auc, {", ".join(f"{e} AS {n}" for n, e in _RATES.items())} FROM (
       SELECT CAST(ts AS DATE) AS date, {_VERSION}, count(*) AS volume, avg(is_fraud) AS fraud_rate, avg(amount) AS latency, quantile_cont(amount, 0.95) AS p95, {_CELLS} FROM (SELECT *, round(fraud_score, 6) AS s FROM scored) GROUP BY 1, 2)
       LEFT JOIN {_AUC.format(g="date, version", e=f"CAST(ts AS DATE) AS date, {_VERSION}")} USING (date, version))
       ON volume, fraud_rate, latency, p95, auc, {", ".join(_RATES)} INTO NAME metric VALUE value)""", sql.SCORED)  # fmt: skip
def model_performance_by_version(spark, sf_dir):
    """Eleven metrics of each day and model version, a row each; a metric that is not defined (AUC of one label) has none."""
    s, keys = _versioned(spark, sf_dir), ["date", "version"]
    by = s.groupBy(*keys).agg(F.count("*").cast("double").alias("volume"), F.avg("is_fraud").alias("fraud_rate"), F.avg("amount").alias("latency"), *evaluation.cells(r6("fraud_score") >= 0.3, F.col("is_fraud") == 1))
    rated = by.withColumns(evaluation.rates())
    full = with_quantiles(rated, s, keys, "amount", {"p95": 0.95}).join(evaluation.auc_by(s, keys, "fraud_score", "is_fraud"), keys, "left")
    names = ["volume", "fraud_rate", "latency", "p95", "auc", *evaluation.rates()]
    return full.select(*keys, *names).unpivot(keys, names, "metric", "value").filter("value is not null").withColumn("value", r6("value"))


@query(f"""SELECT metric, round(a, 6) AS before, round(b, 6) AS after, round(b - a, 6) AS change FROM (SELECT metric, max(value) FILTER (WHERE version = 'v0') AS a, max(value) FILTER (WHERE version = 'v1') AS b FROM (
       UNPIVOT (SELECT version, auc, {", ".join(f"{e} AS {n}" for n, e in _RATES.items())} FROM (SELECT {_VERSION}, {_CELLS} FROM (SELECT *, round(fraud_score, 6) AS s FROM scored) GROUP BY 1)
       LEFT JOIN {_AUC.format(g="version", e=_VERSION)} USING (version)) ON auc, {", ".join(_RATES)} INTO NAME metric VALUE value) GROUP BY 1)""", sql.SCORED)  # fmt: skip
def evaluation_metric_deltas(spark, sf_dir):
    s = _versioned(spark, sf_dir)
    by = s.groupBy("version").agg(*evaluation.cells(r6("fraud_score") >= 0.3, F.col("is_fraud") == 1)).withColumns(evaluation.rates())
    names = ["auc", *evaluation.rates()]
    long = by.join(evaluation.auc_by(s, ["version"], "fraud_score", "is_fraud"), "version").unpivot("version", names, "metric", "value")
    of = lambda v: F.max(F.when(F.col("version") == v, F.col("value")))
    return long.groupBy("metric").agg(r6(of("v0")).alias("before"), r6(of("v1")).alias("after"), r6(of("v1") - of("v0")).alias("change"))


@query("""SELECT round(1 - sum((a - b) * (a - b)) / sum((a - m) * (a - m)), 6) AS r2, max(abs(a - b)) <= 0.5 AS max_ok, avg(abs(a - b)) <= 0.1 AS mean_ok, avg(CAST((round(a, 6) >= 0.5) = (round(b, 6) >= 0.5) AS INT)) >= 0.95 AS agreement_ok
       FROM (SELECT fraud_score AS a, ml_prediction AS b, avg(fraud_score) OVER () AS m FROM scored)""", sql.SCORED)  # fmt: skip
def prediction_validation(spark, sf_dir):
    """The share of the first scores' variance that the second ones explain, and whether their differences keep to the limits."""
    s, a, b = scored(spark, sf_dir), F.col("fraud_score"), F.col("ml_prediction")
    c = evaluation.comparison(s, "fraud_score", "ml_prediction")
    r2 = s.agg((1 - F.sum((a - b) * (a - b)) / (F.count(a) * F.var_pop(a))).alias("r2"))
    both = c.crossJoin(r2)  # one row each
    return both.select(r6("r2").alias("r2"), (F.col("max_difference") <= 0.5).alias("max_ok"), (F.col("mean_difference") <= 0.1).alias("mean_ok"), (F.col("agreement") >= 0.95).alias("agreement_ok"))


# ---- tests ----


def _sql_p(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + {stats.ERF_SCALE}::DOUBLE * {x}))"
    poly = "0.0::DOUBLE"
    for a in reversed(stats.ERF):
        poly = f"({poly} + ({a})::DOUBLE) * {t}"
    return f"least({poly} * exp(-{x} * {x}), 1.0::DOUBLE)"


@query(f"""SELECT round(d, 6) AS difference, round(z, 4) AS z, round({_sql_p("z")}, 5) AS p, nc >= 50 AND abs(d) > 0.01 AND {_sql_p("z")} < 0.05 AS is_alert FROM (SELECT pc - pr AS d, (pc - pr) / sqrt(p * (1 - p) * (1 / nr + 1 / nc)) AS z, nc FROM (
       SELECT sum(ref * is_fraud) / sum(ref)::DOUBLE AS pr, sum((1 - ref) * is_fraud) / sum(1 - ref)::DOUBLE AS pc, avg(is_fraud) AS p, sum(ref)::DOUBLE AS nr, sum(1 - ref)::DOUBLE AS nc FROM sides))""", _SIDES)  # fmt: skip
def concept_drift_test(spark, sf_dir):
    """Needs 50 current labels; alerts on a difference over 0.01 that is clear at 5 %."""
    return drift.concept_test(sides(spark, sf_dir), "is_fraud").select(r6("difference").alias("difference"), F.round("z", 4).alias("z"), F.round("p", 5).alias("p"), "is_alert")


@query("""SELECT round(d, 6) AS d, round(CASE WHEN d * d * n * m / (n + m) < 0.04 THEN 1.0::DOUBLE ELSE greatest(least(2 * list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * exp(-2.0::DOUBLE * i * i * d * d * n * m / (n + m)))), 1.0::DOUBLE), 0.0::DOUBLE) END, 4) AS p FROM (
       SELECT max(abs(f1 - f2)) AS d, any_value(n) AS n, any_value(m) AS m FROM (SELECT sum(sum(ref)) OVER (ORDER BY amount) / n AS f1, sum(sum(1 - ref)) OVER (ORDER BY amount) / m AS f2, n, m
       FROM sides, (SELECT sum(ref)::DOUBLE AS n, sum(1 - ref)::DOUBLE AS m FROM sides) GROUP BY amount, n, m))""", _SIDES)  # fmt: skip
def two_sample_ks_test(spark, sf_dir):
    both = sides(spark, sf_dir)
    one = drift.kolmogorov_smirnov(both, "amount").crossJoin(both.agg(F.count_if("is_reference").alias("n"), F.count_if(~F.col("is_reference")).alias("m")))  # one row each
    return one.select(r6("d").alias("d"), F.round(stats.ks_p(F.col("d"), F.col("n").cast("double"), F.col("m").cast("double")), 4).alias("p"))


@query()
def chi_square_test(spark, sf_dir):
    """Statistic (with Yates's correction for two categories), tail, and the statistic over the number of cells, by categorical feature."""
    both = sides(spark, sf_dir)
    parts = [drift.chi_square(both, c).withColumn("feature", F.lit(c)) for c in ("product", "p_email", "k")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("feature", "statistic", "categories", stats.chi_square_p(F.col("statistic"), F.col("categories") - 1).alias("p"), F.try_divide("statistic", 2 * F.col("categories")).alias("score"))


@query()
def performance_drift_test(spark, sf_dir):
    d = F.col("head") - F.col("tail")
    one = metrics.head_tail(daily_metrics(spark, sf_dir), "date", "accuracy")
    t = one.withColumn("t", F.try_divide(d, F.sqrt((F.col("head_var") + F.col("tail_var")) / F.col("m"))))
    return t.select(d.alias("dropped"), "t", stats.t_p(F.col("t"), 2 * F.col("m") - 2).alias("p"), (d > 0.05).alias("large"))


_CATEGORIES = ("product", "p_email", "k")


@query("SELECT round(avg(psi), 6) AS psi FROM (" + " UNION ALL ".join(
    f"SELECT sum((c - r) * ln(c / r)) AS psi FROM (SELECT greatest(sum(ref) / nr, 1e-8) AS r, greatest(sum(1 - ref) / nc, 1e-8) AS c FROM sides, (SELECT sum(ref)::DOUBLE AS nr, sum(1 - ref)::DOUBLE AS nc FROM sides) GROUP BY {f}, nr, nc)" for f in _CATEGORIES) + ")", _SIDES)
def psi_over_features(spark, sf_dir):
    """The mean over categorical features; a missing value is a category."""
    both = sides(spark, sf_dir)
    out: DataFrame | None = None
    for f in _CATEGORIES:
        one = drift.shares(both, f).agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))
        out = one if out is None else out.unionByName(one)
    return out.agg(r6(F.avg("psi")).alias("psi"))




_NUMERIC, _CATEGORICAL = ("amount", "k", "addr1"), ("product", "p_email")
_BIN = lambda f: f"least(CAST(floor(({f} - lo) / ((hi - lo) / 10.0::DOUBLE)) AS INT), 9)"
#: A chi-square's tail has a closed form for the even numbers of degrees that the two features have.
_TESTS = _DAILY + _ENDS + ", sides AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS ref FROM txn), tot AS (SELECT sum(ref)::DOUBLE AS nr, sum(1 - ref)::DOUBLE AS nc FROM sides)" + "".join(f"""
, psi_{f} AS (SELECT '{f}' AS feature, sum((c - r) * ln(c / r)) AS v FROM (SELECT greatest(coalesce(r, 0) / nr, 1e-8) AS r, greatest(coalesce(c, 0) / nc, 1e-8) AS c FROM range(10) AS g(b) LEFT JOIN (
  SELECT {_BIN(f)} AS b, sum(ref)::DOUBLE AS r, sum(1 - ref)::DOUBLE AS c FROM sides, (SELECT min({f}) FILTER (ref = 1) AS lo, max({f}) FILTER (ref = 1) AS hi FROM sides) WHERE {f} BETWEEN lo AND hi GROUP BY 1) USING (b), tot)),
ks_{f} AS (SELECT '{f}' AS feature, max(abs(r / nr - c / nc)) AS d, any_value(nr) AS n, any_value(nc) AS m FROM (SELECT sum(sum(ref)) OVER (ORDER BY {f}) AS r, sum(sum(1 - ref)) OVER (ORDER BY {f}) AS c FROM sides GROUP BY {f}), tot)""" for f in _NUMERIC) + "".join(f"""
, cat_{f} AS (SELECT '{f}' AS feature, sum((greatest(q, 1e-8) - greatest(p, 1e-8)) * ln(greatest(q, 1e-8) / greatest(p, 1e-8))) AS psi, sqrt(0.5::DOUBLE * sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) AS js,
  sum((r - n * s) * (r - n * s) / (n * s) + (c - n * (1 - s)) * (c - n * (1 - s)) / (n * (1 - s))) AS chi, count(*) AS k FROM (SELECT r, c, r + c AS n, r / nr AS p, c / nc AS q, nr / (nr + nc) AS s FROM (SELECT sum(ref)::DOUBLE AS r, sum(1 - ref)::DOUBLE AS c FROM sides GROUP BY {f}), tot))""" for f in _CATEGORICAL)
_KS_P = "CASE WHEN d * d * n * m / (n + m) < 0.04 THEN 1.0::DOUBLE ELSE 2 * list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * exp(-2.0::DOUBLE * i * i * d * d * n * m / (n + m)))) END"
_TESTS += f""", found AS ({" UNION ALL ".join(f"SELECT 'psi' AS test, 'psi' AS kind, feature, v, v > 0.05 AS is_alert FROM psi_{f} UNION ALL SELECT 'kolmogorov_smirnov', 'feature', feature, d, {_KS_P} < 0.05 FROM ks_{f}" for f in _NUMERIC)}
  UNION ALL {" UNION ALL ".join(f"SELECT 'psi', 'psi', feature, psi, psi > 0.05 FROM cat_{f} UNION ALL SELECT 'chi_square', 'feature', feature, chi / (2 * k), exp(-chi / 2) * list_sum(list_transform(range(0, (k - 1) // 2), lambda i: pow(chi / 2, i) / gamma(i + 1))) < 0.15 FROM cat_{f} UNION ALL SELECT 'jensen_shannon', 'feature', feature, js, js > 0.1 FROM cat_{f}" for f in _CATEGORICAL)}
  UNION ALL SELECT 'two_proportions', 'concept', 'is_fraud', abs(d), nc >= 50 AND abs(d) > 0.01 AND {_sql_p("z")} < 0.05 FROM (SELECT pc - pr AS d, (pc - pr) / sqrt(p * (1 - p) * (1 / nr + 1 / nc)) AS z, nc FROM (SELECT sum(ref * is_fraud) / sum(ref)::DOUBLE AS pr, sum((1 - ref) * is_fraud) / sum(1 - ref)::DOUBLE AS pc, avg(is_fraud) AS p, sum(ref)::DOUBLE AS nr, sum(1 - ref)::DOUBLE AS nc FROM sides))
  UNION ALL SELECT 'head_and_tail', 'performance', 'accuracy', head - tail, head - tail > 0.05 FROM ends),
judged AS (SELECT test, kind, feature, v AS value, CASE WHEN v >= c THEN 'critical' WHEN v >= b THEN 'high' WHEN v >= a THEN 'medium' ELSE 'low' END AS severity, is_alert, is_alert AND v > again AS retrain
  FROM found JOIN (VALUES {", ".join(f"('{k}', {x[0]}, {x[1]}, {x[2]}, {y})" for k, (x, y) in drift.LEVELS.items())}) AS l(kind, a, b, c, again) USING (kind))"""


def drift_table(spark: SparkSession, sf_dir: str, hours_ago: int = 0) -> DataFrame:
    """Every test of drift as rows of one table: value, tail where there is one, severity, whether it alerts, confidence, whether to train anew, advice, and the time of the run, some hours before the last transaction's."""
    both = sides(spark, sf_dir)
    at = F.lit(both.agg(F.max("ts")).first()[0]) - F.expr(f"interval {hours_ago} hours")
    seen = both.filter(F.col("ts") <= at) if hours_ago else both
    return drift.alert_rows(seen, metrics.head_tail(daily_metrics(spark, sf_dir), "date", "accuracy"), _NUMERIC, _CATEGORICAL, "is_fraud").withColumn("at", at)


@query("SELECT test, kind, feature, round(value, 5) AS value, severity, is_alert, retrain FROM judged", _TESTS)
def all_drift_tests(spark, sf_dir):
    return drift_table(spark, sf_dir).select("test", "kind", "feature", F.round("value", 5).alias("value"), "severity", "is_alert", "retrain")


@query("SELECT severity, test, count(*) AS n, count(*) FILTER (is_alert) AS alerts FROM judged GROUP BY GROUPING SETS ((severity), (test))", _TESTS)
def drift_summary(spark, sf_dir):
    """Results and alerts of the last 24 hours by severity and by test; the log also has those of a run two days before."""
    log = versions.Table(spark, records.scratch(spark, "drift-log"), "test string, severity string, is_alert boolean, at timestamp")
    for hours in (48, 0):
        log.append(drift_table(spark, sf_dir, hours))
    now = transactions(spark, sf_dir).agg(F.max("ts")).first()[0]
    recent = log.read().filter(F.col("at") > F.lit(now) - F.expr("interval 24 hours"))
    return recent.groupingSets([[F.col("severity")], [F.col("test")]], "severity", "test").agg(F.count("*").alias("n"), F.count_if("is_alert").alias("alerts"))


@query("SELECT test, feature, round(value, 5) AS value, CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE 'medium' END AS priority FROM judged WHERE retrain", _TESTS)
def retrain_requests(spark, sf_dir):
    return drift_table(spark, sf_dir).filter("retrain").select("test", "feature", F.round("value", 5).alias("value"), F.when(F.col("severity").isin("critical", "high"), "high").otherwise("medium").alias("priority"))


# ---- experiments ----

_CARD = """, card AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE said AND is_fraud = 1) AS tp, count(*) FILTER (WHERE said AND is_fraud = 0) AS fp, count(*) FILTER (WHERE NOT said AND is_fraud = 1) AS fn,
       count(*) FILTER (WHERE NOT said AND is_fraud = 0) AS tn, coalesce(sum(amount) FILTER (WHERE said AND is_fraud = 1), 0) AS detected, coalesce(sum(amount) FILTER (WHERE NOT said AND is_fraud = 1), 0) AS missed FROM assigned GROUP BY 1)"""


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.scorecard(scored(spark, sf_dir), "exp_1", r6("fraud_score") >= 0.3, F.col("is_fraud") == 1, F.col("amount"))


@query(f"SELECT variant, n, tp, fp, tn, fn, round(detected, 4) AS detected, round(missed, 4) AS missed, {', '.join(f'round({e}, 6) AS {m}' for m, e in _RATES.items())} FROM card", _VARIANT + _CARD)
def variant_scorecard_with_metrics(spark, sf_dir):
    c = scorecard(spark, sf_dir)
    return c.select("variant", "n", "tp", "fp", "tn", "fn", F.round("detected", 4).alias("detected"), F.round("missed", 4).alias("missed"), *[r6(e).alias(m) for m, e in evaluation.rates().items()])


_PICKED = {"precision": _RATES["precision"], "recall": _RATES["recall"], "f1": _RATES["f1"], "fpr": _RATES["fpr"], "business_value": "detected - missed - 10 * fp"}


@query("SELECT variant, metric, round(CASE metric " + " ".join(f"WHEN '{m}' THEN {e}" for m, e in _PICKED.items()) + " END, 4) AS value FROM card, (VALUES " + ", ".join(f"('{m}')" for m in _PICKED) + ") m(metric)", _VARIANT + _CARD)
def metric_selection(spark, sf_dir):
    """Each variant's value of each metric that an experiment may be decided by."""
    c = scorecard(spark, sf_dir).withColumn("metric", F.explode(F.array(*map(F.lit, _PICKED))))
    return c.select("variant", "metric", F.round(experiments.metric_value(F.col("metric")), 4).alias("value"))


_TESTED = {"precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("tp", "n")}


@query("SELECT metric, round(pt - pc, 6) AS effect, round(z, 4) AS z, round(" + _sql_p("z") + ", 5) AS p FROM (SELECT *, (pt - pc) / sqrt(q * (1 - q) * (1 / nc + 1 / nt)) AS z FROM (SELECT metric, sc / nc AS pc, st / nt AS pt, (sc + st) / (nc + nt) AS q, nc, nt FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, sum({a}) FILTER (WHERE variant = 'control')::DOUBLE AS sc, sum({a}) FILTER (WHERE variant = 'treatment')::DOUBLE AS st, sum({b}) FILTER (WHERE variant = 'control')::DOUBLE AS nc, sum({b}) FILTER (WHERE variant = 'treatment')::DOUBLE AS nt FROM card" for m, (a, b) in _TESTED.items()) + ")))", _VARIANT + _CARD)
def two_proportion_tests(spark, sf_dir):
    """Precision, recall and f1 (as true positives among all) of two variants: difference, pooled z and its tail."""
    return experiments.proportion_tests(scorecard(spark, sf_dir), _TESTED).select("metric", r6("effect").alias("effect"), F.round("z", 4).alias("z"), F.round(stats.normal_p(F.col("z")), 5).alias("p"))
