"""Every registered query of the library, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attacks, fake, generalize, mask, metrics, models, noise, profile, pseudonymize, reshape, suppress, text
from ..operators import conditions as cond
from ..streaming.windows import windowed_group_sizes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Quasi-identifiers and sensitive attribute of lineitem that several queries use.
QI = ["l_returnflag", "l_linestatus", "ship_year"]
_LINES = "(SELECT *, year(l_shipdate)::INT AS ship_year, CAST(floor(l_quantity / 10) AS INT) AS qty_bin FROM lineitem)"
CQI = ["c_nationkey", "c_mktsegment"]


def lines(t: Tables) -> DataFrame:
    return t("lineitem").withColumn("ship_year", F.year("l_shipdate")).withColumn("qty_bin", F.floor(F.col("l_quantity") / 10).cast("int"))


# ---- filters and keys


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 1000 AND 100000 AND o_orderpriority <> '5-LOW'")
def filter_conditions(t):
    tests = [{"field": "o_orderstatus", "operator": "in", "values": ["O", "P"]}, {"field": "o_totalprice", "operator": "range", "values": [1000, 100000]}, {"field": "o_orderpriority", "operator": "ne", "values": ["5-LOW"]}]
    return t("orders").where(cond.conditions(tests)).select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, sha256(concat_ws('_', CAST(c_nationkey AS VARCHAR), c_mktsegment)) AS key FROM customer")
def composite_key(t):
    return t("customer").select("c_custkey", cond.composite_key(["c_nationkey", "c_mktsegment"], digest="sha256").alias("key"))


@query("""WITH k AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer)
SELECT c_custkey, CASE WHEN k < 20 THEN CASE WHEN length(c_name) > 4 THEN substr(c_name, 1, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) ELSE repeat('*', length(c_name)) END ELSE c_name END AS c_name FROM k""")
def vulnerable_mask(t):
    rows = models.enrich_k(t("customer"), CQI, "k")
    return cond.vulnerable_rows(rows, "k", 20, "c_name", "mask").select("c_custkey", "c_name")


# ---- generalization

_EW = """WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
e AS (SELECT lo, hi, list_transform(range(0, {n} + 1), lambda k: CASE WHEN k = {n} THEN hi + 0.001 ELSE lo + k * ((hi - lo) / {n}) END) AS e FROM r),
b AS (SELECT {id}, {c} AS x, e, CASE WHEN {c} <= e[2] THEN 1 ELSE len(list_filter(e, lambda v: v < {c})) END AS i FROM {t}, e)
SELECT {id}, printf('%.2f', e[i]) || '-' || printf('%.2f', e[i + 1]) AS bin FROM b"""


@query(_EW.format(c="p_retailprice", t="part", n=10, id="p_partkey"))
def gen_numeric_equal_width(t):
    return generalize.equal_width(t("part"), "p_retailprice", 10, "bin").select("p_partkey", "bin")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM orders),
b AS (SELECT o_orderkey, o_totalprice AS x, list_transform(range(1, 6), lambda k: CASE WHEN k = 5 THEN q[k] + 0.001 ELSE q[k] END) AS e FROM orders, q),
i AS (SELECT *, CASE WHEN x <= e[2] THEN 1 ELSE len(list_filter(e, lambda v: v < x)) END AS i FROM b)
SELECT o_orderkey, printf('%.2f', e[i]) || '-' || printf('%.2f', e[i + 1]) AS bin FROM i""")
def gen_numeric_quantile(t):
    return generalize.equal_frequency(t("orders"), "o_totalprice", 4, "bin").select("o_orderkey", "bin")


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 1000.0, 0) * 1000.0 AS price FROM lineitem")
def gen_numeric_rounding(t):
    return generalize.round_numbers(t("lineitem"), "l_extendedprice", -3, "price").select("l_orderkey", "l_linenumber", "price")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 30 THEN '10-30' ELSE '>=30' END AS one, CASE WHEN p_size <= 5 THEN '<5' WHEN p_size <= 15 THEN '5-10' WHEN p_size <= 20 THEN '15-20' ELSE '>=20' END AS many FROM part")
def gen_numeric_range(t):
    out = generalize.ranges(t("part"), "p_size", [(10, 30)], "one")
    return generalize.ranges(out, "p_size", [(5, 10), (15, 20)], "many").select("p_partkey", "one", "many")


@query("SELECT o_orderkey, date_trunc('week', o_orderdate)::TIMESTAMP AS week, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month FROM orders")
def gen_datetime_round(t):
    out = generalize.truncate_dates(t("orders"), "o_orderdate", "week", output="week")
    return generalize.truncate_dates(out, "o_orderdate", "month", "yyyy-MM", "month").select("o_orderkey", F.col("week").cast("timestamp_ntz").alias("week"), "month")


@query("""SELECT event_id, printf('%02d:00-%02d:00', CAST(greatest(1, ceil(hour(ts) / 6.0)) * 6 - 6 AS INT), CAST(greatest(1, ceil(hour(ts) / 6.0)) * 6 AS INT)) AS hours,
CASE WHEN hour(ts) >= 6 AND hour(ts) < 12 THEN 'Morning' WHEN hour(ts) >= 12 AND hour(ts) < 18 THEN 'Afternoon' ELSE 'Night' END AS period,
CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) <= 5 THEN 'Spring' WHEN month(ts) <= 8 THEN 'Summer' ELSE 'Fall' END AS season FROM events""")
def gen_datetime_bins(t):
    out = generalize.bin_dates(t("events"), "ts", "hour_range", 6, output="hours")
    out = generalize.bin_dates(out, "ts", "business_period", output="period")
    return generalize.bin_dates(out, "ts", "seasonal", output="season").select("event_id", "hours", "period", "season")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS parts FROM orders")
def gen_datetime_component(t):
    return generalize.keep_components(t("orders"), "o_orderdate", output="parts").select("o_orderkey", "parts")


@query("""WITH d AS (SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS d FROM orders)
SELECT o_orderkey, CASE WHEN d = 0 THEN 'Today' WHEN d > 0 AND d <= 7 THEN 'Within a week ago' WHEN d < 0 AND d >= -7 THEN 'Within a week' WHEN d > 0 AND d <= 30 THEN 'Within a month ago' WHEN d < 0 AND d >= -30 THEN 'Within a month'
WHEN d > 0 AND d <= 365 THEN 'Within a year ago' WHEN d < 0 AND d >= -365 THEN 'Within a year' WHEN d > 0 THEN 'More than a year ago' ELSE 'More than a year ahead' END AS ago FROM d""")
def gen_datetime_relative(t):
    return generalize.relative_dates(t("orders"), "o_orderdate", datetime(1998, 1, 1), "ago").select("o_orderkey", "ago")


@query("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN c.n < 80 THEN 'OTHER' ELSE p_brand END AS brand FROM part JOIN c USING (p_brand)")
def gen_categorical_rare(t):
    return generalize.group_rare(t("part"), "p_brand", 80, output="brand").select("p_partkey", "brand")


@query("WITH c AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 5) SELECT p_partkey, CASE WHEN p_type IN (SELECT p_type FROM c) THEN p_type ELSE 'OTHER' END AS kind FROM part")
def gen_categorical_frequent(t):
    return generalize.keep_frequent(t("part"), "p_type", 5, output="kind").select("p_partkey", "kind")


@query("SELECT c_custkey, r_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def gen_categorical_hierarchy(t):
    tree = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("value"), F.col("r_name").alias("region"))
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return generalize.hierarchy(rows, "n_name", tree, "region", output="place").select("c_custkey", "place")


@query("WITH c AS (SELECT p_type, count(*)::DOUBLE AS c FROM part GROUP BY 1), t AS (SELECT sum(c) AS t FROM c) SELECT sum(c)::BIGINT AS n, count(*) AS distinct_values, round(-sum(c / t * log2(c / t)), 6) AS entropy, round(1 - sum(c / t * c / t), 6) AS gini, round(max(c / t), 6) AS top_share FROM c, t")
def gen_category_distribution(t):
    return generalize.category_distribution(t("part"), "p_type")


# ---- masking


@query("SELECT c_custkey, repeat('*', length(c_name)) AS whole, '********' AS fixed FROM customer")
def mask_full(t):
    out = mask.full_mask(t("customer"), "c_name", output="whole")
    return mask.full_mask(out, "c_name", keep_length=False, output="fixed").select("c_custkey", "whole", "fixed")


@query(r"SELECT c_custkey, CASE WHEN length(c_name) <= 5 THEN c_name ELSE substr(c_name, 1, 3) || regexp_replace(substr(c_name, 4, length(c_name) - 5), '[^\-_.@/\\:; ()\[\]]', '*', 'g') || right(c_name, 2) END AS masked FROM customer")
def mask_partial(t):
    return mask.mask_middle(t("customer"), "c_name", 3, 2, output="masked").select("c_custkey", "masked")


@query(r"SELECT p_partkey, array_to_string(list_transform(regexp_split_to_array(trim(p_name), '\s+'), lambda w: CASE WHEN length(w) <= 3 THEN repeat('*', length(w)) ELSE substr(w, 1, 1) || repeat('*', length(w) - 1) END), ' ') AS masked FROM part")
def mask_words(t):
    return mask.mask_words(t("part"), "p_name", output="masked").select("p_partkey", "masked")


_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@query(rf"""WITH e AS (SELECT doc_id, regexp_extract(text, '{_MAIL}') AS mail FROM documents WHERE regexp_matches(text, '{_MAIL}'))
SELECT doc_id, mail, substr(split_part(mail, '@', 1), 1, 1) || repeat('*', length(split_part(mail, '@', 1)) - 1) || '@' || split_part(mail, '@', 2) AS masked FROM e""")
def mask_preset_email(t):
    rows = t("documents").select("doc_id", F.regexp_extract("text", _MAIL, 0).alias("mail")).where("mail <> ''")
    return mask.mask_email(rows, "mail", "first_char", "masked")


@query(rf"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS mail FROM documents)
SELECT doc_id, mail, substr(split_part(mail, '@', 1), 1, 1) || repeat('*', length(split_part(mail, '@', 1)) - 1) || '@' || split_part(mail, '@', 2) AS masked FROM e""")
def mask_preset_email_all(t):
    rows = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("mail"))
    return mask.mask_email(rows, "mail", "first_char", "masked")


@query(r"SELECT o_orderkey, regexp_replace(CAST(o_orderkey AS VARCHAR), '\d', '9', 'g')::BIGINT AS hidden FROM orders")
def mask_numeric(t):
    return mask.mask_numbers(t("orders").select("o_orderkey"), "o_orderkey", output="hidden")


@query(r"SELECT c_custkey, regexp_replace(c_name, '[\p{L}\p{N}]', '*', 'g') AS masked FROM customer")
def mask_alphanumeric(t):
    return mask.mask_alphanumeric(t("customer"), "c_name", output="masked").select("c_custkey", "masked")


@query()
def mask_random_share(t):
    """Deterministic in Spark; the choice of characters is a hash of Spark's own."""
    return mask.mask_share(t("customer"), "c_name", 40, output="masked").select("c_custkey", "masked")


# ---- suppression


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def supp_attribute(t):
    return suppress.suppress_columns(t("customer"), ["c_name", "c_acctbal"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice BETWEEN 50000 AND 1000000)")
def supp_record(t):
    return suppress.suppress_records(t("orders"), suppress.record_mask("o_totalprice", "range", [50000, 1000000])).select("o_orderkey", "o_totalprice")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN NULL ELSE value END AS value FROM events, q""")
def supp_cell_outlier(t):
    return suppress.suppress_cells(t("events"), "value", "outlier").select("event_id", "value")


@query("SELECT event_id, round(CASE WHEN user_id % 7 = 0 THEN avg(value) OVER (PARTITION BY event_type) ELSE value END, 4) AS value FROM events")
def supp_cell_group_mean(t):
    out = suppress.suppress_cells(t("events"), "value", F.col("user_id") % 7 == 0, "group_mean", group="event_type")
    return out.select("event_id", F.round("value", 4).alias("value"))


@query("WITH m AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1), c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n < 75 THEN (SELECT p_brand FROM m) ELSE p_brand END AS p_brand FROM part JOIN c USING (p_brand)")
def supp_cell_rare_mode(t):
    return suppress.suppress_cells(t("part"), "p_brand", "rare", "mode", least=75).select("p_partkey", "p_brand")


# ---- noise: values are random, so tests check their properties


@query("SELECT count(*) AS n, true AS within, 0 AS nulls FROM events")
def noise_uniform(t):
    out = noise.uniform_numeric_noise(t("events"), "value", 2.5, output="noisy")
    return out.agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("noisy") - F.col("value")) <= 2.5 + 1e-9).alias("within"), F.count_if(F.col("noisy").isNull()).cast("int").alias("nulls"))


@query("SELECT count(*) AS n, true AS within FROM orders")
def noise_temporal(t):
    out = noise.uniform_temporal_noise(t("orders"), "o_orderdate", 86400, output="shifted")
    gap = F.abs(F.unix_micros(F.col("shifted").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return out.agg(F.count("*").alias("n"), F.bool_and(gap <= 86_400_000_000).alias("within"))


@query()
def dp_laplace(t):
    out = noise.differential_privacy(t("lineitem").withColumn("noisy", F.col("l_quantity")), ["noisy"], 1.0)
    return noise.noise_impact(out, "l_quantity", "noisy")


# ---- pseudonyms


@query("SELECT c_custkey, substr(sha256(c_name || 'pepper'), 1, 16) AS pseudonym FROM customer")
def pseudo_sha256(t):
    return pseudonymize.sha2_pseudonym(t("customer"), "c_name", "pepper", length=16, output="pseudonym").select("c_custkey", "pseudonym")


@query("WITH v AS (SELECT c_mktsegment AS original, 'ID_' || lpad(CAST(row_number() OVER (ORDER BY c_mktsegment) AS VARCHAR), 6, '0') AS p FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, p AS pseudonym FROM customer JOIN v ON original = c_mktsegment")
def pseudo_mapping_sequential(t):
    m = pseudonymize.sequential_map(t("customer"), "c_mktsegment")
    return pseudonymize.apply_map(t("customer"), "c_mktsegment", m, "pseudonym").select("c_custkey", "pseudonym")


@query()
def pseudo_sha3(t):
    return pseudonymize.sha3_pseudonym(t("customer"), "c_name", b"salt", encoding="base58", output="pseudonym").select("c_custkey", "pseudonym")


@query()
def pseudo_hmac(t):
    return pseudonymize.hmac_pseudonym(t("customer"), "c_name", b"key", "crm", "pseudonym").select("c_custkey", "pseudonym")


_PICK = "CAST(('0x' || substr(sha256('{salt}:' || {x}), 1, 8))::BIGINT % {n} AS INT)"


@query(f"SELECT c_custkey, list_extract({list(fake.FIRST_F)}, {_PICK.format(salt='42-f', x='c_name', n=8)} + 1) AS f, list_extract({list(fake.LAST)}, {_PICK.format(salt='42-l', x='c_name', n=12)} + 1) AS l FROM customer")
def fake_picks(t):
    return t("customer").select("c_custkey", fake.pick(F.col("c_name"), "42-f", fake.FIRST_F).alias("f"), fake.pick(F.col("c_name"), "42-l", fake.LAST).alias("l"))


@query()
def fake_people(t):
    out = fake.fake_name(t("customer"), "c_name", output="name")
    return fake.fake_email(out, "c_name", digits=3, output="email").select("c_custkey", "name", "email")


# ---- relational


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def merge_one_to_many(t):
    return reshape.merge_datasets(t("customer"), t("orders"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders) ON a = b")
def overlap_counts(t):
    return reshape.overlap(t("customer"), t("orders"), "c_custkey", "o_custkey")


@query("SELECT n_nationkey, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(t):
    table = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return reshape.lookup(t("nation"), "n_regionkey", table, "region").select("n_nationkey", "region")


@query("""SELECT l_returnflag, count(l_quantity) AS l_quantity_count, sum(l_quantity) AS l_quantity_sum, round(avg(l_discount), 6) AS l_discount_mean, median(l_quantity) AS l_quantity_median, min(l_tax) AS l_tax_min,
max(l_tax) AS l_tax_max, round(stddev_samp(l_quantity), 6) AS l_quantity_std, count(DISTINCT l_suppkey) AS l_suppkey_nunique FROM lineitem GROUP BY 1""")
def agg_records_all(t):
    out = reshape.aggregate_records(t("lineitem"), ["l_returnflag"], {"l_quantity": ["count", "sum", "median", "std"], "l_discount": ["mean"], "l_tax": ["min", "max"], "l_suppkey": ["nunique"]})
    return out.withColumn("l_discount_mean", F.round("l_discount_mean", 6)).withColumn("l_quantity_std", F.round("l_quantity_std", 6))


@query("SELECT event_type, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS value_iqr, max(value) - min(value) AS value_range, arg_min(value, event_id) AS value_first, arg_max(value, event_id) AS value_last FROM events GROUP BY 1")
def agg_custom(t):
    out = reshape.aggregate_records(t("events"), ["event_type"], {"value": ["iqr", "range", "first", "last"]}, order="event_id")
    return out.withColumn("value_iqr", F.round("value_iqr", 6))


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
def modify_fields(t):
    changes = {"doubled": {"operation": "add_expression", "expression": "o_totalprice * 2"}, "size": {"operation": "add_conditional", "condition": "o_totalprice > 100000", "then": "big", "else": "small"}}
    return reshape.add_or_modify(t("orders"), changes).select("o_orderkey", "doubled", "size")


@query("SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey)::INT - 1 AS part FROM customer")
def split_equal_size(t):
    return reshape.partition_number(t("customer"), "c_custkey", 7, "equal_size").select("c_custkey", "part")


@query("SELECT o_orderkey, (o_orderkey % 5)::INT AS part FROM orders")
def split_modulo(t):
    return reshape.partition_number(t("orders"), "o_orderkey", 5).select("o_orderkey", "part")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O') THEN 'open' WHEN o_orderstatus IN ('F') THEN 'done' ELSE 'others' END AS part FROM orders")
def split_values(t):
    parts = reshape.split_by_values(t("orders"), "o_orderstatus", {"open": ["O"], "done": ["F"]})
    return reshape.stack_parts({k: v.select("o_orderkey") for k, v in parts.items()})


@query("SELECT event_id, CASE WHEN value < 5 OR value > 80 THEN NULL ELSE value END AS value, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE NULL END AS event_type FROM events")
def clean_rules(t):
    return reshape.clean_invalid(t("events"), {"value": {"min": 5, "max": 80}, "event_type": {"allowed": ["click", "view"]}}).select("event_id", "value", "event_type")


_HOLES = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)"


def holes(t: Tables) -> DataFrame:
    return t("events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


@query(f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {_HOLES})), 4) AS value FROM {_HOLES}")
def impute_mean(t):
    return reshape.impute(holes(t), "value", "mean").select("event_id", F.round("value", 4).alias("value"))


@query("SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), (SELECT p_brand FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1)) AS p_brand FROM part")
def impute_mode(t):
    return reshape.impute(t("part"), "p_brand", "mode", invalid=["Brand#11"]).select("p_partkey", "p_brand")


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM {_HOLES}")
def impute_ffill(t):
    return reshape.impute(holes(t), "value", "ffill", order=["ts", "event_id"], by=["user_id"]).select("event_id", "value")


@query(f"""WITH h AS (SELECT *, row_number() OVER w AS n FROM {_HOLES} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN value IS NOT NULL THEN n END AS pos FROM h),
c AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS a, first_value(value IGNORE NULLS) OVER q AS b, last_value(pos IGNORE NULLS) OVER p AS i, first_value(pos IGNORE NULLS) OVER q AS j FROM b
WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(value, a + (b - a) * (n - i) / nullif(j - i, 0), a), 4) AS value FROM c""")
def impute_interpolate(t):
    return reshape.impute(holes(t), "value", "interpolation", order=["ts", "event_id"], by=["user_id"]).select("event_id", F.round("value", 4).alias("value"))


# ---- privacy models


@query(f"SELECT l_returnflag, l_linestatus, ship_year, count(*) AS k FROM {_LINES} GROUP BY ALL")
def k_anonymity_profile(t):
    return models.group_sizes(lines(t), QI)


@query("""WITH g AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT count(*) AS groups, sum(k)::BIGINT AS records, min(k) AS min_k, count(*) FILTER (k < 12) AS groups_at_risk, coalesce(sum(k) FILTER (k < 12), 0)::BIGINT AS records_at_risk, round(100 * coalesce(sum(k) FILTER (k < 12), 0) / sum(k), 4) AS records_at_risk_pct,
round(100 / min(k), 4) AS prosecutor_risk, round(100 * count(*) / sum(k), 4) AS journalist_risk, round(100 * count(*) FILTER (k = 1) / sum(k), 4) AS marketer_risk FROM g""")
def kanon_eval(t):
    return models.k_evaluate(t("customer"), CQI, 12)


@query("SELECT c_custkey FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer) WHERE k >= 12")
def kanon_suppress(t):
    return models.k_suppress(t("customer"), CQI, 12).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN k < 12 THEN 'MASKED' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey, CASE WHEN k < 12 THEN 'MASKED' ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer)")
def kanon_mask(t):
    return models.k_mask(t("customer"), CQI, 12).select("c_custkey", *CQI)


@query("""WITH g AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment), n AS (SELECT unnest([5, 10, 15]) AS need)
SELECT need, count(*) FILTER (k < need) AS groups_below, coalesce(sum(k) FILTER (k < need), 0)::BIGINT AS records_below FROM g, n GROUP BY 1""")
def kanon_batch(t):
    return models.k_batch(t("customer"), CQI, [5, 10, 15])


@query("SELECT c_custkey, k AS K_c_n_c_m, round(1 / k, 6) AS K_c_n_c_m_risk FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer)")
def enrich_k(t):
    return models.enrich_k(t("customer"), CQI).select("c_custkey", "K_c_n_c_m", "K_c_n_c_m_risk")


@query(f"""WITH c AS (SELECT l_returnflag, l_linestatus, ship_year, qty_bin, count(*) AS n FROM {_LINES} GROUP BY ALL),
r AS (SELECT *, sum(n) OVER g AS size, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, ship_year ORDER BY n DESC, qty_bin) AS rk FROM c WINDOW g AS (PARTITION BY l_returnflag, l_linestatus, ship_year))
SELECT l_returnflag, l_linestatus, ship_year, max(size)::BIGINT AS size, count(*) AS distinct_l, round(-sum(n / size * ln(n / size)), 6) AS entropy, count(*) >= 3 AND max(n) <= coalesce(sum(n) FILTER (rk BETWEEN 2 AND 3), 0) AS recursive_ok FROM r GROUP BY 1, 2, 3""")
def ldiv_groups(t):
    return models.l_diversity(lines(t), QI, "qty_bin", 3)


@query(f"""WITH d AS (SELECT count(DISTINCT qty_bin) AS d FROM {_LINES} GROUP BY l_returnflag, l_linestatus, ship_year)
SELECT min(d) AS min_l, round(avg(d), 6) AS avg_l, median(d) AS median_l, count(*) FILTER (d < 3) AS groups_below, count(*) AS groups, round(least(100, 100 / min(d)), 4) AS prosecutor, round(least(100, 100 / avg(d)), 4) AS journalist, round(least(100, 100 / median(d)), 4) AS marketer FROM d""")
def ldiv_risk(t):
    return models.l_risk(lines(t), QI, "qty_bin", 3)


@query(f"""WITH c AS (SELECT l_returnflag, l_linestatus, ship_year, qty_bin, count(*) AS n FROM {_LINES} GROUP BY ALL),
g AS (SELECT count(*) AS d, max(n) / sum(n) AS top FROM c GROUP BY l_returnflag, l_linestatus, ship_year),
p AS (SELECT min(d) AS min_d, 100 * avg((d = 1)::DOUBLE) AS h, 100 * avg(top) AS a FROM g),
b AS (SELECT 100 * max(n) / sum(n) AS base FROM (SELECT qty_bin, sum(n) AS n FROM c GROUP BY 1)),
x AS (SELECT *, greatest(0, least(100, a - base)) AS gain, greatest(0, least(100, (3 - min_d) / 3 * 100)) AS short FROM p, b)
SELECT min_d, round(h, 4) AS homogeneous, round(a, 4) AS avg_top, round(base, 4) AS baseline, round(gain, 4) AS gain, round(0.4 * short + 0.3 * h + 0.2 * gain, 4) AS vulnerability, round(0.5 * least(100, 100 / min_d) + 0.2 * h + 0.2 * gain, 4) AS overall FROM x""")
def ldiv_attribute_risk(t):
    return models.attribute_risk(lines(t), QI, "qty_bin", 3)


@query(f"SELECT l_orderkey, l_linenumber FROM {_LINES} WHERE (l_returnflag, l_linestatus, ship_year) IN (SELECT (l_returnflag, l_linestatus, ship_year) FROM {_LINES} GROUP BY l_returnflag, l_linestatus, ship_year HAVING count(DISTINCT qty_bin) >= 6)")
def ldiv_suppress(t):
    return models.l_suppress(lines(t), QI, "qty_bin", 6).select("l_orderkey", "l_linenumber")


_GRID = f"""WITH c AS (SELECT l_returnflag, l_linestatus, ship_year, qty_bin, count(*) AS n FROM {_LINES} GROUP BY ALL),
v AS (SELECT qty_bin, sum(n) AS an FROM c GROUP BY 1), g AS (SELECT DISTINCT l_returnflag, l_linestatus, ship_year FROM c),
x AS (SELECT g.*, v.qty_bin, an, coalesce(n, 0) AS n FROM g CROSS JOIN v LEFT JOIN c USING (l_returnflag, l_linestatus, ship_year, qty_bin))"""


@query(_GRID + """, y AS (SELECT *, abs(sum(n) OVER r / sum(n) OVER w - sum(an) OVER r / sum(an) OVER w) AS gap FROM x WINDOW r AS (PARTITION BY l_returnflag, l_linestatus, ship_year ORDER BY qty_bin), w AS (PARTITION BY l_returnflag, l_linestatus, ship_year))
SELECT l_returnflag, l_linestatus, ship_year, round(sum(gap), 6) AS t FROM y GROUP BY 1, 2, 3""")
def tclose_emd(t):
    return models.t_closeness_ordered_emd(lines(t), QI, "qty_bin")


@query(_GRID + """, y AS (SELECT l_returnflag, l_linestatus, ship_year, n / sum(n) OVER w AS p, an / sum(an) OVER w AS q FROM x WINDOW w AS (PARTITION BY l_returnflag, l_linestatus, ship_year)),
a AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, ship_year ORDER BY p) AS i, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, ship_year ORDER BY q) AS j FROM y)
SELECT l_returnflag, l_linestatus, ship_year, round(avg(abs(a.p - b.q)), 6) AS t FROM a JOIN a b USING (l_returnflag, l_linestatus, ship_year) WHERE a.i = b.j GROUP BY 1, 2, 3""")
def tclose_values(t):
    return models.t_closeness_probability_values(lines(t), QI, "qty_bin")


# ---- risk


@query("""WITH g AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT round(100 / min(k), 2) AS prosecutor, round(100 * count(*) / sum(k), 2) AS journalist, round(100 * count(*) FILTER (k = 1) / sum(k), 2) AS marketer, coalesce(sum(k) FILTER (k < 5), 0)::BIGINT AS at_risk_records FROM g""")
def disclosure_risk(t):
    return metrics.disclosure_risk(t("customer"), CQI)


@query("""WITH g AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT round(100 * count(*) FILTER (k = 1) / sum(k), 4) AS identity_rate, round(100 * avg((k < 2)::DOUBLE), 4) AS below_2, round(100 * avg((k < 5)::DOUBLE), 4) AS below_5, round(100 * avg((k < 10)::DOUBLE), 4) AS below_10 FROM g""")
def uniqueness(t):
    return metrics.uniqueness(t("customer"), CQI)


@query(f"""WITH c AS (SELECT l_returnflag, l_linestatus, ship_year, qty_bin, count(*) AS n FROM {_LINES} GROUP BY ALL),
g AS (SELECT sum(n) AS k, count(*) AS d FROM c GROUP BY l_returnflag, l_linestatus, ship_year),
p AS (SELECT min(k) AS mk, coalesce(sum(k) FILTER (d = 1), 0) / sum(k) AS a, count(*) FILTER (k = 1) / sum(k) AS m FROM g),
s AS (SELECT qty_bin, sum(n) AS n FROM c GROUP BY 1), h AS (SELECT -sum(n / t * ln(n / t)) AS h, count(*) AS v FROM s, (SELECT sum(n) AS t FROM s))
SELECT mk::BIGINT AS min_k, round(a, 6) AS attribute, round(m, 6) AS membership, round(100 * (0.4 / mk + 0.1 * (1 - h / ln(v)) + 0.3 * a + 0.2 * m), 4) AS score FROM p, h""")
def full_risk(t):
    return metrics.full_risk(lines(t), QI, "qty_bin")


@query("SELECT round(0.5 / (1 + exp(-10 * (0 - 0.5))) + 0.3 / (1 + exp(-5)) + 0.2 / (1 + exp(-5)), 6) AS risk")
def provisional_risk(t):
    return metrics.provisional_risk(t("customer"), CQI)


@query("""WITH p AS (SELECT p_type AS b, CASE WHEN p_size < 10 THEN NULL ELSE split_part(p_type, ' ', 1) END AS a FROM part)
SELECT round(1 - count(*) FILTER (a IS NULL) / count(*), 6) AS total, round(count(*) FILTER (a <> b) / count(b), 6) AS changed, round(count(*) FILTER (a IS NULL) / count(b), 6) AS suppressed, round(count(*) FILTER (a = b) / count(b), 6) AS unchanged FROM p""")
def coverage(t):
    pairs = t("part").select(F.col("p_type").alias("b"), F.when(F.col("p_size") >= 10, F.split("p_type", " ")[0]).alias("a"))
    return metrics.coverage(pairs, "b", "a")


@query("WITH u AS (SELECT count(DISTINCT p_type) AS u0, count(DISTINCT split_part(p_type, ' ', 1)) AS u1 FROM part) SELECT u0, u1, round(greatest(0, least(1, coalesce((u0 - u1) / nullif(u0 - 1, 0), 0))), 6) AS level, round(greatest(0, least(1, (u0 - u1) / u0)), 6) AS reduction FROM u")
def generalization_level(t):
    return metrics.generalization_level(t("part").select(F.col("p_type").alias("b"), F.split("p_type", " ")[0].alias("a")), "b", "a")


# ---- attacks


@query("SELECT c_custkey, count(*) AS matches FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def link_exact(t):
    a = t("customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    b = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return attacks.record_linkage(a, b).groupBy("c_custkey").agg(F.count("*").alias("matches"))


# The four queries above take subsets of part, as their SQL does; those below take whole part against its release.


@query("""WITH b AS (SELECT p_partkey, substr(p_name, 1, 4) || repeat('*', length(p_name) - 6) || right(p_name, 2) AS p_name, p_brand FROM part)
SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, round((jaro_winkler_similarity(a.p_name, b.p_name) + jaro_winkler_similarity(a.p_brand, b.p_brand)) / 2, 6) AS score FROM part a JOIN b ON a.p_name = b.p_name OR a.p_brand = b.p_brand
WHERE (jaro_winkler_similarity(a.p_name, b.p_name) + jaro_winkler_similarity(a.p_brand, b.p_brand)) / 2 >= 0.85""")
def link_probabilistic(t):
    p = t("part")
    return attacks.probabilistic_linkage(p, mask.mask_middle(p, "p_name", 4, 2, keep_separators=False), "p_partkey", "p_partkey", ["p_name", "p_brand"])


def released(t: Tables) -> DataFrame:
    """Part with sizes and prices rounded to tens."""
    return generalize.round_numbers(generalize.round_numbers(t("part"), "p_size", -1), "p_retailprice", -1)


_NEAR_WHOLE = """WITH d AS (SELECT round_even(p_size / 10, 0) * 10 AS x, round_even(p_retailprice / 10, 0) * 10 AS y FROM part), s AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM d)"""
_NEAR_D = "sqrt(((p_size - x) / sx) ** 2 + ((p_retailprice - y) / sy) ** 2)"


@query(f"{_NEAR_WHOLE} SELECT p_partkey, round(min({_NEAR_D}), 6) AS dcr FROM part, d, s GROUP BY 1")
def dcr(t):
    return attacks.dcr(t("part"), released(t), "p_partkey", ["p_size", "p_retailprice"])


@query(f"{_NEAR_WHOLE}, r AS (SELECT p_partkey, min({_NEAR_D}, 2) AS l FROM part, d, s GROUP BY 1) SELECT p_partkey, round(l[1] / (l[2] + 1e-10), 6) AS nndr FROM r")
def nndr(t):
    return attacks.nndr(t("part"), released(t), "p_partkey", ["p_size", "p_retailprice"], scale=True)


@query(f"{_NEAR_WHOLE}, r AS (SELECT p_partkey, round(min({_NEAR_D}), 6) AS dcr FROM part, d, s GROUP BY 1) SELECT p_partkey, dcr, dcr < (SELECT median(dcr) FROM r WHERE dcr > 0) AS member FROM r")
def mia_dcr(t):
    return attacks.membership_inference(dcr(t))


@query("""WITH k AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), m AS (SELECT o_orderstatus AS f, o_orderpriority AS g, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r FROM k GROUP BY 1, 2)
SELECT o_orderkey, g AS guess FROM orders LEFT JOIN m ON f = o_orderstatus AND r = 1 WHERE o_orderkey % 2 = 1""")
def attr_inference(t):
    o = t("orders")
    return attacks.attribute_inference(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_orderstatus", "o_custkey"], "o_orderpriority").select("o_orderkey", "guess")


@query("""WITH c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM (SELECT o_totalprice > 150000 AS y, o_orderstatus = 'F' AS p FROM orders)),
r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS a, tp / (tp + fp) AS q, tp / (tp + fn) AS s, fp / (fp + tn) AS f FROM c)
SELECT round(a, 4) AS accuracy, round(q, 4) AS precision, round(s, 4) AS recall, round(2 * q * s / (q + s), 4) AS f1, round(2 * (a - 0.5), 4) AS advantage, round(s, 4) AS asr, round(s - f, 4) AS rrs FROM r""")
def attack_metrics(t):
    return attacks.attack_metrics(t("orders").select((F.col("o_totalprice") > 150000).alias("y"), (F.col("o_orderstatus") == "F").alias("p")), "y", "p")


@query()
def cluster_linkage(t):
    p = t("part")
    return attacks.cluster_linkage(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_partkey", "p_partkey", ["p_size", "p_retailprice"])


# ---- fidelity and utility: lineitem against its rounded version

_AB = "a AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), b AS (SELECT round_even(l_quantity / 10, 0) * 10 AS x, l_extendedprice AS y FROM lineitem)"


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t("lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return a, generalize.round_numbers(a, "x", -1)


_CDF = f"WITH {_AB}, c AS (SELECT x, sum(p) AS p, sum(q) AS q FROM (SELECT x, 1 / (SELECT count(*) FROM a) AS p, 0 AS q FROM a UNION ALL SELECT x, 0, 1 / (SELECT count(*) FROM b) FROM b) GROUP BY 1)"


@query(_CDF + ", d AS (SELECT abs(sum(p) OVER (ORDER BY x) - sum(q) OVER (ORDER BY x)) AS d FROM c) SELECT round(max(d), 6) AS statistic, 0.0 AS p_value FROM d")
def ks(t):
    a, b = sides(t)
    return metrics.ks(a, b, "x")


@query(_CDF + ", d AS (SELECT coalesce(lead(x) OVER (ORDER BY x) - x, 0) AS w, abs(sum(p) OVER (ORDER BY x) - sum(q) OVER (ORDER BY x)) AS d FROM c) SELECT round(sum(w * d), 6) AS distance FROM d")
def wasserstein(t):
    a, b = sides(t)
    return metrics.wasserstein(a, b, "x")


@query(f"""WITH {_AB}, c AS (SELECT x, count(*) FILTER (s = 1) AS na, count(*) FILTER (s = 2) AS nb FROM (SELECT x, 1 AS s FROM a UNION ALL SELECT x, 2 FROM b) GROUP BY 1),
p AS (SELECT greatest(na / sum(na) OVER (), 0.01::DOUBLE) AS p, greatest(nb / sum(nb) OVER (), 0.01::DOUBLE) AS q FROM c), r AS (SELECT greatest(p / sum(p) OVER (), 0.01::DOUBLE) AS p, greatest(q / sum(q) OVER (), 0.01::DOUBLE) AS q FROM p)
SELECT round(sum(p * ln(p / q)), 6) AS kl, round(sqrt(greatest(0, (sum(p * ln(2 * p / (p + q))) + sum(q * ln(2 * q / (p + q)))) / 2)), 6) AS js_distance FROM r""")
def kl_js(t):
    a, b = sides(t)
    return metrics.kl_js(a, b, "x")


@query(f"""WITH {_AB}, s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, corr(x, y) AS c FROM a), u AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, corr(x, y) AS c FROM b),
k AS (SELECT ((1 - abs(s.mx - u.mx) / s.mx) + (1 - abs(s.my - u.my) / s.my)) / 2 AS m, (greatest(0, 1 - abs(s.vx - u.vx) / s.vx) + greatest(0, 1 - abs(s.vy - u.vy) / s.vy)) / 2 AS v, 1 - abs(s.c - u.c) / 2 AS c FROM s, u)
SELECT round(100 * m, 4) AS mean_kept, round(100 * v, 4) AS variance_kept, round(100 * c, 4) AS correlation_kept, round(100 * (0.4 * m + 0.3 * v + 0.3 * c), 4) AS fidelity FROM k""")
def stat_fidelity(t):
    a, b = sides(t)
    return metrics.statistical_fidelity(a, b, ["x", "y"])


@query("""WITH a AS (SELECT count(*) AS n, var_samp(p_retailprice) AS v, count(DISTINCT p_type) AS d FROM part), b AS (SELECT count(*) AS n, var_samp(p_retailprice) AS v, count(DISTINCT split_part(p_type, ' ', 1)) AS d FROM part WHERE p_size > 5),
l AS (SELECT greatest(0, 1 - b.n / a.n) AS r, greatest(0, 1 - b.v / a.v) AS v, greatest(0, 1 - b.d / a.d) AS d FROM a, b) SELECT round(r, 6) AS record_loss, round(v, 6) AS numeric_loss, round(d, 6) AS categorical_loss, round(0.4 * r + 0.3 * v + 0.3 * d, 6) AS total_loss FROM l""")
def info_loss(t):
    a = t("part").select("p_retailprice", "p_type")
    b = t("part").where("p_size > 5").select("p_retailprice", F.split("p_type", " ")[0].alias("p_type"))
    return metrics.information_loss(a, b, ["p_retailprice"], ["p_type"])


@query("SELECT 'value' AS field, 0::BIGINT AS nulls_before, count(*) FILTER (event_id % 5 = 0) AS nulls_after, round(count(*) FILTER (event_id % 5 = 0) / count(*), 6) AS loss FROM events")
def suppression_loss(t):
    return metrics.suppression_loss(t("events"), holes(t), ["value"])


@query("SELECT round(avg((l_quantity - r) ** 2), 6) AS mse, round(avg(abs(l_quantity - r)), 6) AS mae, round(1 - sum((l_quantity - r) ** 2) / (var_pop(l_quantity) * count(*)), 6) AS r2 FROM (SELECT l_quantity, round_even(l_quantity / 10, 0) * 10 AS r FROM lineitem)")
def regression_errors(t):
    return metrics.errors(generalize.round_numbers(t("lineitem"), "l_quantity", -1, "r"), "l_quantity", "r")


@query("""SELECT field, round(c / n, 6) AS completeness, round(v / c, 6) AS validity, round(d / c, 6) AS diversity, round(100 * (0.5 * c / n + 0.3 * v / c + 0.2 * d / c), 4) AS score FROM (
SELECT 'value' AS field, count(*) AS n, count(value) AS c, count(*) FILTER (value >= 10) AS v, count(DISTINCT value) AS d FROM events UNION ALL SELECT 'event_type', count(*), count(event_type), count(event_type), count(DISTINCT event_type) FROM events)""")
def quality_score(t):
    return metrics.quality_score(t("events"), ["value", "event_type"], {"value": F.col("value") >= 10})


@query("SELECT 'positive' AS rule, count(*) FILTER (o_totalprice > 0) AS passed, count(*) FILTER (NOT o_totalprice > 0) AS failed FROM orders UNION ALL SELECT 'priority', count(*) FILTER (regexp_matches(o_orderpriority, '^[1-3]-')), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders")
def rule_checks(t):
    return metrics.rule_checks(t("orders"), {"positive": F.col("o_totalprice") > 0, "priority": F.col("o_orderpriority").rlike("^[1-3]-")})


# ---- inequality

_N = "WITH c AS (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, sum(n) OVER () AS t, count(*) OVER () AS k FROM c)"


@query(_N + """ SELECT round(2 * sum(i * n) / (max(k) * max(t)) - (max(k) + 1) / max(k), 6) AS gini, round(10000 * sum((n / t) ** 2), 6) AS hhi, round((sum((n / t) ** 2) - 1 / max(k)) / (1 - 1 / max(k)), 6) AS hhi_normalized,
round(100 * sum(n) FILTER (i > k - 10) / max(t), 6) AS top_share, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM r""")
def inequality(t):
    return metrics.inequality(t("orders"), "o_custkey")


@query("""WITH c AS (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*)::DOUBLE AS m FROM c GROUP BY 1), r AS (SELECT n, m, sum(m) OVER (ORDER BY n) AS cm, sum(m * n) OVER (ORDER BY n) AS cn FROM b), p AS (SELECT range / 10 AS x FROM range(11)),
w AS (SELECT x, x * (SELECT max(cm) FROM r) AS want, (SELECT max(cn) FROM r) AS t FROM p) SELECT round(x, 6) AS keys_share, round(coalesce((cn - (cm - want) * n) / t, 0), 6) AS rows_share FROM w LEFT JOIN r ON want <= cm AND want > cm - m""")
def lorenz(t):
    return metrics.lorenz(t("orders"), "o_custkey")


# ---- profiles


@query("""SELECT 'value' AS field, count(value) AS n, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value < 0) AS negatives, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(skewness(value), 4) AS skewness FROM events""")
def prof_numeric(t):
    return profile.numeric_profile(t("events"), ["value"])


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) SELECT round(max(lo), 4) AS low, round(max(hi), 4) AS high, count(*) FILTER (value < lo OR value > hi) AS outliers FROM events, f")
def prof_outliers(t):
    return profile.outliers(t("events"), "value")


@query("WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) AS n FROM events, r GROUP BY 1")
def prof_histogram(t):
    return profile.histogram(t("events"), "value")


@query("SELECT p_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def prof_categorical(t):
    return profile.categorical_profile(t("part"), "p_type")


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def prof_corr(t):
    return profile.correlation_matrix(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""WITH r AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem), x AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM r) SELECT round(corr(ra, rb), 6) AS rho FROM x""")
def prof_spearman(t):
    return profile.spearman(t("lineitem"), "l_quantity", "l_discount")


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
s AS (SELECT max(t) * (sum(n * n / (na * nb)) - 1) AS chi2, max(t) AS t, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM m) SELECT round(chi2, 4) AS chi2, round(sqrt(chi2 / (t * (least(r, k) - 1))), 6) AS v FROM s""")
def cramers_v(t):
    return profile.cramers_v(t("orders"), "o_orderstatus", "o_orderpriority")


@query("WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1), t AS (SELECT avg(p_retailprice) AS tm, var_pop(p_retailprice) * count(*) AS ss FROM part) SELECT round(sqrt(sum(n * (m - tm) ** 2) / max(ss)), 6) AS eta FROM g, t")
def eta(t):
    return profile.correlation_ratio(t("part"), "p_brand", "p_retailprice")


@query("SELECT min(o_orderdate) AS min, max(o_orderdate) AS max, count(*) FILTER (o_orderdate IS NULL) AS nulls, count(DISTINCT year(o_orderdate)) AS years, count(DISTINCT month(o_orderdate)) AS months, count(*) FILTER (isodow(o_orderdate) >= 6) AS weekend FROM orders")
def prof_date(t):
    return profile.date_profile(t("orders"), "o_orderdate")


@query("SELECT (isodow(ts) - 1)::INT AS weekday, count(*) AS n FROM events GROUP BY 1")
def prof_date_distribution(t):
    return profile.date_distribution(t("events"), "ts", "weekday")


@query("""WITH g AS (SELECT count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY o_custkey)
SELECT 'o_orderstatus' AS field, count(*) AS groups, round(avg((a > 1)::DOUBLE), 6) AS varying, round(avg(a), 6) AS mean_distinct FROM g UNION ALL SELECT 'o_orderpriority', count(*), round(avg((b > 1)::DOUBLE), 6), round(avg(b), 6) FROM g""")
def prof_group(t):
    return profile.group_profile(t("orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH p AS (SELECT DISTINCT user_id AS k, event_type AS v FROM events) SELECT (SELECT count(*) FROM (SELECT DISTINCT k FROM p)) AS keys, (SELECT count(*) FROM (SELECT k FROM p GROUP BY 1 HAVING count(*) > 1)) AS keys_with_several,
(SELECT count(*) FROM (SELECT DISTINCT v FROM p)) AS "values", (SELECT count(*) FROM (SELECT v FROM p GROUP BY 1 HAVING count(*) > 1)) AS values_with_several""")
def prof_identity(t):
    return profile.identity_profile(t("events"), "user_id", "event_type")


def _k_sql(keys: str) -> str:
    return f"SELECT '{keys.replace(', ', '+')}' AS fields, count(*) AS groups, min(k) AS min_k, round(avg(k), 4) AS mean_k, max(k) AS max_k, coalesce(sum(k) FILTER (k < 5), 0)::BIGINT AS vulnerable, round(100 * coalesce(sum(k) FILTER (k < 5), 0) / sum(k), 4) AS record_pct, round(100 * count(*) FILTER (k < 5) / count(*), 4) AS group_pct FROM (SELECT count(*) AS k FROM customer GROUP BY {keys})"


@query(_k_sql("c_nationkey") + " UNION ALL " + _k_sql("c_nationkey, c_mktsegment"))
def prof_kanonymity(t):
    return profile.k_profile(t("customer"), [["c_nationkey"], CQI])


@query("SELECT k AS value, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def prof_mvf(t):
    return profile.mvf_profile(t("events"), F.json_object_keys("props"))


@query(rf"SELECT lower(regexp_extract(regexp_extract(text, '{_MAIL}'), '@(.+)$', 1)) AS domain, count(*) AS n FROM documents WHERE regexp_matches(text, '{_MAIL}') GROUP BY 1")
def prof_email(t):
    return profile.email_profile(t("documents").select(F.regexp_extract("text", _MAIL, 0).alias("mail")), "mail")


@query(rf"SELECT lower(regexp_extract(mail, '@(.+)$', 1)) AS domain, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_MAIL}')) AS mail FROM documents) GROUP BY 1")
def prof_email_all(t):
    return profile.email_profile(t("documents").select(F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("mail")), "mail")


@query("SELECT count(*) AS n, 0::BIGINT AS invalid, min(o_totalprice) AS min, round(avg(round(o_totalprice, 2)), 4) AS mean, max(o_totalprice) AS max FROM orders")
def prof_currency(t):
    return profile.currency_profile(t("orders").select(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("x")), "x")


@query("SELECT count(*) AS rows, 5::INT AS columns, 0::BIGINT AS missing, 3::INT AS numeric_columns FROM customer")
def dataset_summary(t):
    return profile.dataset_summary(t("customer"))


@query()
def attribute_roles(t):
    return profile.attribute_roles(t("customer"))


# ---- text

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(f"WITH w AS (SELECT unnest({_WORDS}) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def word_freq(t):
    return text.word_frequency(t("documents"), "text", 4, top=50)


@query(f"WITH w AS (SELECT {_WORDS} AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM w) SELECT ngram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 5")
def ngram_counts(t):
    return text.ngram_counts(t("documents"), "text", 2, 5)


_VOTES = "[" + ", ".join(f"{{'n': -len(list_filter(w, lambda x: list_contains({list(v)}, x))), 'l': '{k}'}}" for k, v in sorted(text.FUNCTION_WORDS.items())) + "]"


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), v AS (SELECT doc_id, list_sort({_VOTES})[1] AS v FROM d) SELECT doc_id, CASE WHEN v.n < 0 THEN v.l END AS language FROM v")
def lang_vote(t):
    return text.language_vote(t("documents"), "doc_id", "text")


@query(f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY 1, 2) SELECT doc_id, sum(c)::BIGINT AS tokens, count(*) AS types, round(count(*) / sum(c), 6) AS ttr, round(count(*) / sqrt(sum(c)), 6) AS root_ttr, round(1 - sum(c * c) / (sum(c) * sum(c)), 6) AS simpson FROM c GROUP BY 1")
def text_diversity(t):
    return text.diversity(t("documents"), "doc_id", "text")


@query("""WITH e(keyword, category, level) AS (VALUES ('login', 'access', 1), ('password', 'secret', 2), ('the', 'common', 0)), w AS (SELECT DISTINCT doc_id, unnest(""" + _WORDS + """) AS keyword FROM documents)
SELECT doc_id, keyword, category FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC, length(keyword) DESC, keyword) AS r FROM w JOIN e USING (keyword)) WHERE r = 1""")
def dict_match(t):
    docs = t("documents")
    entries = docs.sparkSession.createDataFrame([("login", "access", 1), ("password", "secret", 2), ("the", "common", 0)], "keyword string, category string, level int")
    return text.dictionary_match(docs, "doc_id", "text", entries)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS k FROM events GROUP BY ALL")
def windowed_k(t):
    return windowed_group_sizes(t("events"), "ts", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- more of the inventory


@query("WITH k AS (SELECT c_custkey, c_name, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer) SELECT c_custkey, CASE WHEN k < 2 THEN NULL WHEN k < 12 THEN '*****' ELSE c_name END AS c_name FROM k")
def adaptive_mask(t):
    return cond.adaptive(models.enrich_k(t("customer"), CQI, "k"), "k", "c_name", ((2, "suppress"), (12, "full_mask"))).select("c_custkey", "c_name")


@query("WITH g AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_type, p_brand AS mode, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r, sum(n) OVER (PARTITION BY p_type) AS rows FROM g), w AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1) SELECT p_partkey, CASE WHEN p_size < 10 THEN CASE WHEN rows >= 5 THEN mode ELSE (SELECT p_brand FROM w) END ELSE p_brand END AS p_brand FROM part JOIN m USING (p_type) WHERE r = 1")
def supp_cell_group_mode(t):
    return suppress.suppress_cells(t("part"), "p_brand", F.col("p_size") < 10, "group_mode", group="p_type").select("p_partkey", "p_brand")


@query("SELECT o_orderkey, 'range' AS suppression_reason FROM orders WHERE o_totalprice BETWEEN 50000 AND 1000000")
def supp_record_removed(t):
    return suppress.suppressed_records(t("orders"), suppress.record_mask("o_totalprice", "range", [50000, 1000000]), "range").select("o_orderkey", "suppression_reason")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN d < 6 THEN 'MASKED' ELSE CAST(qty_bin AS VARCHAR) END AS qty_bin FROM {_LINES} JOIN (SELECT l_returnflag, l_linestatus, ship_year, count(DISTINCT qty_bin) AS d FROM {_LINES} GROUP BY ALL) USING (l_returnflag, l_linestatus, ship_year)")
def ldiv_mask(t):
    return models.l_mask(lines(t), QI, "qty_bin", 6).select("l_orderkey", "l_linenumber", "qty_bin")


@query(_GRID + """, y AS (SELECT *, abs(sum(n) OVER r / sum(n) OVER w - sum(an) OVER r / sum(an) OVER w) AS gap FROM x WINDOW r AS (PARTITION BY l_returnflag, l_linestatus, ship_year ORDER BY qty_bin), w AS (PARTITION BY l_returnflag, l_linestatus, ship_year)),
g2 AS (SELECT l_returnflag, l_linestatus, ship_year FROM y GROUP BY 1, 2, 3 HAVING round(sum(gap), 6) <= 0.05) SELECT count(*) AS rows FROM """ + _LINES + " SEMI JOIN g2 USING (l_returnflag, l_linestatus, ship_year)")
def tclose_suppress(t):
    return models.t_suppress(lines(t), QI, "qty_bin", 0.05).agg(F.count("*").alias("rows"))


@query("SELECT 'p_type' AS field, count(DISTINCT p_type) AS distinct_before, count(DISTINCT split_part(p_type, ' ', 1)) AS distinct_after, round(1 - count(DISTINCT split_part(p_type, ' ', 1)) / count(DISTINCT p_type), 6) AS lost FROM part")
def group_information_loss(t):
    return models.group_information_loss(t("part"), t("part").withColumn("p_type", F.split("p_type", " ")[0]), ["p_type"])


@query("SELECT round(count(*) FILTER (contains(m, '*')) / count(*), 6) AS masked FROM (SELECT CASE WHEN p_size < 25 THEN repeat('*', length(p_name)) ELSE p_name END AS m FROM part)")
def masking_ratio(t):
    return metrics.masking_ratio(t("part").withColumn("m", F.when(F.col("p_size") < 25, mask.stars(F.length("p_name"))).otherwise(F.col("p_name"))), "m")


@query("SELECT round(least(1, count(*) / sum(k)), 6) AS risk, min(k) AS min_group FROM (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment)")
def simple_disclosure_risk(t):
    return metrics.simple_disclosure_risk(t("customer"), CQI)


@query("WITH g AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT CASE WHEN k < 2 THEN '<2' WHEN k < 5 THEN '<5' WHEN k < 10 THEN '<10' WHEN k < 50 THEN '<50' ELSE '>=50' END AS band, count(*) AS groups, sum(k)::BIGINT AS records FROM g GROUP BY 1")
def risk_bands(t):
    return metrics.risk_bands(t("customer"), CQI)


@query("""WITH f AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1), g AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1), p AS (SELECT 1.0::DOUBLE AS full_, count(*) / sum(n) AS many, 1 - max(n) / sum(n) AS even FROM f UNION ALL SELECT 1.0, count(*) / sum(n), 1 - max(n) / sum(n) FROM g)
SELECT round(avg(full_), 6) AS completeness, round(avg(many), 6) AS diversity, round(avg(even), 6) AS balance, round(0.25 * (avg(full_) + avg(many) + avg(even) + 0.2), 6) AS utility FROM p""")
def predicted_utility(t):
    return metrics.predicted_utility(t("part"), ["p_brand", "p_type"])


@query("SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)")
def unique_violations(t):
    return metrics.unique_violations(t("orders"), ["o_custkey", "o_orderpriority"])


@query("SELECT count(*) AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def reference_violations(t):
    return metrics.reference_violations(t("orders"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey")


@query(f"WITH {_AB}, a2 AS (SELECT l_returnflag AS g, avg(l_quantity) AS m FROM lineitem GROUP BY 1), b2 AS (SELECT l_returnflag AS g, avg(round_even(l_quantity / 10, 0) * 10) AS m FROM lineitem GROUP BY 1) SELECT round(least(100, avg((a2.m - b2.m) ** 2)), 6) AS loss FROM a2 JOIN b2 USING (g)")
def ldiversity_loss(t):
    a = t("lineitem").select("l_returnflag", "l_quantity")
    return metrics.l_diversity_loss(a, generalize.round_numbers(a, "l_quantity", -1), ["l_returnflag"], "l_quantity")


@query(_CDF + """, d AS (SELECT abs(sum(p) OVER (ORDER BY x) - sum(q) OVER (ORDER BY x)) AS d FROM c), s AS (SELECT round(max(d), 6) AS s FROM d), q AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS qa, max(x) - min(x) AS w FROM a), r AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS qb FROM b)
SELECT round(0.6 * (1 - s) + 0.4 * greatest(0, 1 - (abs(qa[1] - qb[1]) + abs(qa[2] - qb[2]) + abs(qa[3] - qb[3])) / 3 / w), 6) AS fidelity FROM s, q, r""")
def distribution_fidelity(t):
    a, b = sides(t)
    return metrics.distribution_fidelity(a, b, "x")


@query("SELECT CASE WHEN year(o_orderdate) < 1940 THEN 'too_old' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'future' WHEN year(o_orderdate) > 1996 THEN 'too_young' ELSE 'valid' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def prof_date_anomalies(t):
    return profile.date_anomalies(t("orders"), "o_orderdate", youngest=1996, today="1998-01-01")


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 <> 0) AS valid, count(*) FILTER (c_custkey % 3 = 1) AS with_country FROM customer")
def prof_phone(t):
    kind = F.col("c_custkey") % 3
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "1")
    return profile.phone_profile(t("customer").select(F.when(kind == 1, F.concat(F.lit("+49 "), number)).when(kind == 2, number).otherwise("none").alias("p")), "p")


_PAIRS = f"w AS (SELECT {_WORDS} AS w FROM documents), s AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM w) GROUP BY 1), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM w), n AS (SELECT p.a AS a, p.b AS b, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 20)"


@query(f"WITH {_PAIRS} SELECT a, b, n, round(log2(n * (SELECT sum(c) FROM s)::DOUBLE / (sa.c * sb.c)), 6) AS pmi FROM n JOIN s sa ON sa.x = a JOIN s sb ON sb.x = b")
def text_collocations(t):
    return text.collocations(t("documents"), "text", 20)


_ENT = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in text.ENTITY_PATTERNS.items())


@query(_ENT)
def text_entities(t):
    return text.entities(t("documents"), "doc_id", "text")


@query()
def text_leader_clusters(t):
    return text.leader_clusters(t("part"), "p_type")


@query()
def text_leader_documents(t):
    return text.leader_clusters(t("documents"), "text")


@query()
def impute_random_sample(t):
    known = t("documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))
    return reshape.impute(known, "lang", "random_sample", order=["doc_id"])


_P, _SHIFT = text.HASH_PRIME, text.GRAM_FACTOR


@query(f"""WITH h AS (SELECT doc_id, list_transform({_WORDS}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT & 2147483647) AS h FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(h) >= 3 THEN list_transform(range(1, len(h) - 1), lambda i: (((h[i] % {_P} * {_SHIFT} + h[i + 1]) % {_P}) * {_SHIFT} + h[i + 2]) % {_P})
WHEN len(h) = 2 THEN [(h[1] % {_P} * {_SHIFT} + h[2]) % {_P}] WHEN len(h) = 1 THEN [h[1] % {_P}] ELSE [] END AS g FROM h)
SELECT doc_id, array_to_string(list_transform(range(1, 129), lambda s: coalesce(list_min(list_transform(g, lambda x: (x * (s * 7919 + 104729) + s * 15485863) % {_P})), {_P})), ',') AS signature FROM g""")
def text_minhash(t):
    return t("documents").where("text is not null").select("doc_id", F.array_join(text.minhash(F.col("text")).cast("array<string>"), ",").alias("signature"))


@query()
def typo_candidates(t):
    rows = t("nation").select(F.col("n_name").alias("v")).withColumn("v", F.explode(F.array_repeat("v", 12)))
    wrong = t("nation").select(F.concat(F.col("n_name"), F.lit("x")).alias("v"))
    return profile.typo_candidates(rows.unionByName(wrong), "v")


@query()
def typo_words(t):
    words = t("documents").select(F.explode(text.words(F.col("text"))).alias("word"))
    return profile.typo_candidates(words, "word")


@query()
def model_membership(t):
    p = t("part").select("p_partkey", "p_size", "p_retailprice")
    return attacks.model_membership(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"), p, "p_partkey", ["p_size", "p_retailprice"])


@query()
def noise_impact(t):
    out = noise.uniform_numeric_noise(t("events"), "value", 1.0, output="noisy")
    return noise.noise_impact(out, "value", "noisy")


from . import wider  # noqa: E402, F401  (registers its queries)
