"""More registered queries: sources and sinks, strategies by name, and the operators that the first catalog leaves out."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conditions as cond
from ..operators import attacks, fake, generalize, mask, metrics, models, noise, profile, pseudonymize, registry, reshape, suppress, text
from ..sources import readers
from .catalog import CQI, QI, lines, query

_LINES = "(SELECT *, year(l_shipdate)::INT AS ship_year, CAST(floor(l_quantity / 10) AS INT) AS qty_bin FROM lineitem)"


def scratch(df: DataFrame, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only for a local master."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cloakframe-")
    return f"{base}/{uuid.uuid4().hex}-{name}"


# ---- sources and sinks

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _round_trip(t, kind: str, **options) -> DataFrame:
    df = t("customer")
    path = scratch(df, f"customer.{kind}")
    readers.write(df, path, kind, **options)
    return readers.read(df.sparkSession, path, kind, schema=_CUSTOMER_SCHEMA, **options)


@query(_CUSTOMER)
def io_csv(t):
    return _round_trip(t, "csv")


@query(_CUSTOMER)
def io_csv_semicolon(t):
    return _round_trip(t, "csv", sep=";")


@query(_CUSTOMER)
def io_tsv(t):
    return _round_trip(t, "tsv")


@query(_CUSTOMER)
def io_json_lines(t):
    return _round_trip(t, "json", multiLine=False)


@query(_CUSTOMER)
def io_parquet(t):
    return _round_trip(t, "parquet")


@query(_CUSTOMER)
def io_orc(t):
    return _round_trip(t, "orc")


@query("SELECT c_custkey, c_name FROM customer")
def io_inferred_columns(t):
    """Schema and separator are found, two columns picked."""
    df = t("customer")
    path = scratch(df, "customer.csv")
    readers.write(df, path, "csv", sep=";")
    found = readers.sniff(df.sparkSession, path)
    return readers.read(df.sparkSession, path, "csv", columns=["c_custkey", "c_name"], sep=found["sep"]).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT c_custkey AS key, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def io_many_files(t):
    """Files of one form are read as one table, batch after batch."""
    a = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"))
    b = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))
    paths = []
    for k, df in enumerate((a, b)):
        paths.append(scratch(df, f"part{k}.parquet"))
        readers.write(df, paths[-1], "parquet")
    spark = a.sparkSession
    return readers.stack([readers.read(spark, batch, "parquet") for batch in readers.file_batches(spark, paths, 1)])


@query("SELECT c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def io_common_columns(t):
    a = t("customer").selectExpr("c_custkey AS key", "c_nationkey AS nation", "c_mktsegment AS segment")
    return readers.stack([a, t("supplier").selectExpr("s_suppkey AS key", "s_nationkey AS nation", "s_name AS name")])


@query("SELECT c_custkey AS key, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def union_all_columns(t):
    a = t("customer").selectExpr("c_custkey AS key", "c_mktsegment AS segment")
    return readers.stack([a, t("supplier").selectExpr("s_suppkey AS key", "s_name AS name")], all_columns=True)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def io_sample(t):
    return readers.sample_rows(t("orders"), 100, "o_orderkey", 7).select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name FROM nation")
def io_task_output(t):
    df = t("nation").select("n_nationkey", "n_name")
    manifest = readers.write_task_output(df, scratch(df, "task"), "nations", {"rows": 25})
    return df.sparkSession.read.parquet(manifest["path"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def io_encrypted_columns(t):
    """Columns are written encrypted, read and opened again."""
    df, key = t("customer").select("c_custkey", "c_name", "c_acctbal"), b"0123456789abcdef"
    path = scratch(df, "sealed.parquet")
    readers.encrypt_columns(df, ["c_name", "c_acctbal"], key).write.parquet(path)
    return readers.decrypt_columns(df.sparkSession.read.parquet(path), ["c_name", "c_acctbal"], key).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("SELECT n_name || chr(10) AS content, CAST(length(n_name) + 1 AS BIGINT) AS size FROM nation WHERE n_nationkey < 3")
def io_encrypted_files(t):
    """Whole files are sealed and opened; each row is a file's content."""
    df = t("nation").where("n_nationkey < 3")
    path, sealed = scratch(df, "plain"), scratch(df, "sealed")
    df.select("n_name").repartition(3, "n_name").sortWithinPartitions("n_name").write.option("maxRecordsPerFile", 1).text(path)
    readers.encrypt_files(df.sparkSession, f"{path}/*.txt", sealed, b"0123456789abcdef")
    return readers.decrypt_files(df.sparkSession, sealed, b"0123456789abcdef").where("size > 0").select(F.col("content").cast("string").alias("content"), "size")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT 999999999, 'ADDED'")
def io_json_merge(t):
    """Rows merged by key into a JSON table of lines."""
    df = t("customer").select("c_custkey", "c_mktsegment")
    old, new = scratch(df, "old.json"), scratch(df, "new.json")
    readers.merge_json(df, None, old, ["c_custkey"])
    more = df.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")).unionByName(df.sparkSession.createDataFrame([(999999999, "ADDED")], df.schema))
    readers.merge_json(more, old, new, ["c_custkey"])
    return df.sparkSession.read.schema(df.schema).json(new)


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation")
def io_oriented_json(t):
    """One object of columns, each of row to value."""
    df = t("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    path = scratch(df, "oriented.json")
    row = F.col("key").cast("string")
    maps = [F.map_from_entries(F.collect_list(F.struct(row, F.col(c)))).alias(c) for c in ("key", "name")]
    df.agg(F.struct(*maps).alias("o")).select(F.to_json("o").alias("value")).write.text(path)
    return readers.read_oriented_json(df.sparkSession, path, "columns", "key long, name string")


@query("SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS checksum, 'UTF-8' AS encoding FROM nation")
def io_checksum(t):
    """SHA-256 and encoding of a file that Spark wrote."""
    df = t("nation").select("n_name").coalesce(1).sortWithinPartitions("n_name")
    path = scratch(df, "names")
    df.write.text(path)
    spark = df.sparkSession
    at = spark.read.format("binaryFile").load(f"{path}/*.txt").select("path").first()["path"]
    return spark.createDataFrame([(readers.checksum(spark, at), readers.encoding_of(spark, at))], "checksum string, encoding string")


@query("SELECT c_custkey, c_name FROM customer")
def io_lenient_columns(t):
    return readers.pick_columns(t("customer"), ["c_custkey", "c_name", "absent"], strict=False)


# ---- conditions


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'positive' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def conditional_case(t):
    return cond.apply_where(t("customer"), "c_mktsegment", F.lit("positive"), cond.condition("c_acctbal", "gt", [0])).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, 'positive' AS flag FROM customer WHERE c_acctbal > 0")
def conditional_filter(t):
    return cond.apply_where(t("customer"), "c_mktsegment", F.lit("positive"), cond.condition("c_acctbal", "gt", [0]), "flag", "filter").select("c_custkey", "flag")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F') OR o_totalprice <= 50000 OR o_orderpriority = '1-URGENT'")
def conditions_any(t):
    tests = [{"field": "o_orderstatus", "operator": "not_in", "values": ["F"]}, {"field": "o_totalprice", "operator": "le", "values": [50000]}, {"field": "o_orderpriority", "operator": "eq", "values": ["1-URGENT"]}]
    return t("orders").where(cond.conditions(tests, "or")).select("o_orderkey")


@query("WITH k AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer) SELECT c_custkey, k FROM k WHERE k >= 20 AND c_acctbal > 0")
def risk_filtered(t):
    rows = models.enrich_k(t("customer"), CQI, "k")
    return cond.risk_filtered(rows, "k", "ge", 20, F.col("c_acctbal") > 0).select("c_custkey", "k")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def reversible_key(t):
    """A key from fields, opened again."""
    keyed = t("customer").select("c_custkey", cond.reversible_key(["c_nationkey", "c_mktsegment"]).alias("key"))
    return keyed.select("c_custkey", cond.open_reversible_key("key", "c_nationkey int, c_mktsegment string").alias("o")).select("c_custkey", "o.*")


for _kind, _new in (("remove", None), ("suppress", "NULL::DOUBLE"), ("mean", "(SELECT avg(c_acctbal) FROM k WHERE k >= 20)"), ("custom", "-1.0::DOUBLE")):
    _K = "WITH k AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer) "
    _sql = _K + ("SELECT c_custkey, c_acctbal FROM k WHERE k >= 20" if _new is None else f"SELECT c_custkey, CASE WHEN k < 20 THEN {_new} ELSE c_acctbal END AS c_acctbal FROM k")

    def _vulnerable(t, kind=_kind):
        return cond.vulnerable_rows(models.enrich_k(t("customer"), CQI, "k"), "k", 20, "c_acctbal", kind, -1.0).select("c_custkey", "c_acctbal")

    _vulnerable.__name__ = f"vulnerable_{_kind}"
    query(_sql)(_vulnerable)


# ---- generalization


@query("""WITH m AS (SELECT min(o_orderdate) AS s FROM orders), d AS (SELECT o_orderkey, floor((epoch_us(o_orderdate) - epoch_us(s)) / 86400000000.0) AS d FROM orders, m),
b AS (SELECT o_orderkey, CAST(CASE WHEN d = 0 THEN 0 ELSE (ceil(d / 30.0) - 1) * 30 END AS BIGINT) AS low FROM d) SELECT o_orderkey, printf('Day %d-%d', low, low + 30) AS days FROM b""")
def gen_datetime_day_range(t):
    return generalize.bin_dates(t("orders"), "o_orderdate", "day_range", 30, output="days").select("o_orderkey", "days")


@query("SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1992-01-01' THEN NULL WHEN o_orderdate <= TIMESTAMP '1994-06-30' THEN 'early' WHEN o_orderdate <= TIMESTAMP '1996-06-30' THEN 'middle' WHEN o_orderdate <= TIMESTAMP '1999-12-31' THEN 'late' END AS era FROM orders")
def gen_datetime_custom(t):
    edges = [(datetime(1992, 1, 1), ""), (datetime(1994, 6, 30), "early"), (datetime(1996, 6, 30), "middle"), (datetime(1999, 12, 31), "late")]
    return generalize.bin_dates(t("orders"), "o_orderdate", "custom", edges=edges, output="era").select("o_orderkey", "era")


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_retailprice > 1500 THEN 'dear' WHEN p_size < 5 THEN 'small' ELSE 'other' END AS kind FROM part")
def gen_category_rules(t):
    rules = [(1, F.col("p_size") < 5, "small"), (9, F.col("p_size") > 40, "large"), (5, F.col("p_retailprice") > 1500, "dear")]
    return generalize.category_rules(t("part"), "p_type", rules, "other", "kind").select("p_partkey", "kind")


@query("SELECT p_partkey, p_type || '|' || p_brand AS merged FROM part")
def gen_category_split_merge(t):
    """Two categories in one text are split into parts and merged again."""
    rows = t("part").withColumn("both", F.concat_ws(" |", "p_type", "p_brand"))
    return generalize.merge_categories(generalize.split_categories(rows, "both"), "parts", "|", "merged").select("p_partkey", "merged")


@query("""WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT p_name, row_number() OVER (ORDER BY n DESC, p_name) - 1 AS k, (SELECT greatest(1, count(*) // 10) FROM c WHERE n < 5) AS g FROM c WHERE n < 5)
SELECT p_partkey, CASE WHEN k IS NULL THEN p.p_name ELSE printf('RARE%03d', k % g) END AS p_name FROM part p LEFT JOIN r USING (p_name)""")
def gen_categorical_numbered(t):
    return generalize.group_rare(t("part"), "p_name", 5, "numbered", "RARE").select("p_partkey", "p_name")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'works' ELSE 'UNKNOWN' END AS segment FROM customer")
def gen_categorical_unknown(t):
    """Values that the dictionary lacks become unknown, nulls stay."""
    rows = t("customer").withColumn("segment", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")))
    words = rows.sparkSession.createDataFrame([("building", "works"), ("Machinery ", "works")], "value string, sector string")
    return generalize.hierarchy(rows, "segment", words, "sector", "UNKNOWN").select("c_custkey", "segment")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'works' ELSE 'other' END AS segment FROM customer")
def gen_categorical_fuzzy(t):
    """A dictionary with a spelling mistake still finds its value."""
    words = t("customer").sparkSession.createDataFrame([("bulding", "works")], "value string, sector string")
    return generalize.hierarchy(t("customer"), "c_mktsegment", words, "sector", "other", similar=0.8, output="segment").select("c_custkey", "segment")


# ---- operations by name


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN round_even(l_extendedprice / 100.0, 0) * 100.0 ELSE l_extendedprice END AS _l_extendedprice FROM lineitem")
def op_enrich_where(t):
    """ENRICH adds a column, only rows that pass are changed."""
    return registry.operate(t("lineitem"), "numeric_generalization", "l_extendedprice", "rounding", "ENRICH", where=F.col("l_returnflag") == "R", precision=-2).select("l_orderkey", "l_linenumber", "l_extendedprice", "_l_extendedprice")


_NULLED = "(SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name FROM customer)"
for _strategy, _sql in (
    ("PRESERVE", f"SELECT c_custkey, repeat('*', length(name)) AS name FROM {_NULLED}"),
    ("EXCLUDE", f"SELECT c_custkey, repeat('*', length(name)) AS name FROM {_NULLED} WHERE name IS NOT NULL"),
    ("ANONYMIZE", f"SELECT c_custkey, coalesce(repeat('*', length(name)), 'NONE') AS name FROM {_NULLED}"),
):

    def _nulls(t, strategy=_strategy):
        rows = t("customer").withColumn("name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")))
        return registry.operate(rows, "full_masking", "name", null_strategy=strategy, null_value="NONE").select("c_custkey", "name")

    _nulls.__name__ = f"op_nulls_{_strategy.lower()}"
    query(_sql)(_nulls)


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 30 THEN '10-30' ELSE '>=30' END AS p_size, upper(substr(p_name, 1, 1)) || repeat('x', 3) AS p_name FROM part")
def op_hooks(t):
    """Own code over values beside an operation by name."""
    rows = registry.operate(t("part"), "numeric_generalization", "p_size", "range", limits=[(10, 30)])
    return registry.process_values(rows, "p_name", lambda v: v[:1].upper() + "xxx").select("p_partkey", "p_size", "p_name")


@query("SELECT p_partkey, p_size * 2 AS p_size FROM part")
def op_batch_hook(t):
    return registry.process_batches(t("part").select("p_partkey", "p_size"), lambda b: b.assign(p_size=b["p_size"] * 2))


# ---- masking


@query("SELECT c_custkey, regexp_replace(substr(c_name, 1, 1), '[^\\-_.@/\\\\:; ()\\[\\]]', '*') || substr(c_name, 2, 2) || regexp_replace(substr(c_name, 4), '[^\\-_.@/\\\\:; ()\\[\\]]', '*', 'g') AS c_name FROM customer")
def mask_positions(t):
    return mask.mask_positions(t("customer"), "c_name", [1, 2]).select("c_custkey", "c_name")


_PHONES = "SELECT c_custkey, printf('+1 (%03d) %03d-%04d', c_nationkey + 200, c_custkey % 900 + 100, c_custkey % 10000) AS phone, printf('4%03d-%04d-%04d-%04d', c_custkey % 1000, c_nationkey, c_custkey % 10000, 9999 - c_custkey % 10000) AS card, printf('10.%d.%d.7', c_nationkey, c_custkey % 250) AS ip, printf('%04d-%02d-%02d', 1950 + c_nationkey, c_custkey % 12 + 1, c_custkey % 28 + 1) AS born, printf('%03d-%02d-%04d', c_custkey % 900, c_nationkey, c_custkey % 10000) AS ssn FROM customer"


def _contacts(t) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t("customer").select(
        "c_custkey", F.format_string("+1 (%03d) %03d-%04d", n + 200, k % 900 + 100, k % 10000).alias("phone"), F.format_string("4%03d-%04d-%04d-%04d", k % 1000, n, k % 10000, 9999 - k % 10000).alias("card"),
        F.format_string("10.%d.%d.7", n, k % 250).alias("ip"), F.format_string("%04d-%02d-%02d", n + 1950, k % 12 + 1, k % 28 + 1).alias("born"), F.format_string("%03d-%02d-%04d", k % 900, n, k % 10000).alias("ssn"),
    )


@query(f"SELECT c_custkey, regexp_replace(substr(phone, 1, length(phone) - 4), '[0-9]', '*', 'g') || right(phone, 4) AS phone, regexp_replace(substr(card, 1, 15), '[0-9]', '*', 'g') || right(card, 4) AS card, regexp_replace(ip, '^([0-9]+)\\.([0-9]+)\\..*$', '\\1.\\2.*.*') AS ip FROM ({_PHONES})")
def mask_presets(t):
    """Last four digits of phones and cards, subnet of addresses."""
    out = mask.mask_ip(mask.mask_card(mask.mask_phone(_contacts(t), "phone"), "card"), "ip")
    return out.select("c_custkey", "phone", "card", "ip")


@query(f"SELECT c_custkey, substr(phone, 1, 6) || regexp_replace(substr(phone, 7), '[0-9]', '*', 'g') AS phone, substr(card, 1, 4) || regexp_replace(substr(card, 5, 11), '[0-9]', '*', 'g') || right(card, 4) AS card, '10.*.*.*' AS ip FROM ({_PHONES})")
def mask_presets_more(t):
    """First three digits of phones, both ends of cards, network of addresses."""
    out = mask.mask_ip(mask.mask_card(mask.mask_phone(_contacts(t), "phone", "area_code"), "card", 4, 4), "ip", "network")
    return out.select("c_custkey", "phone", "card", "ip")


@query(f"SELECT c_custkey, substr(born, 1, 4) || '-**-**' AS born, '***-**-' || right(ssn, 4) AS ssn FROM ({_PHONES})")
def mask_patterns(t):
    out = mask.mask_pattern(mask.mask_pattern(_contacts(t), "born", "date_iso"), "ssn", "ssn")
    return out.select("c_custkey", "born", "ssn")


@query(f"SELECT c_custkey, '****-**-**' AS born, '****-****-****-****' AS card, repeat('*', length(c_custkey::VARCHAR || ' x')) AS plain FROM ({_PHONES})")
def mask_formats(t):
    """Separators of the pattern found stay; other texts are masked whole."""
    rows = _contacts(t).withColumn("plain", F.concat(F.col("c_custkey").cast("string"), F.lit(" x")))
    for f in ("born", "card", "plain"):
        rows = mask.mask_by_format(rows, f, ("email", "ssn", "credit_card", "ipv4", "date_iso"))
    return rows.select("c_custkey", "born", "card", "plain")


@query(f"SELECT c_custkey, 'date_iso' AS born, 'ssn' AS ssn, 'ipv4' AS ip FROM ({_PHONES})")
def mask_detect(t):
    return _contacts(t).select("c_custkey", *[mask.detect_pattern(F.col(c)).alias(c) for c in ("born", "ssn", "ip")])


@query("SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS c_name FROM customer")
def mask_regex(t):
    return mask.mask_regex(t("customer"), "c_name", "[0-9]+", "#").select("c_custkey", "c_name")


@query("""WITH c AS (SELECT c_custkey, c_name, unnest(range(0, length(c_name))) AS i FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('42:' || i || ':' || c_name), i) AS r FROM c)
SELECT c_custkey, string_agg(CASE WHEN r <= floor(length(c_name) * 0.4) THEN '*' ELSE substr(c_name, i + 1, 1) END, '' ORDER BY i) AS c_name FROM r GROUP BY c_custkey""")
def mask_share(t):
    return mask.mask_share(t("customer"), "c_name", 40).select("c_custkey", "c_name")


# ---- suppression

for _kind, _new in (("mean", "(SELECT avg(c_acctbal) FROM customer)"), ("median", "(SELECT median(c_acctbal) FROM customer)"), ("constant", "0.0::DOUBLE"), ("null", "NULL::DOUBLE")):

    def _cells(t, kind=_kind):
        return suppress.suppress_cells(t("customer"), "c_acctbal", F.col("c_nationkey") < 5, kind, 0.0).select("c_custkey", "c_acctbal")

    _cells.__name__ = f"supp_cell_{_kind}"
    query(f"SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN {_new} ELSE c_acctbal END AS c_acctbal FROM customer")(_cells)


@query("WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - m) / s > 1.5 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem, s")
def supp_cell_zscore(t):
    rows = t("lineitem")
    return suppress.suppress_cells(rows, "l_quantity", suppress.outlier_mask(rows, "l_quantity", "zscore", 1.5)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT 'urgent' AS reason, count_if(o_orderpriority = '1-URGENT') AS rows, round(avg(CAST(o_orderpriority = '1-URGENT' AS INT)), 6) AS share FROM orders UNION ALL SELECT 'dear', count_if(o_totalprice > 200000), round(avg(CAST(o_totalprice > 200000 AS INT)), 6) FROM orders")
def supp_report(t):
    return suppress.suppression_report(t("orders"), {"urgent": F.col("o_orderpriority") == "1-URGENT", "dear": F.col("o_totalprice") > 200000})


@query("SELECT o_orderkey, 'urgent' AS suppression_reason FROM orders WHERE o_orderpriority = '1-URGENT'")
def supp_removed_records(t):
    return suppress.suppressed_records(t("orders"), F.col("o_orderpriority") == "1-URGENT", "urgent").select("o_orderkey", "suppression_reason")


# ---- noise

_U = "(('0x' || substr(md5('{s}:' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"SELECT c_custkey, round(c_acctbal + (2 * {_U.format(s=42)} - 1) * 100, 4) AS c_acctbal FROM customer")
def noise_keyed_uniform(t):
    return noise.keyed_noise(t("customer"), "c_acctbal", ["c_custkey"], "uniform", 100.0, 4).select("c_custkey", "c_acctbal")


@query(f"SELECT c_custkey, round(c_acctbal - 50 * sign(u - 0.5) * ln(greatest(1 - 2 * abs(u - 0.5), 1e-15)), 4) AS c_acctbal FROM (SELECT *, {_U.format(s=42)} AS u FROM customer)")
def noise_keyed_laplace(t):
    return noise.keyed_noise(t("customer"), "c_acctbal", ["c_custkey"], "laplace", 50.0, 4).select("c_custkey", "c_acctbal")


@query(f"SELECT c_custkey, round(c_acctbal + 50 * sqrt(-2 * ln(greatest(u, 1e-15))) * cos(2 * pi() * v), 4) AS c_acctbal FROM (SELECT *, {_U.format(s=42)} AS u, {_U.format(s=43)} AS v FROM customer)")
def noise_keyed_normal(t):
    return noise.keyed_noise(t("customer"), "c_acctbal", ["c_custkey"], "normal", 50.0, 4).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_orderdate + to_days(CAST(floor(('0x' || substr(md5('42:' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0 * 15) AS INT) - 7) AS o_orderdate FROM orders")
def noise_keyed_shift(t):
    return noise.keyed_shift(t("orders"), "o_orderdate", ["o_orderkey"], 7).select("o_orderkey", "o_orderdate")


@query(f"""WITH e AS (SELECT least(greatest(floor(((2 * {_U.format(s=42)} - 1) * 100 + 100) / 20.0), 0), 9) AS b FROM customer), c AS (SELECT b, count(*)::DOUBLE AS n FROM e GROUP BY b)
SELECT sum(n)::BIGINT AS n, round(sum(n * n) * 10 / sum(n) - sum(n), 4) AS chi2, round((sum(n * n) * 10 / sum(n) - sum(n) - 9) / sqrt(18.0), 4) AS z FROM c""")
def noise_uniformity(t):
    rows = noise.keyed_noise(t("customer").withColumn("zero", F.lit(0.0)), "zero", ["c_custkey"], "uniform", 100.0, output="noisy")
    return noise.noise_uniformity(rows, "zero", "noisy", 100.0)


@query(f"""WITH r AS (SELECT c_acctbal AS x, (2 * {_U.format(s=42)} - 1) * 100 AS e FROM customer)
SELECT round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(max(abs(e)), 6) AS max_error, round(corr(x, x + e), 6) AS correlation, round(10 * log10(var_pop(x) / var_pop(e)), 6) AS snr_db FROM r""")
def noise_impact_keyed(t):
    rows = noise.keyed_noise(t("customer"), "c_acctbal", ["c_custkey"], "uniform", 100.0, output="noisy")
    return noise.noise_impact(rows, "c_acctbal", "noisy")


@query("""WITH s AS (SELECT o_orderdate AS x, o_orderdate + to_days(CAST(floor(('0x' || substr(md5('42:' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0 * 15) AS INT) - 7) AS y FROM orders)
SELECT count(*) AS n, round(avg((epoch_us(y) - epoch_us(x)) / 86400000000.0), 6) AS mean_days, round(max(abs((epoch_us(y) - epoch_us(x)) / 86400000000.0)), 6) AS max_days, round(avg(CAST(isodow(x) = isodow(y) AS INT)), 6) AS weekday_kept,
round(avg(CAST(month(x) = month(y) AS INT)), 6) AS month_kept, round(avg(CAST((isodow(x) >= 6) = (isodow(y) >= 6) AS INT)), 6) AS weekend_kept FROM s""")
def noise_temporal_impact(t):
    return noise.temporal_impact(noise.keyed_shift(t("orders"), "o_orderdate", ["o_orderkey"], 7, output="moved"), "o_orderdate", "moved")


@query("SELECT round(stddev_samp(c_acctbal) / sqrt(10.0) * sqrt(12.0), 4) AS uniform, round(stddev_samp(c_acctbal) / sqrt(10.0) / sqrt(2.0), 4) AS laplace FROM customer")
def noise_suggested_range(t):
    df = t("customer")
    return df.sparkSession.createDataFrame([(round(noise.suggested_range(df, "c_acctbal"), 4), round(noise.suggested_range(df, "c_acctbal", kind="laplace"), 4))], "uniform double, laplace double")


# ---- pseudonyms


@query("WITH d AS (SELECT DISTINCT c_name FROM customer) SELECT c_custkey, 'C_' || lpad(r::VARCHAR, 6, '0') AS c_name FROM customer JOIN (SELECT c_name, row_number() OVER (ORDER BY c_name) AS r FROM d) USING (c_name)")
def pseudo_apply_map(t):
    """A map made, sealed, opened and applied."""
    df, key = t("customer"), b"0123456789abcdef"
    path = scratch(df, "map.parquet")
    pseudonymize.save_map(pseudonymize.sequential_map(df, "c_name", prefix="C"), path, key)
    return pseudonymize.apply_map(df, "c_name", pseudonymize.load_map(df.sparkSession, path, key)).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer")
def pseudo_reverse_map(t):
    df = t("customer")
    m = pseudonymize.hashed_map(df, "c_name", "s")
    return pseudonymize.reverse_map(pseudonymize.apply_map(df, "c_name", m), "c_name", m).select("c_custkey", "c_name")


@query("""WITH k AS (SELECT DISTINCT c_mktsegment AS o FROM customer WHERE c_nationkey < 3), n AS (SELECT o, row_number() OVER (ORDER BY o) AS r FROM k),
m AS (SELECT DISTINCT c_name AS o FROM customer) SELECT o AS original, 'ID_' || (1000000 + r)::VARCHAR AS pseudonym FROM n UNION ALL SELECT o, 'ID_' || (1000000 + (SELECT max(r) FROM n) + row_number() OVER (ORDER BY o))::VARCHAR FROM m""")
def pseudo_mapping_large(t):
    """Numbers of more digits than are padded stay whole, and new ones go on from the greatest."""
    known = pseudonymize.sequential_map(t("customer").where("c_nationkey < 3"), "c_mktsegment", prefix="", digits=1)
    known = known.select("original", F.concat(F.lit("ID_"), (F.col("pseudonym").cast("long") + 1_000_000).cast("string")).alias("pseudonym"))
    return pseudonymize.sequential_map(t("customer"), "c_name", known)


@query("SELECT c_custkey, sha256(c_nationkey::VARCHAR || '|' || c_mktsegment || 'salt') AS compound_id, c_nationkey, NULL::VARCHAR AS c_mktsegment FROM customer")
def pseudo_compound(t):
    return pseudonymize.compound_pseudonym(t("customer"), ["c_nationkey", "c_mktsegment"], "salt").select("c_custkey", "compound_id", "c_nationkey", "c_mktsegment")


@query("WITH m AS (SELECT DISTINCT c_name, substr(sha256(c_name || 's'), 1, 2) AS pseudonym FROM customer) SELECT pseudonym, count(*) AS originals FROM m GROUP BY pseudonym HAVING count(*) > 1")
def pseudo_collisions(t):
    m = pseudonymize.hashed_map(t("customer"), "c_name", "s", "random").withColumn("pseudonym", F.substring("pseudonym", 1, 2))
    return pseudonymize.collisions(m)


@query("SELECT CAST(bits AS INT) AS bits, round(1 - exp(-(n * (n - 1) / 2.0) / pow(2.0, bits)), 9) AS probability FROM (SELECT count(*) AS n FROM customer), (VALUES (16), (24), (32)) v(bits)")
def pseudo_collision_probability(t):
    df = t("customer")
    n = df.count()
    return df.sparkSession.createDataFrame([(b, round(pseudonymize.collision_probability(n, b), 9)) for b in (16, 24, 32)], "bits int, probability double")


@query("SELECT c_custkey, sha256(c_name || 'n1') AS c_name, sha256(c_mktsegment || 'm2') AS c_mktsegment FROM customer")
def pseudo_salted_fields(t):
    """Salts of each field kept in a sealed table."""
    df, key = t("customer"), b"0123456789abcdef"
    path = scratch(df, "salts.parquet")
    pseudonymize.save_salts(df.sparkSession, {"c_name": "n1", "c_mktsegment": "m2"}, path, key)
    return pseudonymize.salted_pseudonyms(df, pseudonymize.load_salts(df.sparkSession, path, key)).select("c_custkey", "c_name", "c_mktsegment")


_IPAD, _OPAD = (bytes(b ^ x for b in b"secret".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(f"SELECT c_custkey, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(c_name || 'salt')))) AS c_name FROM customer")
def pseudo_peppered(t):
    return pseudonymize.salted_pseudonyms(t("customer"), {"c_name": "salt"}, "secret").select("c_custkey", "c_name")


# ---- synthetic values


def _pick_sql(value: str, salt: str, options) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"([{listed}])[1 + (('0x' || substr(sha256('{salt}:' || {value}), 1, 8))::BIGINT % {len(options)})]"


@query(f"SELECT c_custkey, {_pick_sql('c_name', '42-l', fake.LAST)} || ' ' || CASE WHEN c_nationkey % 2 = 0 THEN {_pick_sql('c_name', '42-f', fake.FIRST_F)} ELSE {_pick_sql('c_name', '42-m', fake.FIRST_M)} END AS c_name FROM customer")
def fake_names(t):
    rows = t("customer").withColumn("sex", F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("male"))
    return fake.fake_name(rows, "c_name", "sex", "last first").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, lower({_pick_sql('c_name', '42-f', fake.FIRST_F + fake.FIRST_M)}) || '.' || lower({_pick_sql('c_name', '42-l', fake.LAST)}) || lpad((('0x' || substr(sha256('42-n:' || c_name), 1, 8))::BIGINT % 100)::VARCHAR, 2, '0') || '@' || {_pick_sql('c_name', '42-d', fake.DOMAINS)} AS email FROM customer")
def fake_emails(t):
    return fake.fake_email(t("customer").withColumn("email", F.col("c_name")), "email", digits=2).select("c_custkey", "email")


@query(f"""WITH p AS (SELECT c_custkey, phone, sha256('42' || phone) AS h FROM ({_PHONES})),
c AS (SELECT *, unnest(range(0, length(phone) - 2)) AS i FROM p)
SELECT c_custkey, '+1' || string_agg(CASE WHEN substr(phone, (i + 3)::INT, 1) BETWEEN '0' AND '9' THEN ((('0x' || substr(h, (i % 60 + 1)::INT, 4))::BIGINT + i // 60) % 10)::VARCHAR ELSE substr(phone, (i + 3)::INT, 1) END, '' ORDER BY i) AS phone FROM c GROUP BY c_custkey""")
def fake_phones(t):
    return fake.fake_phone(_contacts(t), "phone").select("c_custkey", "phone")


@query(f"SELECT s_suppkey, {_pick_sql('s_name', '42-o', fake.ORG_STEMS)} || ' ' || {_pick_sql('s_name', '42-l', fake.LAST)} || ' Group' AS s_name FROM supplier")
def fake_organizations(t):
    return fake.fake_organization(t("supplier"), "s_name").select("s_suppkey", "s_name")


def _name_sql(value: str, seed: str) -> str:
    return " || ".join(_pick_sql(value, f"{seed}-{part}", options) for part, options in (("h", fake._HEADS), ("m", fake._MIDDLES), ("t", fake._TAILS)))


@query(f"SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'kept ' || c_custkey ELSE {_name_sql('c_name', '42-first')} || ' ' || {_name_sql('c_name', '42-last')} END AS _c_name, true AS ok FROM customer")
def fake_generator(t):
    """A generator of many names, with a mapping before it, in a new column, and its own check."""
    g = fake.GENERATORS["name"]
    rows = t("customer")
    mapping = rows.where("c_nationkey = 1").select(F.col("c_name").alias("original"), F.concat(F.lit("kept "), F.col("c_custkey")).alias("pseudonym"))
    out = g.transform(rows, "c_name", "ENRICH", mapping=mapping)
    return out.select("c_custkey", "_c_name", (g.validate(F.col("_c_name")) | F.col("_c_name").startswith("kept ")).alias("ok"))


@query(f"SELECT i AS id, '+1-555-' || lpad((('0x' || substr(sha256('42-a:' || i), 1, 8))::BIGINT % 1000)::VARCHAR, 3, '0') || '-' || lpad((('0x' || substr(sha256('42-b:' || i), 1, 8))::BIGINT % 10000)::VARCHAR, 4, '0') AS value FROM range(0, 200) r(i)")
def fake_generate_phones(t):
    g = fake.GENERATORS["phone"]
    made = g.generate(t("nation").sparkSession, 200)
    return made.sparkSession.range(200).select("id", g.make(F.col("id").cast("string"), "42").alias("value"))


@query("""WITH a AS (SELECT DISTINCT c_mktsegment AS original FROM customer), b AS (SELECT DISTINCT p_name AS pseudonym FROM part WHERE p_name NOT IN (SELECT original FROM a)),
x AS (SELECT original, row_number() OVER (ORDER BY md5('42:' || original), original) AS n FROM a), y AS (SELECT pseudonym, row_number() OVER (ORDER BY md5('42:' || pseudonym), pseudonym) AS n FROM b)
SELECT original, pseudonym FROM x LEFT JOIN y USING (n)""")
def fake_one_to_one(t):
    return fake.one_to_one(t("customer"), "c_mktsegment", t("part").select(F.col("p_name").alias("value")))


@query("SELECT * FROM (VALUES ('a', 'd', 3, false), ('b', 'd', 2, false), ('c', 'd', 1, false), ('x', 'x', 2, true), ('y', 'y', 2, true), ('z', 'w', 1, false)) v(original, pseudonym, steps, cycle)")
def fake_chains(t):
    """Pseudonyms that are originals themselves are followed; cycles are told."""
    m = t("nation").sparkSession.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "w")], "original string, pseudonym string")
    return fake.resolve_chains(m)


@query("WITH o AS (SELECT c_name AS k, 'old' AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_name AS k, 'new' AS v FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(o.k, n.k) AS original, coalesce(n.v, o.v) AS pseudonym FROM o FULL JOIN n ON o.k = n.k")
def fake_merge_maps(t):
    side = lambda k, v: t("customer").where(F.col("c_custkey") % k == 0).select(F.col("c_name").alias("original"), F.lit(v).alias("pseudonym"))
    return fake.merge_maps(side(2, "old"), side(3, "new"), overwrite=True)


@query("SELECT count(*) AS rows, round(avg(CAST(c_nationkey <> 3 AS INT)), 6) AS replaced, count(DISTINCT c_name) AS distinct_before, count(DISTINCT CASE WHEN c_nationkey = 3 THEN c_name ELSE 'x' END) AS distinct_after FROM customer")
def fake_metrics(t):
    rows = t("customer").withColumn("after", F.when(F.col("c_nationkey") == 3, F.col("c_name")).otherwise("x"))
    return fake.generation_metrics(rows, "c_name", "after")


# ---- reshaping


@query("WITH a AS (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS k, count(*) AS y FROM supplier GROUP BY ALL), j AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b USING (k)), s AS (SELECT sum(x * y)::BIGINT AS i, sum(CASE WHEN y = 0 THEN x ELSE 0 END)::BIGINT AS l, sum(CASE WHEN x = 0 THEN y ELSE 0 END)::BIGINT AS r FROM j) SELECT 'inner' AS kind, i AS rows FROM s UNION ALL SELECT 'left', i + l FROM s UNION ALL SELECT 'right', i + r FROM s UNION ALL SELECT 'full', i + l + r FROM s")
def join_type_rows(t):
    return reshape.join_types(t("customer").withColumnRenamed("c_nationkey", "k"), t("supplier").withColumnRenamed("s_nationkey", "k"), "k")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def split_fields(t):
    """Columns split into two tables that share the id, and joined again."""
    parts = reshape.split_fields(t("customer"), "c_custkey", {"who": ["c_name"], "where": ["c_nationkey"]})
    return parts["who"].join(parts["where"], "c_custkey")


@query("WITH s AS (SELECT (o_orderkey::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END) AS x, o_orderkey FROM orders) SELECT o_orderkey, coalesce(try_cast(x AS DOUBLE), -1) AS n FROM s")
def safe_numbers(t):
    rows = t("orders").withColumn("x", F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("")))
    return reshape.to_number(rows, "x", default=-1, output="n").select("o_orderkey", "n")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END, 0) AS c_acctbal, c_custkey % 4 = 0 AS c_acctbal_is_null FROM customer")
def null_handling(t):
    rows = t("customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")))
    return reshape.handle_nulls(reshape.handle_nulls(rows, ["c_acctbal"], "flag"), ["c_acctbal"], "fill", 0).select("c_custkey", "c_acctbal", "c_acctbal_is_null")


@query("SELECT event_id, epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events WHERE user_id < 50 QUALIFY count(*) OVER (PARTITION BY user_id, ts) = 1")
def lag_steps(t):
    """Seconds since the user's event before, where times tell events apart."""
    from pyspark.sql import Window

    rows = t("events").where("user_id < 50")
    out = reshape.lag_difference(rows, "ts", ["user_id"])
    return out.withColumn("n", F.count("*").over(Window.partitionBy("user_id", "ts"))).where("n = 1").select("event_id", "step")


@query("WITH s AS (SELECT l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM lineitem), c AS (SELECT s::DOUBLE AS s, count(*) AS n FROM s WHERE s IS NOT NULL GROUP BY ALL) SELECT arg_max(s, n * 1000 - s)::DOUBLE AS \"interval\", round(max(n) / sum(n), 6) AS share FROM c")
def sampling_interval(t):
    return reshape.sampling_interval(t("lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("double")), "l_linenumber", ["l_orderkey"])


@query("SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS c_mktsegment_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS INT) AS c_mktsegment_MACHINERY FROM customer")
def one_hot(t):
    return reshape.one_hot(t("customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_MACHINERY")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def top_per_key(t):
    return reshape.top_per_key(t("orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE date_trunc('day', o_orderdate) END AS d FROM orders")
def parse_dates(t):
    """Three ways to write a day; the first format that fits reads it."""
    d = F.col("o_orderdate")
    x = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "MM/dd/yyyy")).otherwise("no date")
    return reshape.parse_dates(t("orders").withColumn("d", x), "d").select("o_orderkey", F.col("d").cast("timestamp_ntz").alias("d"))


@query("SELECT count(*) AS rows_before, 0 AS nulls_before, 5 AS columns_before, count_if(c_nationkey > 4) AS rows_after, count_if(c_nationkey > 4 AND c_acctbal < 0) AS nulls_after, 5 AS columns_after, count_if(c_nationkey > 4) - count(*) AS rows_delta, count_if(c_nationkey > 4 AND c_acctbal < 0) AS nulls_delta FROM customer")
def compare_datasets(t):
    after = t("customer").where("c_nationkey > 4").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return reshape.compare_datasets(t("customer").select(*after.columns), after)


@query("SELECT c_custkey, c_name FROM customer")
def remove_fields(t):
    return reshape.remove_fields(t("customer"), ["c_nationkey", "c_acctbal", "c_mktsegment"])


@query("SELECT o_orderkey, CASE WHEN o_orderpriority SIMILAR TO '[1-3]-.*' THEN o_orderpriority ELSE 'bad' END AS o_orderpriority, CASE WHEN o_totalprice < 1000 OR o_totalprice > 300000 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' OR o_orderdate > TIMESTAMP '1997-01-01' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders")
def clean_patterns_dates(t):
    rows = reshape.clean_invalid(t("orders"), {"o_orderpriority": {"pattern": "^[1-3]-.*$"}}, "fill", {"o_orderpriority": "bad"})
    rows = reshape.clean_invalid(rows, {"o_totalprice": {"range": (1000, 300000)}, "o_orderdate": {"min_date": datetime(1994, 1, 1), "max_date": datetime(1997, 1, 1)}})
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND length(c_name) BETWEEN 1 AND 30 THEN c_mktsegment END AS c_mktsegment FROM customer")
def clean_whitelist(t):
    """Allowed values come from a table that was read from a file."""
    df = t("customer")
    path = scratch(df, "allowed.txt")
    df.sparkSession.createDataFrame([("BUILDING",), ("MACHINERY",)], "value string").write.text(path)
    allowed = [r["value"] for r in df.sparkSession.read.text(path).collect()]
    return reshape.clean_invalid(df, {"c_mktsegment": {"allowed": allowed, "min_length": 1, "max_length": 30}}).select("c_custkey", "c_mktsegment")


@query("SELECT e.event_id, CASE WHEN event_id % 4 > 0 THEN value ELSE coalesce(min(CASE WHEN event_id % 4 > 0 THEN value END) OVER (), 0) END AS value FROM events e")
def impute_min(t):
    rows = t("events").withColumn("value", F.when(F.col("event_id") % 4 > 0, F.col("value")))
    return reshape.impute(rows, "value", "min").select("event_id", "value")


@query("SELECT event_id, first_value(CASE WHEN event_id % 4 > 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events")
def impute_bfill(t):
    rows = t("events").withColumn("value", F.when(F.col("event_id") % 4 > 0, F.col("value")))
    return reshape.impute(rows, "value", "bfill", order=["event_id"], by=["user_id"]).select("event_id", "value")


# ---- privacy models and risk


@query("WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS size FROM customer GROUP BY ALL) SELECT *, CAST(CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 5 THEN 8 ELSE 5 END AS INT) AS asked, size >= CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 5 THEN 8 ELSE 5 END AS ok FROM g")
def kanon_adaptive(t):
    own = t("nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"), F.lit(8).alias("k"))
    return models.adaptive_k(t("customer"), CQI, 5, own)


@query(f"WITH c AS (SELECT l_returnflag, l_linestatus, ship_year, qty_bin, count(*) AS n FROM {_LINES} GROUP BY ALL) SELECT l_returnflag, l_linestatus, ship_year, sum(n)::BIGINT AS size, count(*) AS distinct_l, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY ALL HAVING count(*) < 6")
def ldiv_high_risk(t):
    return models.high_risk_groups(lines(t), QI, "qty_bin", 6)


@query(f"""WITH k AS (SELECT *, count(DISTINCT qty_bin) OVER (PARTITION BY l_returnflag, l_linestatus, ship_year) AS d FROM {_LINES})
SELECT l_orderkey, l_linenumber, CASE WHEN d < 6 THEN substr(qty_bin::VARCHAR, 1, 1) || '***' ELSE qty_bin::VARCHAR END AS qty_bin FROM k""")
def ldiv_partial_mask(t):
    return models.l_mask(lines(t), QI, "qty_bin", 6, partial=True).select("l_orderkey", "l_linenumber", "qty_bin")


@query(f"""WITH c AS (SELECT l_returnflag, l_linestatus, ship_year, qty_bin, count(*) AS n FROM {_LINES} GROUP BY ALL), w AS (SELECT qty_bin, sum(n) AS a FROM c GROUP BY ALL),
g AS (SELECT c.*, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus, ship_year) AS s, count(*) OVER (PARTITION BY l_returnflag, l_linestatus, ship_year) AS l, a, (SELECT sum(n) FROM c) AS t FROM c JOIN w USING (qty_bin)),
r AS (SELECT l_returnflag, l_linestatus, ship_year, max(l) AS l, max(abs(n / s - a / t)) AS away FROM g GROUP BY ALL)
SELECT count(*) AS groups, round(100 * avg(CAST(l < 2 AS INT)), 4) AS below_l2, round(100 * avg(CAST(l < 6 AS INT)), 4) AS below_l6, round(100 * avg(CAST(away > 0.05 AS INT)), 4) AS beyond_t FROM r""")
def uniqueness_lt(t):
    return metrics.uniqueness_lt(lines(t), QI, "qty_bin", (2, 6), 0.05)


@query("""WITH r AS (SELECT c_custkey, 100.0 / count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS risk FROM customer)
SELECT c_custkey, CASE WHEN risk >= 50 THEN 'critical' WHEN risk >= 20 THEN 'high' WHEN risk >= 9 THEN 'moderate' ELSE 'low' END AS level,
CASE WHEN risk >= 50 THEN 'suppress or generalize the quasi-identifiers further' WHEN risk >= 20 THEN 'raise k and suppress small groups' WHEN risk >= 9 THEN 'generalize the rarest values' ELSE 'release under the usual conditions' END AS advice FROM r""")
def risk_interpretation(t):
    rows = models.enrich_k(t("customer"), CQI, "k").withColumn("risk", 100.0 / F.col("k"))
    return metrics.interpret(rows, "risk").select("c_custkey", "level", "advice")


@query("WITH r AS (SELECT o_totalprice AS s, CAST(o_orderpriority < '3' AS INT) AS y FROM orders), k AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM r) SELECT round((sum(k) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (count_if(y = 1) * count_if(y = 0)), 6) AS auc FROM k")
def attack_auc(t):
    return metrics.auc(t("orders").withColumn("y", (F.col("o_orderpriority") < "3").cast("int")), "o_totalprice", "y")


@query("WITH p AS (SELECT p_partkey, unnest(['p_brand:' || p_brand, 'p_size:' || p_size]) AS token FROM part), d AS (SELECT token, ln((1 + (SELECT count(*) FROM part)) / (1.0 + count(DISTINCT p_partkey))) + 1 AS idf FROM p GROUP BY token), w AS (SELECT p_partkey, token, idf FROM p JOIN d USING (token)), n AS (SELECT *, sqrt(sum(idf * idf) OVER (PARTITION BY p_partkey)) AS s FROM w) SELECT p_partkey, token, round(idf / s, 6) AS weight FROM n")
def attack_features(t):
    return text.tf_idf(t("part"), "p_partkey", ["p_brand", "p_size"])


# ---- fidelity, utility, quality

_KS = """d AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT x AS v, 1 AS a, 0 AS b FROM l UNION ALL SELECT x, 0, 1 FROM r) GROUP BY v), c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS ca, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM d),
g AS (SELECT max(abs(ca - cb)) AS d, max(na) AS na, max(nb) AS nb FROM c), z AS (SELECT d, d * sqrt(na * nb / (na + nb)) AS x FROM g)
SELECT round(d, 6) AS statistic, round(CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 21), lambda k: pow(-1, k - 1) * exp(-2 * k * k * x * x))))) END, 6) AS p_value FROM z"""


@query("WITH l AS (SELECT (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS x FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS x FROM lineitem WHERE l_returnflag <> 'R'), " + _KS)
def ks_zscore(t):
    """Two columns on scales of their own."""
    return metrics.ks(t("lineitem").where("l_returnflag = 'R'"), t("lineitem").where("l_returnflag <> 'R'"), "l_extendedprice", "l_quantity", "zscore")


@query("""WITH a AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer WHERE c_acctbal > 0 GROUP BY ALL), b AS (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY ALL),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b FROM a FULL JOIN b ON a.k = b.k), c AS (SELECT sum(a) OVER (ORDER BY k) / sum(a) OVER () AS ca, sum(b) OVER (ORDER BY k) / sum(b) OVER () AS cb FROM j),
g AS (SELECT max(abs(ca - cb)) AS d, (SELECT count_if(a <> 0) FROM j)::DOUBLE AS na, (SELECT count_if(b <> 0) FROM j)::DOUBLE AS nb FROM c), z AS (SELECT *, d * sqrt(na * nb / (na + nb)) AS x FROM g)
SELECT round(d, 6) AS statistic, round(CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 21), lambda k: pow(-1, k - 1) * exp(-2 * k * k * x * x))))) END, 6) AS p_value, round(d / (1.358 * sqrt((na + nb) / (na * nb))), 6) AS effect FROM z""")
def ks_keyed(t):
    a = t("customer").where("c_acctbal > 0").selectExpr("c_nationkey AS k", "c_acctbal AS v")
    return metrics.ks_keyed(a, t("supplier").where("s_acctbal > 0").selectExpr("s_nationkey AS k", "s_acctbal AS v"), ["k"], "v")


@query("SELECT 'l_extendedprice' AS field, round(corr(l_extendedprice, round(l_extendedprice, -3)), 6) AS r, round(avg(abs(l_extendedprice - round(l_extendedprice, -3))), 6) AS mae FROM lineitem UNION ALL SELECT 'l_quantity', round(corr(l_quantity, floor(l_quantity / 10)), 6), round(avg(abs(l_quantity - floor(l_quantity / 10))), 6) FROM lineitem")
def pearson_columns(t):
    rows = t("lineitem").withColumn("p", F.round("l_extendedprice", -3)).withColumn("q", F.floor(F.col("l_quantity") / 10))
    return metrics.pearson_columns(rows, [("l_extendedprice", "p"), ("l_quantity", "q")])


@query("WITH c AS (SELECT count(DISTINCT l_quantity) AS a, count(DISTINCT floor(l_quantity / 10)) AS b, count(DISTINCT l_linenumber) AS x, count(DISTINCT l_linenumber // 2) AS y FROM lineitem) SELECT 'l_quantity' AS field, a AS distinct_before, b AS distinct_after, round((a - b) / (a - 1), 6) AS loss FROM c UNION ALL SELECT 'l_linenumber', x, y, round((x - y) / (x - 1), 6) FROM c")
def generalization_loss(t):
    after = t("lineitem").withColumn("l_quantity", F.floor(F.col("l_quantity") / 10)).withColumn("l_linenumber", F.floor(F.col("l_linenumber") / 2))
    return metrics.generalization_loss(t("lineitem"), after, ["l_quantity", "l_linenumber"])


@query(f"""WITH g AS (SELECT l_returnflag, l_linestatus, qty_bin, count(*) AS n FROM {_LINES} WHERE l_linenumber > 2 GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus) AS size FROM g),
w AS (SELECT qty_bin, count(*) / (SELECT count(*) FROM lineitem) AS q FROM {_LINES} GROUP BY ALL) SELECT round(sum(n * ln((n / size) / greatest(q, 1e-10))) / sum(n), 6) AS kl FROM s JOIN w USING (qty_bin)""")
def ldiversity_kl(t):
    rows = lines(t)
    return metrics.l_diversity_kl(rows, rows.where("l_linenumber > 2"), ["l_returnflag", "l_linestatus"], "qty_bin")


@query("""WITH f AS (SELECT count(o_totalprice) / count(*) AS c1, count_if(o_totalprice > 5000) / count(o_totalprice) AS v1, count(DISTINCT o_totalprice) / count(o_totalprice) AS d1, count(DISTINCT o_orderpriority) / count(o_orderpriority) AS d2,
round(100 * avg(CAST(o_totalprice > 5000 AS INT)), 4) AS consistency, round(100.0 * count(DISTINCT o_custkey) / count(*), 4) AS uniqueness FROM orders)
SELECT round((round(100 * (0.5 * c1 + 0.3 * v1 + 0.2 * d1), 4) + round(100 * (0.5 + 0.3 + 0.2 * d2), 4)) / 2, 4) AS mean_score, consistency, uniqueness FROM f""")
def dataset_quality(t):
    return metrics.dataset_quality(t("orders"), ["o_totalprice", "o_orderpriority"], ["o_custkey"], {"o_totalprice": F.col("o_totalprice") > 5000})


@query("SELECT * FROM (VALUES ('event_id', 'numeric'), ('ts', 'date'), ('user_id', 'numeric'), ('event_type', 'text'), ('value', 'numeric'), ('props', 'text')) v(field, kind)")
def schema_kinds(t):
    return metrics.field_types(t("events").select("event_id", "ts", "user_id", "event_type", "value", "props"))


@query("SELECT round(0.5 * (1 - 1 / 4.0) + 0.5 * 0.8, 6) AS effectiveness, round((3 * 0.9 + 0.5) / 4, 6) AS composite")
def composite_scores(t):
    spark = t("nation").sparkSession
    return spark.createDataFrame([(round(metrics.effectiveness(40.0, 10.0, 0.8), 6), round(metrics.composite({"a": (0.9, 3.0), "b": (0.5, 1.0)}), 6))], "effectiveness double, composite double")


@query("SELECT 'generalization_loss' AS metric, 'l_quantity' AS field, count(DISTINCT l_quantity) AS distinct_before, count(DISTINCT floor(l_quantity / 10)) AS distinct_after, round((count(DISTINCT l_quantity) - count(DISTINCT floor(l_quantity / 10))) / (count(DISTINCT l_quantity) - 1), 6) AS loss FROM lineitem")
def op_utility_metric(t):
    return registry.utility(t("lineitem"), t("lineitem").withColumn("l_quantity", F.floor(F.col("l_quantity") / 10)), "generalization_loss", ["l_quantity"])


@query("WITH l AS (SELECT l_quantity AS x FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT l_quantity AS x FROM lineitem WHERE l_returnflag <> 'R'), q AS (" + "WITH " + _KS + ") SELECT 'ks' AS metric, q.* FROM q")
def op_fidelity_metric(t):
    return registry.fidelity(t("lineitem").where("l_returnflag = 'R'"), t("lineitem").where("l_returnflag <> 'R'"), "ks", "l_quantity")


@query("WITH g AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT 'uniqueness' AS metric, round(100 * count_if(k = 1) / sum(k), 4) AS identity_rate, round(100 * avg(CAST(k < 2 AS INT)), 4) AS below_2, round(100 * avg(CAST(k < 5 AS INT)), 4) AS below_5, round(100 * avg(CAST(k < 10 AS INT)), 4) AS below_10 FROM g")
def op_privacy_metric(t):
    return registry.privacy(t("customer"), t("customer"), "uniqueness", CQI)


# ---- profiles


@query("""SELECT * FROM (VALUES ('c_custkey', 'categorical'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical'), ('c_name', 'text'), ('flag', 'boolean'), ('tags', 'mvf'), ('half', 'categorical'), ('long', 'long_text')) v(field, kind)""")
def prof_types(t):
    rows = t("customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_name", (F.col("c_acctbal") > 0).alias("flag"), F.lit("['A', 'B']").alias("tags"), (F.col("c_nationkey") % 2 / 2).alias("half"), F.repeat("c_name", 20).alias("long"))
    return profile.infer_types(rows)


def _entropy_sql(f: str, t: str) -> str:
    return f"SELECT '{f}' AS field, sum(c)::BIGINT AS n, count(*) AS distinct_values, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)), 6) AS normalized, round(count(*) / sum(c), 6) AS uniqueness FROM (SELECT {f}, count(*)::DOUBLE AS c FROM {t} GROUP BY ALL)"


@query(" UNION ALL ".join(_entropy_sql(f, "customer") for f in ("c_nationkey", "c_mktsegment", "c_name")))
def prof_entropy(t):
    return profile.entropy_profile(t("customer"), ["c_nationkey", "c_mktsegment", "c_name"])


@query(f"""WITH e AS ({" UNION ALL ".join(_entropy_sql(f, "customer") for f in ("c_nationkey", "c_mktsegment", "c_name", "c_custkey"))}), s AS (SELECT field, CASE WHEN uniqueness > 0.9 THEN 'INDIRECT' WHEN uniqueness > 0.2 OR entropy > 4 THEN 'QUASI' ELSE 'NON_SENSITIVE' END AS by_statistics,
CASE field WHEN 'c_nationkey' THEN 'INDIRECT' WHEN 'c_mktsegment' THEN 'QUASI' WHEN 'c_name' THEN 'DIRECT' ELSE 'INDIRECT' END AS by_name, CASE field WHEN 'c_name' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS name_confidence FROM e) SELECT field, by_name, name_confidence, by_statistics, by_name AS role FROM s""")
def prof_roles(t):
    return profile.resolve_roles(t("customer"), ["c_nationkey", "c_mktsegment", "c_name", "c_custkey"])


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, median(l_extendedprice) AS d FROM lineitem), a AS (SELECT median(abs(l_extendedprice - d)) AS a FROM lineitem, s)
SELECT 'l_extendedprice' AS field, count_if(abs(l_extendedprice - m) / s > 2) AS z_outliers, count_if(0.6745 * abs(l_extendedprice - d) / (1.4826 * a) > 1) AS modified_z_outliers FROM lineitem, s, a""")
def prof_z_outliers(t):
    return profile.outlier_counts(t("lineitem"), ["l_extendedprice"], 2.0, 1.0)


@query(""" WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem), c AS (SELECT count(*) AS n, avg(pow(l_quantity - m, 2)) AS m2, avg(pow(l_quantity - m, 3)) AS m3, avg(pow(l_quantity - m, 4)) AS m4 FROM lineitem, m),
k AS (SELECT n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM c), j AS (SELECT *, n / 6.0 * (s * s + k * k / 4) AS jb FROM k)
SELECT 'l_quantity' AS field, n, round(s, 6) AS skewness, round(k, 6) AS kurtosis, round(jb, 4) AS statistic, round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS normal FROM j""")
def prof_normality(t):
    return profile.normality(t("lineitem"), ["l_quantity"])


@query("WITH r AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(a, b), 6) AS r, count(*) AS n, round(corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))), 4) AS t FROM r HAVING abs(corr(a, b)) >= 0.5 UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6), count(*), round(corr(l_quantity, l_discount) * sqrt((count(*) - 2) / (1 - pow(corr(l_quantity, l_discount), 2))), 4) FROM lineitem HAVING abs(corr(l_quantity, l_discount)) >= 0.5 UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6), count(*), round(corr(l_extendedprice, l_discount) * sqrt((count(*) - 2) / (1 - pow(corr(l_extendedprice, l_discount), 2))), 4) FROM lineitem HAVING abs(corr(l_extendedprice, l_discount)) >= 0.5")
def prof_significant_pairs(t):
    return profile.significant_pairs(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 0.5)


@query("SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END, p_retailprice), 6) AS r, count(*) AS n, round(corr(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END, p_retailprice) * sqrt((count(*) - 2) / (1 - pow(corr(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END, p_retailprice), 2))), 4) AS t FROM part")
def prof_pairs_filled(t):
    """Nulls filled before correlating."""
    rows = t("part").withColumn("p_size", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")))
    return profile.significant_pairs(rows, ["p_size", "p_retailprice"], 0.0, "fill")


@query("SELECT round(corr(CAST(l_returnflag = 'R' AS DOUBLE), l_quantity), 6) AS r FROM lineitem")
def prof_point_biserial(t):
    return profile.point_biserial(t("lineitem"), F.col("l_returnflag") == "R", "l_quantity")


@query("WITH g AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT k, count(*) AS groups, sum(k)::BIGINT AS records FROM g GROUP BY k")
def prof_k_histogram(t):
    return profile.k_histogram(t("customer"), CQI)


@query("WITH g AS (SELECT o_custkey, count(DISTINCT o_orderdate::DATE) AS d, max(o_orderdate::DATE) - min(o_orderdate::DATE) AS span FROM orders GROUP BY ALL) SELECT count(*) AS groups, count_if(d > 1) AS changing, max(span)::INT AS longest FROM g")
def prof_date_changes(t):
    return profile.date_changes(t("orders"), "o_custkey", "o_orderdate")


@query("SELECT o_orderkey, CASE WHEN o_orderdate::DATE <= DATE '2000-06-15' THEN datesub('year', o_orderdate::DATE, DATE '2000-06-15')::INT END AS age FROM orders")
def prof_ages(t):
    return profile.ages(t("orders"), "o_orderdate", "2000-06-15").select("o_orderkey", "age")


@query(f"SELECT '1' AS country, substr(phone, 5, 3) AS area, count(*) AS n FROM ({_PHONES}) GROUP BY ALL")
def prof_phone_dictionary(t):
    return profile.phone_dictionary(_contacts(t), "phone")


_TAGS = "(SELECT *, CASE WHEN p_size % 7 = 0 THEN NULL ELSE list_distinct([p_brand, p_type, CASE WHEN p_size > 25 THEN p_brand ELSE 'SMALL' END]) END AS tags FROM part)"


def _tags(t):
    return t("part").withColumn("tags", F.when(F.col("p_size") % 7 != 0, F.array("p_brand", "p_type", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("SMALL"))))


@query(f"SELECT array_to_string(list_sort(tags), ' | ') AS combination, len(tags)::INT AS size, count(*) AS n FROM {_TAGS} WHERE tags IS NOT NULL GROUP BY ALL")
def prof_mvf_combinations(t):
    return profile.mvf_combinations(_tags(t), F.col("tags"))


@query(f"SELECT CASE WHEN tags IS NULL THEN 0 ELSE 3 END AS size, count(*) AS n FROM {_TAGS} GROUP BY ALL")
def prof_mvf_sizes(t):
    return profile.mvf_sizes(_tags(t), F.col("tags"))


@query("WITH g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY ALL), v AS (SELECT n, CASE WHEN n > 1 THEN (a - 1) / (n - 1) ELSE 0 END AS a, CASE WHEN n > 1 THEN (b - 1) / (n - 1) ELSE 0 END AS b FROM g) SELECT 'o_orderstatus' AS field, round(avg(a), 6) AS variation, round(sum(a * n) / sum(n), 6) AS weighted FROM v UNION ALL SELECT 'o_orderpriority', round(avg(b), 6), round(sum(b * n) / sum(n), 6) FROM v")
def prof_group_variation(t):
    return profile.group_variation(t("orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("WITH s AS (SELECT o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w AS c, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT 'o_orderstatus' AS field, count(*) AS steps, round(avg(CAST(c AS INT)), 6) AS changing FROM s WHERE r > 1")
def prof_change_frequency(t):
    return profile.change_frequency(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"])


@query("WITH g AS (SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS g FROM orders GROUP BY ALL) SELECT count(*) AS combinations, count_if(g > 1) AS shared, max(g) AS most_groups FROM g")
def prof_cross_groups(t):
    return profile.cross_groups(t("orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("WITH g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS groups, count_if(d = 1) AS collapsible, coalesce(sum(CASE WHEN d = 1 THEN n - 1 END), 0)::BIGINT AS rows_saved FROM g")
def prof_collapsibility(t):
    return profile.collapsibility(t("orders"), "o_custkey", ["o_orderstatus"])


@query("WITH g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY ALL HAVING count(*) > 1) SELECT 'o_orderstatus' AS field, count(*) AS keys, round(avg(CAST(d <= 1 AS INT)), 6) AS consistent FROM g")
def prof_identity_consistency(t):
    return profile.identity_consistency(t("orders"), "o_custkey", ["o_orderstatus"])


@query("SELECT 'o_orderkey' AS field, 'bigint' AS type, count(o_orderkey) AS n, 0.0::DOUBLE AS null_pct, count(DISTINCT o_orderkey) AS distinct_values, min(o_orderkey)::VARCHAR AS least, max(o_orderkey)::VARCHAR AS greatest FROM orders UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority), 0.0, count(DISTINCT o_orderpriority), min(o_orderpriority), max(o_orderpriority) FROM orders")
def field_level(t):
    return profile.field_level(t("orders"), ["o_orderkey", "o_orderpriority"])


# ---- text


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS basic, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N} \t\n\x0B\f\r]+', ' ', 'g'), '\p{N}+', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS aggressive FROM documents")
def text_levels(t):
    return t("documents").select("doc_id", text.normalize_text(F.col("text")).alias("basic"), text.normalize_text(F.col("text"), "aggressive").alias("aggressive"))


@query("SELECT a.n_name AS a, b.n_name AS b, round(CASE WHEN contains(lower(a.n_name), lower(b.n_name)) OR contains(lower(b.n_name), lower(a.n_name)) THEN 1.0 ELSE 1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)) END, 6) AS partial, round(CASE WHEN a.n_name = b.n_name THEN 1.0 ELSE len(list_intersect(string_split(lower(a.n_name), ' '), string_split(lower(b.n_name), ' '))) / len(list_distinct(list_concat(string_split(lower(a.n_name), ' '), string_split(lower(b.n_name), ' ')))) END, 6) AS tokens FROM nation a, nation b WHERE regexp_matches(a.n_name || b.n_name, '^[A-Za-z ]+$') AND a.n_regionkey = b.n_regionkey")
def text_similarities(t):
    a, b = (t("nation").select(F.col("n_name").alias(k), "n_regionkey") for k in "ab")
    pairs = a.join(b, "n_regionkey").where(F.concat("a", "b").rlike("^[A-Za-z ]+$"))
    return pairs.select("a", "b", F.round(text.partial_similarity(F.col("a"), F.col("b")), 6).alias("partial"), F.round(text.token_similarity(F.col("a"), F.col("b")), 6).alias("tokens"))


@query("SELECT n_name, array_to_string(list_sort(list_distinct([substr(lower(n_name), i::INT, 3) FOR i IN range(1, greatest(length(n_name) - 2, 1) + 1)])), '|') AS shingles FROM nation")
def text_shingles(t):
    return t("nation").select("n_name", F.array_join(F.array_sort(text.character_shingles(F.col("n_name"))), "|").alias("shingles"))


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents), s AS (SELECT doc_id, w, CAST(len(w) // 50 AS INT) AS n FROM w) SELECT doc_id, coalesce(n, 0) AS segments, CASE WHEN n > 0 THEN round(list_avg(list_transform(range(0, n), lambda k: len(list_distinct(w[k * 50 + 1 : k * 50 + 50])) / 50)), 6) END AS msttr FROM s")
def text_msttr(t):
    return text.msttr(t("documents"), "doc_id", "text")


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for k in ("en", "fr") for w in text.STOP_WORDS[k]) + ")) AS w FROM documents) SELECT doc_id, len(w)::INT AS n FROM w")
def text_stop_words(t):
    return t("documents").select("doc_id", F.size(text.without_stop_words(F.col("text"), ("en", "fr"))).alias("n"))


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ('good', 'new'))) AS INT) AS p, CAST(len(list_filter(w, lambda x: x IN ('bad', 'old'))) AS INT) AS n FROM w) SELECT doc_id, p AS positive, n AS negative, round(coalesce((p - n) / nullif(p + n, 0), 0), 6) AS score FROM c")
def text_sentiment(t):
    return text.sentiment(t("documents").where("text is not null"), "doc_id", "text", ("good", "new"), ("bad", "old"))


@query("""WITH v AS (SELECT DISTINCT p_type AS value FROM part UNION SELECT 'mail a@b.org' UNION SELECT 'nothing'), e(keyword, category, level) AS (VALUES ('eco', 'economy', 1), ('steel', 'metal', 2), ('an', 'other', 0)),
h AS (SELECT value, category FROM v JOIN e ON contains(lower(value), keyword) QUALIFY row_number() OVER (PARTITION BY value ORDER BY level DESC, length(keyword) DESC, keyword DESC) = 1)
SELECT value, coalesce(category, CASE WHEN value = 'mail a@b.org' THEN 'email' ELSE 'unresolved' END) AS category, CASE WHEN category IS NOT NULL THEN 'dictionary' WHEN value = 'mail a@b.org' THEN 'pattern' ELSE 'none' END AS how FROM v LEFT JOIN h USING (value)""")
def text_categories(t):
    spark = t("part").sparkSession
    values = t("part").select(F.col("p_type").alias("v")).unionByName(spark.createDataFrame([("mail a@b.org",), ("nothing",)], "v string"))
    return text.categorize_texts(values, "v", spark.createDataFrame([("eco", "economy", 1), ("steel", "metal", 2), ("an", "other", 0)], "keyword string, category string, level int"))


@query("SELECT c_custkey, '~' || c_name AS c_name FROM customer WHERE c_custkey % 2 = 1")
def text_markers(t):
    """Only rows without the marker are worked on, and carry it afterwards."""
    rows = t("customer").withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, text.mark_processed(F.col("c_name"))).otherwise(F.col("c_name")))
    return text.unprocessed(rows, "c_name").select("c_custkey", text.mark_processed(F.col("c_name")).alias("c_name"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: CASE WHEN w = 'states' THEN 'state' ELSE w END), ' ') AS lemmas FROM nation WHERE regexp_matches(n_name, '^[A-Za-z ]+$')")
def text_lemmas(t):
    lemmas = t("nation").sparkSession.createDataFrame([("states", "state")], "word string, lemma string")
    return text.lemmatize(t("nation").where(F.col("n_name").rlike("^[A-Za-z ]+$")), "n_nationkey", "n_name", lemmas).select("n_nationkey", F.array_join("lemmas", " ").alias("lemmas"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N} \t\n\x0B\f\r]+', '|', 'g'), '[ \t\n\x0B\f\r]+', '  ', 'g') AS x FROM documents), m AS (SELECT doc_id, regexp_replace(x, '(^|[ |])(""" + "|".join(sorted(text.STOP_WORDS["en"])) + r""")([ |])', '\1|\3', 'g') AS x FROM s),
p AS (SELECT doc_id, unnest(string_split(x, '|')) AS p FROM m), q AS (SELECT doc_id, trim(regexp_replace(p, ' +', ' ', 'g')) AS phrase FROM p) SELECT doc_id, phrase, len(string_split(phrase, ' '))::INT AS words, count(*) AS n FROM q WHERE phrase <> '' AND len(string_split(phrase, ' ')) BETWEEN 2 AND 4 AND regexp_matches(phrase, '^[a-z ]+$') GROUP BY ALL HAVING NOT regexp_matches(' ' || phrase || ' ', ' (""" + "|".join(sorted(text.STOP_WORDS["en"])) + r""") ')""")
def text_key_phrases(t):
    out = text.key_phrases(t("documents"), "doc_id", "text")
    return out.where(F.col("phrase").rlike("^[a-z ]+$") & ~F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")).rlike(f" ({'|'.join(sorted(text.STOP_WORDS['en']))}) "))


_LISTED = " ".join(f"WHEN w[i] IN ({', '.join(repr(w) for w in ws)}) THEN '{k}'" for k, ws in sorted(text.ENTITY_WORDS.items()))


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents), e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), k AS (SELECT doc_id, w[i] AS word, CASE " + _LISTED + " END AS kind, CASE WHEN i > 1 THEN w[i - 1] || ' ' ELSE '' END || w[i] AS phrase FROM e) SELECT doc_id, kind, word, phrase, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL")
def text_named_entities(t):
    return text.named_entities(t("documents"), "doc_id", "text")


@query(_CUSTOMER)
def io_chunks(t):
    """A table in chunks, each worked on by itself, put together again."""
    return readers.stack([c.withColumn("c_name", F.col("c_name")) for c in readers.chunks(t("customer"), 5, "c_custkey")])


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal > 0 AS rich, round_even(c_acctbal / 100, 0) * 100 AS bal FROM customer), v AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)),
d AS (SELECT DISTINCT code::DOUBLE AS x, rich::INT::DOUBLE AS y, bal AS z FROM r JOIN v USING (c_mktsegment)), w AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(z) AS sz FROM (SELECT code::DOUBLE AS x, rich::INT::DOUBLE AS y, bal AS z FROM r JOIN v USING (c_mktsegment))),
q AS (SELECT c_custkey, code, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS rich, c_acctbal FROM customer JOIN v USING (c_mktsegment))
SELECT c_custkey, round(min(sqrt(pow((code - x) / sx, 2) + pow((rich - y) / sy, 2) + pow((c_acctbal - z) / sz, 2))), 6) AS dcr FROM q, d, w GROUP BY c_custkey""")
def dcr_mixed(t):
    """Distance to the closest released record over a text, a boolean and a number."""
    rows = t("customer").withColumn("rich", F.col("c_acctbal") > 0)
    a, b = attacks.encode_features(rows, generalize.round_numbers(rows, "c_acctbal", -2), ["c_mktsegment", "rich", "c_acctbal"])
    return attacks.dcr(a, b, "c_custkey", ["c_mktsegment", "rich", "c_acctbal"])
