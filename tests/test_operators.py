import hashlib
import hmac
import pathlib
import time
from datetime import datetime

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from cloakframe.operators import attacks, conditions, fake, generalize, mask, models, noise, profile, pseudonymize, reshape, suppress, text
from cloakframe.plans import catalog
from cloakframe.sources import readers
from cloakframe.streaming.windows import windowed_group_sizes


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_conditions_and_nulls(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert rows(df.where(conditions.condition("x", "ne", [1]))) == [(5,), (None,)]
    assert rows(df.where(conditions.condition("x", "not_in", [1, 5]))) == [(None,)]
    assert rows(df.where(conditions.condition("x", "range", [1, 5]))) == [(1,), (5,)]
    with pytest.raises(ValueError):
        conditions.condition("x", "eq", [])
    key = conditions.composite_key(["a", "b"], nulls="skip")
    two = spark.createDataFrame([("p", None), ("p", "q")], "a string, b string")
    assert rows(two.select(key)) == [(None,), ("p_q",)]
    opened = two.select(conditions.open_reversible_key("k", "a string, b string")) if "k" in two.columns else two.withColumn("k", conditions.reversible_key(["a", "b"])).select(conditions.open_reversible_key("k", "a string, b string").alias("o")).select("o.a", "o.b")
    assert rows(opened) == [("p", None), ("p", "q")]


def test_bins_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert [r[0] for r in rows(generalize.equal_width(df, "x", 2))] == ["0-5", "0-5", "5-10", None]
    same = spark.createDataFrame([(3,), (3,), (None,)], "x int")
    assert [r[0] for r in rows(generalize.equal_width(same, "x", 4))] == ["3-3", "3-3", None]
    assert rows(generalize.round_numbers(spark.createDataFrame([(2.5,), (3.5,)], "x double"), "x")) == [(2.0,), (4.0,)]
    empty = spark.createDataFrame([], "x double")
    assert generalize.equal_width(empty, "x").count() == 0
    assert generalize.equal_frequency(empty, "x").count() == 0


def test_rare_numbered_and_hierarchy(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",), ("c",), (None,)], "x string")
    got = sorted(str(r[0]) for r in rows(generalize.group_rare(df, "x", 3, "numbered", "R")))
    assert got == sorted(["a"] * 5 + ["R000", "R000", "None"])
    tree = spark.createDataFrame([("Berlin", "DE"), ("Paris", "FR")], "value string, land string")
    near = generalize.hierarchy(spark.createDataFrame([("berlin ",), ("Pariss",), ("Rome",), (None,)], "x string"), "x", tree, "land", similar=0.8)
    assert sorted(str(r[0]) for r in rows(near)) == ["DE", "FR", "None", "OTHER"]


def test_masks(spark):
    df = spark.createDataFrame([("123-45-6789", "4111 1111 1111 1234", "10.1.2.3", "ab@x.org", "(555) 123-4567")], "ssn string, card string, ip string, mail string, phone string")
    assert rows(mask.mask_pattern(df, "ssn", "ssn"), "ssn") == [("***-**-6789",)]
    assert rows(mask.mask_card(df, "card"), "card") == [("**** **** **** 1234",)]
    assert rows(mask.mask_ip(df, "ip", "subnet"), "ip") == [("10.1.*.*",)]
    assert rows(mask.mask_email(df, "mail", "partial_domain"), "mail") == [("a*@x.***",)]
    assert rows(mask.mask_phone(df, "phone"), "phone") == [("(***) ***-4567",)]
    assert rows(mask.mask_by_format(df, "ssn"), "ssn") == [("***-**-****",)]
    assert rows(mask.mask_middle(df, "ssn", 1, 1), "ssn") == [("1**-**-***9",)]
    assert rows(mask.mask_positions(df, "ip", [0]), "ip") == [("1*.*.*.*",)]
    once = rows(mask.mask_share(df, "mail", 50), "mail")
    assert once == rows(mask.mask_share(df, "mail", 50), "mail") and once[0][0].count("*") == 4


def test_suppress_small_groups_and_few_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (100.0, "b"), (None, "b")], "x double, g string")
    assert rows(suppress.suppress_cells(df, "x", F.col("x") == 100, "group_mean", group="g", min_group=5), "x")[2][0] == pytest.approx(103 / 3)
    two = spark.createDataFrame([(1.0,), (9.0,)], "x double")
    assert rows(suppress.suppress_cells(two, "x", "outlier")) == [(1.0,), (9.0,)]
    with pytest.raises(ValueError):
        suppress.suppress_columns(df, ["nope"])


def test_noise_properties(spark):
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"), F.lit(datetime(2024, 1, 6)).alias("t"))
    out = noise.uniform_numeric_noise(df, "x", (0, 1), clip=(0, 100), output="y")
    assert out.where("y > 100 OR y < x AND x < 100").count() == 0
    weekend = noise.uniform_temporal_noise(df, "t", 86400 * 3, keep_weekend=True, output="u")
    assert weekend.where(F.weekday("u") < 5).count() == 0
    lap = noise.differential_privacy(df, ["x"], 1.0).withColumn("e", F.col("x") - F.monotonically_increasing_id())
    assert abs(df.count() - 2000) == 0 and lap.count() == 2000


def test_pseudonyms(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "v string")
    got = rows(pseudonymize.hmac_pseudonym(df, "v", b"key", "d"))
    assert got[0][0] == hmac.new(b"key", b"d:x", hashlib.sha256).hexdigest()[:32]
    assert rows(pseudonymize.sha3_pseudonym(df, "v", b"s"))[0][0] == hashlib.sha3_256(b"xs").hexdigest()
    m = pseudonymize.sequential_map(df, "v")
    back = pseudonymize.reverse_map(pseudonymize.apply_map(df, "v", m), "v", m)
    assert sorted(map(str, rows(back))) == sorted(map(str, rows(df)))
    more = pseudonymize.sequential_map(spark.createDataFrame([("z",)], "v string"), "v", m)
    assert {r[0]: r[1] for r in rows(more)} == {"x": "ID_000001", "y": "ID_000002", "z": "ID_000003"}
    assert pseudonymize.collisions(m).count() == 0 and 0 < pseudonymize.collision_probability(1000, 32) < 1


def test_map_storage(spark, tmp_path):
    m = pseudonymize.hashed_map(spark.createDataFrame([("x",)], "v string"), "v", "salt")
    pseudonymize.save_map(m, str(tmp_path / "m"), b"k" * 16)
    assert rows(pseudonymize.load_map(spark, str(tmp_path / "m"), b"k" * 16)) == rows(m)


def test_fake(spark):
    df = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", "m"), (None, "m")], "n string, g string")
    out = rows(fake.fake_name(df, "n", "g"))
    assert out[0] == out[1] and out[3][0] is None and out[0][0].split()[0] in fake.FIRST_F
    phone = spark.createDataFrame([("+49 (30) 123-45",)], "p string")
    got = rows(fake.fake_phone(phone, "p"))[0][0]
    assert got.startswith("+49 (") and len(got) == 15
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "original string, pseudonym string")
    got = {r[0]: (r[1], r[3]) for r in rows(fake.resolve_chains(chain))}
    assert got["a"] == ("c", False) and got["x"][1]
    options = spark.createDataFrame([("p",), ("q",), ("a",)], "value string")
    pairs = rows(fake.one_to_one(df, "n", options))
    assert len({p for _, p in pairs}) == 2 and all(o != p for o, p in pairs)


def test_merge_nulls_and_names(spark):
    a = spark.createDataFrame([(1, "l"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "r"), (None, "m"), (2, "z")], "k int, v string")
    assert sorted(rows(reshape.merge_datasets(a, b, "k", how="outer")), key=str) == sorted([(1, "l", "r"), (None, "n", "m"), (2, None, "z")], key=str)
    assert reshape.relationship(a, b, "k", "k") == "one-to-one"
    with pytest.raises(ValueError):
        reshape.merge_datasets(a, b.union(b), "k", expect="one-to-one")


def test_impute_and_clean(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0), (3, None), (4, 6.0), (5, None)], "i int, x double")
    assert [r[1] for r in rows(reshape.impute(df, "x", "interpolation", order=["i"]))] == [None, 2.0, 4.0, 6.0, 6.0]
    assert [r[1] for r in rows(reshape.impute(df, "x", "bfill", order=["i"]))] == [2.0, 2.0, 6.0, 6.0, None]
    assert [r[1] for r in rows(reshape.impute(df, "x", "median"))] == [4.0, 2.0, 4.0, 6.0, 4.0]
    assert {r[1] for r in rows(reshape.impute(df, "x", "random_sample", order=["i"]))} <= {2.0, 6.0}
    cleaned = reshape.clean_invalid(df, {"x": {"max": 5}}, "fill", {"x": 0.0})
    assert [r[1] for r in rows(cleaned)] == [None, 2.0, None, 0.0, None]
    dates = spark.createDataFrame([("2024-01-31",), ("01/31/2024",), ("31.01.2024",), ("x",)], "d string")
    assert [r[0] and r[0].day for r in rows(reshape.parse_dates(dates, "d"))] == [31, 31, 31, None]


def test_models_on_small_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "q string, s int")
    assert rows(models.k_suppress(df, ["q"], 2)) == [("a", 1), ("a", 2)]
    assert sorted(rows(models.k_mask(df, ["q"], 2), "q")) == [("MASKED",), ("MASKED",), ("a",), ("a",)]
    assert rows(models.l_suppress(df, ["q"], "s", 2)) == [("a", 1), ("a", 2)]
    empty = df.where("1 = 0")
    assert models.k_evaluate(empty, ["q"]).count() == 1 and models.l_diversity(empty, ["q"], "s").count() == 0


def test_jaro_winkler():
    assert attacks.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert attacks.jaro_winkler("", "a") == 0.0 and attacks.jaro_winkler(None, "a") is None


def test_whole_tables_are_linked_and_measured(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").collect()
    shown = {r[0]: r[1][:4] + "*" * (len(r[1]) - 6) + r[1][-2:] for r in part}
    score = {(r[0], q[0]): (attacks.jaro_winkler(r[1], shown[q[0]]) + attacks.jaro_winkler(r[2], q[2])) / 2 for r in part for q in part if r[1] == shown[q[0]] or r[2] == q[2]}
    links = rows(catalog.queries()["link_probabilistic"](spark, SF))
    assert sorted(links) == sorted((a, b, pytest.approx(s, abs=1e-6)) for (a, b), s in score.items() if s >= 0.85)
    x = np.array([[r[3], r[4]] for r in part], float)
    y = np.round(x / 10) * 10
    d = np.sort(np.sqrt((((x[:, None] - y[None]) / y.std(0)) ** 2).sum(2)), axis=1)
    keys = [r[0] for r in part]
    assert dict(rows(catalog.queries()["dcr"](spark, SF))) == pytest.approx(dict(zip(keys, d[:, 0], strict=True)), abs=2e-6)
    assert dict(rows(catalog.queries()["nndr"](spark, SF))) == pytest.approx(dict(zip(keys, d[:, 0] / (d[:, 1] + 1e-10), strict=True)), abs=1e-4)
    members = {r["p_partkey"]: r["member"] for r in catalog.queries()["mia_dcr"](spark, SF).collect()}
    assert set(members) == set(keys) and 0 < sum(members.values()) < len(keys)


def test_linkage_of_null_keys(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "p")], "i int, k string, l string")
    assert sorted(rows(attacks.probabilistic_linkage(a, a, "i", "i", ["k", "l"], 0.5))) == [(1, 1, 0.5), (2, 2, 0.5)]


@pytest.mark.parametrize(("seed", "n"), [(1, 5), (2, 12), (3, 400)])
def test_cluster_linkage_finds_the_best_of_all(spark, seed, n):
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(n, 3)) ** 3, r.normal(size=(40, 3)) ** 3
    tables = [spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(m)], "i int, p double, q double, r double") for m in (x, y)]
    got = rows(attacks.cluster_linkage(*tables, "i", "i", ["p", "q", "r"]))
    u, v = (x - x.mean(0)) / x.std(0, ddof=1), (y - x.mean(0)) / x.std(0, ddof=1)
    axes = np.linalg.eigh(np.cov(u.T))[1][:, :0:-1]
    u, v = u @ axes, v @ axes
    cosine = (u / np.linalg.norm(u, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
    best = {}
    for b in range(len(y)):
        a = int(cosine[:, b].argmax())
        if cosine[a, b] >= 0.8:
            best[a] = max(best.get(a, (0.0, 0)), (float(cosine[a, b]), b))
    assert sorted(got) == sorted((a, b, pytest.approx(s, abs=1e-6)) for a, (s, b) in best.items())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_typos_against_all_pairs(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abc"), r.integers(0, 9)))
    common = {"KENYA", "IRAN", "UNITED STATES", "é", "ab", "", *(word() for _ in range(40))}
    rare = {"KEXYA", "IXAN", "UXITED STAXES", "THE UNITED STATES", "STATES", "XENYX", "z", *(word() + word() for _ in range(60))} - common
    df = spark.createDataFrame([(v,) for v in common for _ in range(10)] + [(v,) for v in rare], "v string")
    for distance in (1, 2):
        expected = sorted((a, b, edits(a, b)) for a in rare for b in common if edits(a, b) <= distance or a in b or b in a)
        assert sorted(rows(profile.typo_candidates(df, "v", distance=distance))) == expected


def test_hierarchy_finds_another_first_letter(spark):
    tree = spark.createDataFrame([("Berlin", "DE"), ("Paris", "FR")], "value string, land string")
    near = generalize.hierarchy(spark.createDataFrame([("Xerlin",), ("aris",), ("Rome",)], "x string"), "x", tree, "land", similar=0.8)
    assert sorted(r[0] for r in rows(near)) == ["DE", "FR", "OTHER"]


def test_leaders_against_all_pairs(spark):
    r = np.random.default_rng(6)
    values = {"big red car", "car red big", "the big red car", "Big  RED car", " ", "", *(" ".join(r.choice(list("abcdefgh"), r.integers(1, 7))) for _ in range(150))}
    for threshold in (0.5, 0.7, 1.0):
        leaders, expected = [], []
        for v in sorted(values):
            w = set(v.lower().split())
            first = next((n for n, x in leaders if len(w & x) >= threshold * max(1, len(w | x))), None)
            if first is None:
                leaders.append((v, w))
            expected.append((v, v if first is None else first))
        got = rows(text.leader_clusters(spark.createDataFrame([(v,) for v in values], "t string"), "t", threshold))
        assert sorted(got) == expected


def test_random_samples_follow_counts(spark):
    df = spark.range(12000).select("id", F.expr("CASE WHEN id % 6 = 0 THEN NULL WHEN id % 10 < 7 THEN 'a' WHEN id % 10 < 9 THEN 'b' ELSE concat('c', id) END").alias("v"))
    for order in (["id"], []):
        out = reshape.impute(df, "v", "random_sample", order=order)
        assert out.columns == df.columns and out.count() == 12000 and out.where("v is null").count() == 0
        assert out.join(df.toDF("id", "was"), "id").where("was <> v").count() == 0
        share = {r[0]: r[1] / 2000 for r in rows(out.where("id % 6 = 0").groupBy(F.substring("v", 1, 1)).count())}
        known = {r[0]: r[1] / 10000 for r in rows(df.where("v is not null").groupBy(F.substring("v", 1, 1)).count())}
        assert share == pytest.approx(known, abs=0.05) and out.where("id % 6 = 0 AND v LIKE 'c%'").select("v").distinct().count() > 100
    assert sorted(rows(reshape.impute(df, "v", "random_sample", order=["id"]))) == sorted(rows(reshape.impute(df, "v", "random_sample", order=["id"])))


def test_currency_and_mvf(spark):
    df = spark.createDataFrame([("$1,000.00",), ("1.234,56 EUR",), ("(5.00)",), ("invalid",), (None,)], "x string")
    assert [r[0] for r in rows(df.select(profile.parse_currency(F.col("x"))))] == [1000.0, 1234.56, -5.0, None, None]
    m = spark.createDataFrame([("['A', 'B']",), ("A; B",), ("[]",)], "x string")
    assert [r[0] for r in rows(m.select(profile.parse_mvf(F.col("x"))))] == [["A", "B"], ["A", "B"], []]


def test_text(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "der Hund und die Katze"), (3, "")], "id int, t string")
    assert {r[0]: r[1] for r in rows(text.language_vote(df, "id", "t"))} == {1: "en", 2: "de", 3: None}
    a, b = "a b c d", "a b c e"
    near = spark.createDataFrame([(a, b)], "a string, b string").select(text.jaccard(text.ngrams(F.col("a"), 2), text.ngrams(F.col("b"), 2)))
    assert rows(near) == [(0.5,)]
    assert len(rows(df.select(text.minhash(F.col("t"), 4)))[0][0]) == 4
    assert rows(df.where("id = 1").select(text.strip_accents(F.lit("é")), text.mtld(F.col("t"))))[0][0] == "e"


def test_minhash_estimates_and_short_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(5002)), " ".join(f"w{i}" for i in range(2500, 7502))
    got = [r[0] for r in rows(spark.createDataFrame([(a,), (b,), ("one two",), ("one",), ("",), (None,)], "t string").select(text.minhash(F.col("t"))))]
    assert [x and len(x) for x in got] == [128] * 5 + [None] and all(v is not None for x in got[:5] for v in x)
    assert sum(x == y for x, y in zip(got[0], got[1], strict=True)) / 128 == pytest.approx(1 / 3, abs=0.13)
    assert got[2] != got[3] and got[3] != got[4]


def test_every_address_of_a_text(spark, tmp_path):
    spark.createDataFrame([(1, "ab@x.org, cd@y.org and ab@x.org"), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()
    assert sorted(rows(found["prof_email_all"](spark, str(tmp_path)), "domain", "n")) == [("x.org", 2), ("y.org", 1)]
    assert sorted(rows(found["mask_preset_email_all"](spark, str(tmp_path)), "masked")) == [("a*@x.org",), ("a*@x.org",), ("c*@y.org",)]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "tsv", "orc"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a"b,\tc'), (2, None)], "i int, s string")
    path = str(tmp_path / f"x.{kind}")
    readers.write(df, path)
    options = {"multiLine": False} if kind == "json" else {}
    assert sorted(rows(readers.read(spark, path, columns=["i", "s"], schema="i int, s string", **options))) == sorted(rows(df))


def test_stack_sample_encrypt(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    assert rows(readers.stack([a, b])) == [(1,), (3,)]
    assert readers.sample_rows(spark.range(50), 7, "id").count() == 7
    key = b"0" * 16
    assert rows(readers.decrypt_columns(readers.encrypt_columns(a, ["x"], key), ["x"], key)) == [("1", 2)]


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_group_sizes(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("k").start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_group_sizes(events, "ts", ["event_type"])
    assert sorted(rows(spark.table("k"))) == sorted(rows(batch))


def nearest_of_all(x, y, k, scale, metric):
    s, m = (y.std(0), y.mean(0)) if scale else (1.0, 0.0)
    u, v = (x - m) / s, (y - m) / s
    if metric == "cosine":
        d = 1 - u @ v.T / (np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1))
    else:
        gaps = np.abs(u[:, None] - v[None])
        d = gaps.sum(2) if metric == "manhattan" else np.sqrt((gaps**2).sum(2))
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize(("metric", "k", "scale"), [("euclidean", 2, True), ("manhattan", 3, False), ("cosine", 2, True)])
def test_nearest_of_many_cells(spark, monkeypatch, metric, k, scale):
    for name, value in (("CELL_ROWS", 8), ("SHARE_ROWS", 16), ("QUERY_ROWS", 32), ("BLOCK_ROWS", 4)):
        monkeypatch.setattr(attacks, name, value)
    r = np.random.default_rng(4)
    x, y = r.normal(size=(150, 3)) ** 3, r.normal(size=(200, 3)) ** 3
    y[:40] = y[40]  # as many equal rows as there are count
    y[50], x[:20], x[20] = y[51], y[60:80], y[40]
    a, b = (spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(m)], "i int, p double, q double, r double") for m in (x, y))
    a = a.unionByName(a.limit(1).selectExpr("900 AS i", "double(null) AS p", "q", "r"))
    got = {r[0]: r[1:] for r in attacks.nearest_distances(a, b, "i", ["p", "q", "r"], scale=scale, metric=metric, k=k).collect()}
    assert got == {i: pytest.approx(d, abs=2e-6) for i, d in enumerate(nearest_of_all(x, y, k, scale, metric))}


def test_nearest_of_few_rows(spark):
    a = spark.createDataFrame([(1, 0.0), (1, 5.0), (None, 2.0)], "i int, p double")
    b = spark.createDataFrame([(2.0,)], "p double")
    assert sorted(rows(attacks.nearest_distances(a, b, "i", ["p"], k=2)), key=str) == [(1, 2.0, 3.0), (None, 0.0, None)]
    assert rows(attacks.nearest_distances(a, b.where("p < 0"), "i", ["p"])) == []


def repeated(spark, n):
    """Whole numbers below a hundred, each in many rows."""
    return spark.range(n).select("id", (F.col("id") % 97).cast("double").alias("p"), (F.col("id") % 89).cast("double").alias("q"))


def quick(run, seconds=60):
    """What a run gives, if it doesn't take the time that comparing all rows with all others does."""
    began = time.monotonic()
    out = run()
    assert time.monotonic() - began < seconds
    return out


def test_membership_of_many_rows(spark):
    many = repeated(spark, 400_000)
    shifted = many.withColumn("p", F.col("p") + F.when(F.col("id") % 2 == 0, 0.25).otherwise(0.5))
    out = attacks.membership_inference(attacks.dcr(shifted, many, "id", ["p", "q"], scale=False))
    assert quick(lambda: {tuple(r) for r in out.groupBy("dcr", "member", (F.col("id") % 2).alias("odd")).count().collect()}) == {(0.25, True, 0, 200_000), (0.5, False, 1, 200_000)}


def test_ratios_of_many_rows(spark):
    many = repeated(spark, 400_000)
    shifted = many.withColumn("p", F.col("p") + 0.25)
    out = attacks.nndr(shifted, many.dropDuplicates(["p", "q"]), "id", ["p", "q"])
    assert quick(lambda: sorted(rows(out.groupBy("nndr").count()))) == [(0.242536, 4123), (0.333333, 395_877)]


def test_closest_of_many_rows(spark):
    many = repeated(spark, 400_000)
    shifted = many.withColumn("q", F.col("q") + 0.25)
    out = attacks.dcr(shifted, many, "id", ["p", "q"], scale=False)
    assert quick(lambda: rows(out.groupBy("dcr").count())) == [(0.25, 400_000)]


def test_closest_mixed_of_many_rows(spark):
    many = repeated(spark, 400_000).select("id", F.concat(F.lit("k"), F.lpad(F.col("p").cast("int").cast("string"), 2, "0")).alias("p"), (F.col("id") % 2 == 0).alias("b"), "q")
    a, b = attacks.encode_features(many.withColumn("q", F.col("q") + 0.25), many, ["p", "b", "q"])
    assert quick(lambda: rows(attacks.dcr(a, b, "id", ["p", "b", "q"], scale=False).groupBy("dcr").count())) == [(0.25, 400_000)]


def test_leaders_leave_no_texts_on_disk(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    size = lambda: sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*") if p.is_file())
    r = np.random.default_rng(5)
    texts = [" ".join(f"{x:06x}" for x in r.integers(0, 1 << 24, 200)) for _ in range(300)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:10]] + [f"{t} more" for t in texts[:10]]
    before = size()
    got = dict(rows(text.leader_clusters(spark.createDataFrame([(t,) for t in texts], "t string"), "t")))
    assert len(got) == 320 and sum(k != v for k, v in got.items()) == 20
    assert all(k.split()[:200] == v.split()[:200] for k, v in got.items())
    assert size() - before < sum(map(len, texts)) / 4


def test_linkage_deals_the_pairs_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(attacks, "LIST_ROWS", 10, raising=False)
    a = spark.range(60).selectExpr("if(id = 0, null, id) AS i", "'x' AS k")
    out = attacks.probabilistic_linkage(a, a, "i", "i", ["k"])
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({(r[0], r[1]) for r in got}) == len(got) == 3600
    assert {r["score"] for r in got} == {1.0} and len({r["task"] for r in got}) > 1
