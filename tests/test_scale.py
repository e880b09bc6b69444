"""What has to hold beyond small tables: skew, large groups, broadcast checks, plan shapes."""

import pytest
from pyspark.sql import functions as F

from locusgrid.catalog import QUERIES
from locusgrid.operators import calls as C
from locusgrid.operators import corpus as D
from locusgrid.operators import intervals as I
from locusgrid.operators import keyed as K
from locusgrid.sources import sinks as W

SF = "/root/testdata/sf0.001"


@pytest.fixture
def conf(spark):
    old = {}

    def put(**kv):
        for k, v in kv.items():
            k = k.replace("__", ".")
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_large_groups_are_split_and_whole(spark):
    pairs = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.lpad(F.col("id").cast("string"), 5, "0").alias("v"))
    got = K.value_lists(pairs, "k", "v", "vs", limit=100).orderBy("k", "part_no").collect()
    hot = [r for r in got if r.k == "hot"]
    assert len(hot) > 1 and all(len(r.vs.split(",")) <= 100 for r in hot)
    assert [r.part_no for r in hot] == list(range(len(hot)))
    assert sorted(",".join(r.vs for r in hot).split(",")) == sorted(r.v for r in pairs.filter("k = 'hot'").collect())
    assert len([r for r in got if r.k != "hot"]) == 50 and sum(len(r.vs.split(",")) for r in got) == 2000


def test_index_rows_do_not_depend_on_partitions(spark, conf):
    sources = spark.range(25_000).select(F.lit("rs1").alias("rsid"), F.concat(F.lit("d"), "id").alias("doc")).unionByName(
        spark.sql("select 'rs2' as rsid, 'd1' as doc"))
    index = spark.sql("select 'd1' as first_doc, 1 as first_pos, col1 as rsid, '1' as chromosome, '5' as position, "
                      "'AG' as genotype, 'y' as found, 0 as discovered_in_phase from values ('rs1'), ('rs2')")
    found = []
    for n in (2, 4, 7):
        conf(spark__sql__shuffle__partitions=str(n))
        found.append(sorted(map(tuple, W.index_rows(index, sources).collect())))
    assert found[0] == found[1] == found[2]
    assert len({x for r in found[0] if r[3] == "rs1" for x in r[8].split(",")}) == 25_000


def test_lookup_is_the_same_with_and_without_broadcast(spark, conf):
    calls = spark.range(3000).select(
        F.lit("s").alias("sample_id"), F.concat(F.lit("rs"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 700).cast("string")).alias("rsid"),
        F.lit("1").alias("chrom"), F.col("id").alias("pos"), F.lit("AG").alias("genotype"), F.col("id").alias("line_no"))
    asked = C.id_list(spark, ",".join(f"rs{i}" for i in range(900)))
    small = sorted(map(tuple, C.lookup_calls(asked, calls).collect()))
    assert "LeftSemi" in C.lookup_calls(asked, calls)._jdf.queryExecution().optimizedPlan().toString()
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    big = C.lookup_calls(asked, calls)
    assert "LeftSemi" not in big._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, big.collect())) == small
    assert dict((r[1], r[3]) for r in small)["rs1"] == "2997"


def test_site_join_splits_a_hot_key(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="50KB", spark__sql__adaptive__advisoryPartitionSizeInBytes="50KB",
         spark__sql__adaptive__skewJoin__skewedPartitionFactor="2")
    calls = spark.range(0, 300000, 1, 8).select(
        F.lit("s").alias("sample_id"), F.concat(F.lit("rs"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000).cast("string")).alias("rsid"),
        F.lit("1").alias("chrom"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("genotype"), F.col("id").alias("line_no"))
    sites = spark.range(5000).select(F.concat(F.lit("rs"), F.col("id").cast("string")).alias("rsid"), F.lit("1").alias("chrom"), F.col("id").alias("pos"),
                                     F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    out = C.calls_to_vcf(calls, sites)
    assert "skew=true" in plan(out)
    assert out.count() == calls.filter(F.upper("genotype").rlike("[ACGTID]")).count()


def test_last_wins_combines_before_the_shuffle(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("line_no"), F.col("id").alias("v"))
    p = plan(K.last_wins(df, ["k"]))
    assert "partial_max_by" in p
    assert K.last_wins(df, ["k"]).first().v == 99


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    out = K.top_per_group(df, ["g"], [F.col("v").desc()], 3)
    assert "WindowGroupLimit" in plan(out)
    assert sorted(r.v for r in out.collect()) == [994, 995, 996, 997, 998, 999]


def test_line_state_is_not_shuffled(spark):
    docs = spark.createDataFrame([("a", "x may\n```\n")], "doc string, text string")
    assert "Exchange" not in plan(D.phrase_hits(docs))
    assert "Exchange" not in plan(D.claim_lines(docs))
    assert "Exchange" not in plan(D.doc_findings(docs, live_hash="x"))


def test_overlap_join_against_brute_force(spark):
    import random

    rng = random.Random(3)
    span = lambda n, top: [(i, rng.choice("12"), s, s + rng.choice([1, 5, 40, 20000, 3_000_000, 90_000_000]))
                           for i in range(n) for s in [rng.randrange(top)]]
    left, right = span(150, 200_000_000), span(120, 200_000_000)
    ldf = spark.createDataFrame(left, "l int, chrom string, a bigint, b bigint")
    rdf = spark.createDataFrame(right, "r int, chrom string, start0 bigint, end0 bigint")
    out = I.overlap_join(ldf, rdf, left_span=("a", "b"))
    got = sorted((x.l, x.r) for x in out.collect())
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(got) == len(set(got)) > 100
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("a"), F.when(F.col("id") % 7 != 0, "x").alias("b"))
    one = sorted(map(tuple, K.table_fingerprint(df, ["g"]).collect()))
    two = sorted(map(tuple, K.table_fingerprint(df.repartition(7).orderBy(F.desc("a")), ["g"]).collect()))
    other = sorted(map(tuple, K.table_fingerprint(df.withColumn("a", F.col("a") + (F.col("a") == 5).cast("int")), ["g"]).collect()))
    assert one == two and one != other
    ab = spark.createDataFrame([("a", "b")], "x string, y string")
    assert K.table_fingerprint(ab).first() != K.table_fingerprint(spark.createDataFrame([("ab", "")], "x string, y string")).first()


@pytest.mark.parametrize("name", ["calls_to_vcf", "overlap_join", "audit_claims", "discover_candidates", "index_join", "chip_sites", "verify_corpus", "lookup_calls"])
def test_no_cross_products(spark, name):
    p = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in p and "NestedLoop" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_results_do_not_depend_on_partitioning(spark, conf):
    for name in ("calls_summary", "first_seen_pool", "audit_claims", "overrepresented"):
        a = sorted(map(str, QUERIES[name](spark, SF).collect()))
        conf(spark__sql__shuffle__partitions="3")
        assert sorted(map(str, QUERIES[name](spark, SF).collect())) == a


def test_short_intervals_join_as_one_row_each(spark, conf):
    # Spans of a base or across a bin's border, none long: no lookups at other widths.
    w = I.BIN_WIDTHS[0]
    left = [(i, "c", w * (i % 5) - 3 + i % 7, w * (i % 5) - 2 + i % 7 + (i % 3) * 4) for i in range(60)] + [(99, "c", 5, 5), (98, "c", None, 9)]
    right = [(i, "c", w * (i % 4) - 4 + i % 11, w * (i % 4) + i % 11 + (w * 2 if i % 9 == 0 else 0)) for i in range(50)]
    ldf = spark.createDataFrame(left, "l long, chrom string, a long, b long")
    rdf = spark.createDataFrame(right, "r long, chrom string, start0 long, end0 long")
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    out = I.overlap_join(ldf, rdf, left_span=("a", "b"))
    want = sorted((x[0], y[0]) for x in left for y in right if x[2] is not None and x[2] < x[3] and x[2] < y[3] and y[2] < x[3])
    assert sorted((x.l, x.r) for x in out.select("l", "r").collect()) == want and want
    assert "_tag" not in plan(out) and "_lvl" not in plan(out)
