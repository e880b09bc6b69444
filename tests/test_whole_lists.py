"""Lists that stay in one value, however long."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from locusgrid.operators import keyed as K
from tools.check import compare

SF = "/root/testdata/sf0.001"


def test_the_index_has_all_documents_of_an_id_in_one_row(spark, tmp_path):
    documents = spark.sql("select id as doc_id, 'see rs7' as text from range(5500)")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select * from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    line = compare(spark, con, "index_source_docs", str(tmp_path))
    assert line.startswith("ok"), line
    row, = queries()["index_source_docs"](spark, str(tmp_path)).filter("rsid = 'rs7'").collect()
    assert row.source_docs == ",".join(sorted(map(str, range(5500))))


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_whole_lists_do_not_depend_on_ranges(spark, partitions):
    pairs = spark.range(3000).select(F.concat(F.lit("k"), F.least(F.col("id") % 7, F.lit(2))).alias("k"), F.col("id").cast("string").alias("v"))
    pairs = pairs.union(pairs).union(spark.sql("values ('k0', null), ('none', null)"))
    want = {k: ",".join(sorted(str(i) for i in range(3000) if min(i % 7, 2) == n)) for n, k in enumerate(("k0", "k1", "k2"))}
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert {r.k: r.vs for r in K.whole_lists(pairs, "k", "v", "vs").collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
