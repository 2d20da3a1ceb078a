from footing.plans.queries import fixed_width_slice


def test_no_part_row_is_left_out(spark, tmp_path):
    rows = [(1, "short", "Brand#11", "TIN"), (2, "n" * 31, "Brand#12", "TIN"), (3, "a b " * 40 + "c", "B" * 20, "TIN"), (4, None, "Brand#13", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = fixed_width_slice(spark, str(tmp_path)).collect()
    assert sorted((r["k"], r["name"], r["brand"], r["kind"]) for r in got) == rows
