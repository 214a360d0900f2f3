"""Steps of a load do not gather a version's rows in one task."""

import re

from heddle.plans import warehouse


def test_no_step_is_shuffled_by_its_version_alone(spark, monkeypatch, tmp_path):
    plans, replace = {}, warehouse.replace_partitions

    def spy(df, path, by):
        plans[path.rsplit("/", 1)[-1]] = df._jdf.queryExecution().executedPlan().toString()
        replace(df, path, by)

    monkeypatch.setattr(warehouse, "replace_partitions", spy)
    versions = spark.createDataFrame([(1, "mouse")], "version_id int, organism string")
    screens = spark.createDataFrame([(1, 7, "mouse", "s")], "version_id int, screen_id long, organism string, annotation_source string")
    genes = spark.createDataFrame([(1, 7, g, f"g{g}", True, 0.5, g) for g in range(5)], "version_id int, screen_id long, identifier_id long, gene_symbol string, hit_flag boolean, score_1 double, row_number long")
    log = warehouse.run_load(screens, genes, versions, str(tmp_path / "load"), 1).collect()
    assert {r.step_name: r.rows_inserted for r in log} == {"staged": 5, "screen": 1, "gene": 5, "screen_gene_raw": 5, "fact_screen_gene": 5, "dim_screen": 1, "dim_gene": 5}
    assert len(plans) == 7 and not [n for n, plan in plans.items() if re.search(r"hashpartitioning\(version_id#\d+, \d+", plan)]
