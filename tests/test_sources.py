import datetime
import json

import pytest
from pyspark.sql import functions as F

from heddle.plans import upload
from heddle.sources import knowledge, screens
from heddle.streaming import ingest


def test_screen_files(spark, tmp_path):
    (tmp_path / "SCREEN_381.screen.tab.txt").write_text("#SCREEN_ID\tIDENTIFIER_ID\tOFFICIAL_SYMBOL\tSCORE.1\tHIT\n381\t5441\tPOLR2L\t-1.98680010698\tYES\n381\t5691\tPSMB3\t-\tNO\n\t1\tX\t1\tNO\n")
    (tmp_path / "SCREEN_9.screen.tab.txt").write_text("SCREEN_ID\tOFFICIAL_SYMBOL\tHIT\tSCORE.2\n9\tABC\tyes\tnan\n9\tDEF\tNO\t2e-1\n")
    (tmp_path / "bad.txt").write_text("SCREEN_ID\tSCORE.1\n1\t2\n")
    rows = screens.read_tab_files(spark, str(tmp_path))
    staged = {(r.screen_id, r.gene_symbol): (r.identifier_id, r.hit_flag, r.score_1, r.score_2, r.screen_file) for r in screens.staged(rows, 1).collect()}
    assert staged == {
        (381, "POLR2L"): (5441, True, -1.98680010698, None, "SCREEN_381.screen.tab.txt"), (381, "PSMB3"): (5691, False, None, None, "SCREEN_381.screen.tab.txt"),
        (9, "ABC"): (None, True, None, None, "SCREEN_9.screen.tab.txt"), (9, "DEF"): (None, False, None, 0.2, "SCREEN_9.screen.tab.txt"),
    }
    assert {r.file_screen_id for r in rows.collect()} == {"381", "9"}


def test_faults_of_files_are_their_own(spark, tmp_path):
    """A name twice, no header, a header without a needed column, an empty file: each is judged alone, the others load."""
    files = {
        "SCREEN_1.txt": "#SCREEN_ID\tOFFICIAL_SYMBOL\tHIT\tNOTE\tNOTE\n1\tA\tYES\tx\ty\n",
        "SCREEN_2.txt": "SCREEN_ID\tOFFICIAL_SYMBOL\tSCORE.1\tSCORE.1\tHIT\n2\tB\t1\t2\tYES\n2\tC\n",
        "SCREEN_3.txt": "3\tC\tYES\n3\tD\tNO\n", "SCREEN_4.txt": "SCREEN_ID\tSCORE.1\n4\t1\n", "SCREEN_5.txt": "",
        "SCREEN_6.txt": "\n\nSCREEN_ID\tOFFICIAL_SYMBOL\tHIT\n\n6\tE\tNO\n   \n\tF\tNO\n6\tG\tyes\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    staged = screens.staged(screens.read_tab_files(spark, str(tmp_path)), 1).collect()
    assert {(r.screen_id, r.gene_symbol, r.hit_flag, r.score_1, r.row_number) for r in staged} == {(1, "A", True, None, 2), (2, "B", True, 2.0, 2), (2, "C", None, None, 3), (6, "E", False, None, 2), (6, "G", True, None, 5)}
    rejected = {r.screen_file: r.reason for r in screens.rejected_files(spark, str(tmp_path)).collect()}
    assert rejected == {"SCREEN_3.txt": "no header", "SCREEN_4.txt": "header without OFFICIAL_SYMBOL, HIT"}


@pytest.mark.parametrize("bytes_", [200, 1 << 20])
def test_row_numbers_over_splits(spark, tmp_path, bytes_):
    sizes = {1: 400, 2: 3, 3: 90}
    for s, n in sizes.items():
        lines = ["#SCREEN_ID\tOFFICIAL_SYMBOL\tSCORE.1\tHIT"] + [f"{s}\tG{k}\t{k}\tNO" + ("\n" if k % 10 == 3 else "") for k in range(n)]
        (tmp_path / f"SCREEN_{s}.txt").write_text("\n".join(lines))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = screens.read_tab_files(spark, str(tmp_path)).collect()
        tasks = screens.read_tab_files(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(int(r.screen_id), int(r.score_1), r.row_number) for r in rows} == {(s, k, k + 2) for s, n in sizes.items() for k in range(n)}
    assert tasks > 1 or bytes_ > 200


def test_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"1": [{"SCREEN_ID": "1", "MOI": "0.3"}], "2": {"SCREEN_ID": "2", "NOTES": "n"}, "3": [], "4": [{"MOI": "1"}]}))
    got = {r.screen_id: r.fields for r in screens.read_metadata(spark, str(tmp_path)).collect()}
    assert got == {"1": {"SCREEN_ID": "1", "MOI": "0.3"}, "2": {"SCREEN_ID": "2", "NOTES": "n"}, "4": {"MOI": "1"}}


def test_unpivot(spark):
    wide = spark.createDataFrame([("m1", "0.5", "NA"), ("m2", "-1", "2")], "model_id string, `A1BG (1)` string, `A.2 (29)` string")
    got = {(r.model, r.gene_id): r.value for r in screens.unpivot_models(wide, "model_id").collect()}
    assert got == {("m1", 1): 0.5, ("m1", 29): None, ("m2", 1): -1.0, ("m2", 29): 2.0}


def test_ontology(spark, tmp_path):
    (tmp_path / "go.obo").write_text('format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nnamespace: bp\ndef: "first \\"x\\"" [a]\nis_a: GO:2 ! two\nis_a: GO:3\n\n[Typedef]\nid: part_of\nname: part\n\n[Term]\nid: GO:2\nname: two\nnamespace: bp\nis_obsolete: true\n')
    terms, parents = knowledge.read_ontology(spark, str(tmp_path / "go.obo"))
    assert {tuple(r) for r in terms.collect()} == {("GO:1", "one", "bp", 'first \\"x\\"', False), ("GO:2", "two", "bp", None, True)}
    assert {tuple(r) for r in parents.collect()} == {("GO:1", "GO:2"), ("GO:1", "GO:3")}


def test_other_knowledge_files(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("#tax\tid\tsym\n9606\t1\tA1BG\n9606\t2\t-\n\n")
    assert [tuple(r) for r in knowledge.read_positions(spark, str(tmp_path / "g.tsv"), {"id": 1, "sym": 2, "none": 9}).collect()] == [("1", "A1BG", None), ("2", None, None)]
    (tmp_path / "l.txt").write_text("a b score\nP1 P2 500\nP2 P3 x\n")
    assert [tuple(r) for r in knowledge.read_links(spark, str(tmp_path / "l.txt"), ["a", "b", "score"]).collect()] == [("P1", "P2", 500), ("P2", "P3", None)]
    (tmp_path / "c.tsv").write_text('complex_id\tsubunits_gene_name\tnote\n1\tA; b,C\t"tab\there\nand line"\n2\tA;B\tx\n')
    assert {tuple(r) for r in knowledge.read_complexes(spark, str(tmp_path / "c.tsv")).collect()} == {("1", "A"), ("1", "B"), ("1", "C")}
    now = datetime.datetime(2026, 2, 1)
    cache = spark.createDataFrame([("new", datetime.datetime(2026, 1, 10)), ("old", datetime.datetime(2025, 12, 1))], "k string, fetched_at timestamp")
    assert [r.k for r in knowledge.fresh(cache, now).collect()] == ["new"]


FILES = {
    "mageck": ("id\tnum\tneg|score\tneg|lfc\tpos|score\n" + "".join(f"G{i}\t4\t0.{i}\t-{i}.5\t0.9\n" for i in range(7)), "MAGECK", "id", "neg|lfc"),
    "few": ("id\tneg|score\nA\t1\nB\t2\n", "MAGECK", "id", "neg|score"),
    "stars": ("Gene,q-value,p-value,LFC,Rank\n" + "".join(f"G{i},0.1,0.2,{i - 3},{i}\n" for i in range(6)), "STARS", "Gene", "LFC"),
    "deseq": ("gene\tbaseMean\tlog2FoldChange\tlfcSE\tstat\tpvalue\tpadj\n" + "".join(f"G{i}\t9\t{i}\t1\t1\t0.1\tNA\n" for i in range(6)), "DESEQ2", "gene", "log2FoldChange"),
    "orcs": ("#SCREEN_ID\tIDENTIFIER_ID\tOFFICIAL_SYMBOL\tSCORE.2\tSCORE.1\tHIT\n# comment\n" + "".join(f"1\t{i}\tG{i}\t-\t{i - 2}\t{'YES' if i else 'NO'}\n" for i in range(5)), "ORCS", "OFFICIAL_SYMBOL", "SCORE.1"),
    "residual": ("Gene,condition,mean_lfc,mean_residual,z_score,ascending_rank\n" + "".join(f"G{i},c,1,1,{i},1\n" for i in range(5)), "RESIDUAL", "Gene", "z_score"),
    "simple": ("gene_symbol,score\n" + "".join(f"'ATG{i}',-{i}.21\n" for i in range(5)) + ",1\nX,\n", "SIMPLE", "gene_symbol", "score"),
    "bare": ("ABC,1\nDEF,2\n", "SIMPLE", "ABC", "1"),
    "nothing": ("", "UNKNOWN", "", ""),
    "none": (None, "UNKNOWN", "", ""),
    "odd": ("a\tb\tc\td\n1\t2\t3\t4\n", "UNKNOWN", "a", "b"),
}


def test_formats(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in FILES.items()], "file string, text string")
    found = {r.file: (r.found.format, r.found.id_column, r.found.score_column) for r in upload.detect(files).collect()}
    assert found == {name: (kind, id_column, score) for name, (_, kind, id_column, score) in FILES.items()}


def test_parsing(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in FILES.items()], "file string, text string")
    genes, report = upload.parse_genes(files)
    accepted = {r.file: (r.n_genes, r.accepted, r.warnings) for r in report.collect()}
    assert accepted["mageck"] == (7, True, []) and accepted["few"] == (2, False, ["too few genes"]) and accepted["nothing"] == (0, False, ["no rows found"])
    assert accepted["simple"] == (6, True, ["1 rows had no score", "1 rows had no identifier"])
    rows = {(r.file, r.symbol): r for r in genes.collect()}
    assert rows["mageck", "G3"].score == -3.5 and rows["mageck", "G3"].extra["pos|score"] == "0.9"
    assert rows["simple", "ATG4"].score == -4.21 and rows["simple", "X"].score == 0.0
    assert rows["orcs", "G0"].is_hit is False and rows["orcs", "G4"].is_hit is True and rows["deseq", "G1"].is_hit is None
    assert not any(f == "few" for f, _ in rows)
    signals = {r.file: (r.n_genes, r.hit_count, r.coverage, r.direction) for r in upload.signals(genes).collect()}
    assert signals["orcs"] == (5, 4, "FULL", "bidirectional") and signals["mageck"][3] == "depletion" and signals["deseq"][1:] == (None, "FULL", "enrichment")


def test_resolution(spark):
    walk = spark.createDataFrame([("entrez", "9474", "ATG5"), ("ensembl", "ENSG00000057663", "ATG5"), ("ortholog", "Irgm1", "IRGM")], "kind string, id string, target string")
    genes = spark.createDataFrame([("9474",), ("1",), ("ENSG00000057663.12",), ("Irgm1",), ("Abc",)], "symbol string")
    human = {r.symbol: (r.resolved, r.mapped, r.reason) for r in upload.resolve_ids(genes, walk).collect()}
    assert human == {"9474": ("ATG5", True, None), "1": ("1", False, "entrez id not found"), "ENSG00000057663.12": ("ATG5", True, None), "Irgm1": ("Irgm1", False, None), "Abc": ("Abc", False, None)}
    mouse = {r.symbol: r.resolved for r in upload.resolve_ids(genes, walk, "Mouse").collect()}
    assert mouse["Irgm1"] == "IRGM" and mouse["Abc"] == "ABC"


def test_streaming(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    half = events.withColumn("version_id", F.lit(1))
    half.filter("event_id % 2 = 0").write.mode("append").parquet(source)
    ingest.stage_files(spark, source, half.schema, target, str(tmp_path / "cp")).awaitTermination()
    half.filter("event_id % 2 = 1").write.mode("append").parquet(source)
    ingest.stage_files(spark, source, half.schema, target, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).agg(F.count("*"), F.count_distinct("event_id")).first()[:2] == (events.count(),) * 2
    stream = ingest.windowed_counts(spark.readStream.schema(half.schema).parquet(source))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_lines_of_screen_files_are_neither_sorted_nor_shuffled(spark, tmp_path):
    """Also where a file is read in many splits, of which the first has the header."""
    for k in range(2):
        text = "# SCREEN_ID\tOFFICIAL_SYMBOL\tHIT\n" + "".join(f"{k}\tg{i}\tYES\n\n" for i in range(400))
        (tmp_path / f"SCREEN_{k}.tab.txt").write_text(text)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = screens.read_tab_files(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        found = {(r.file_screen_id, r.official_symbol): r.row_number for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert found == {(str(k), f"g{i}"): i + 2 for k in range(2) for i in range(400)}
    assert "Sort" not in plan and "Exchange hash" not in plan


def test_rows_are_numbered_through_the_parts_of_a_folder(spark, tmp_path):
    for part, genes in enumerate((["a", "b"], [], ["c"], ["d", "e"])):
        folder = tmp_path / "SCREEN_5"
        folder.mkdir(exist_ok=True)
        (folder / f"part-0000{part}.csv").write_text("SCREEN_ID\tOFFICIAL_SYMBOL\tHIT\n" * bool(genes) + "".join(f"5\t{g}\tYES\n" for g in genes))
    rows = screens.read_tab_files(spark, str(tmp_path / "SCREEN_5"), in_parts=True).collect()
    assert {(r.official_symbol, r.row_number) for r in rows} == {("a", 2), ("b", 3), ("c", 4), ("d", 5), ("e", 6)}
