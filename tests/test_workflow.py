"""The three commands end to end on generated files, and forest invariants."""

import random

import pytest
from pyspark.sql import functions as F

from genesieve.operators import forest
from genesieve.plans import mutations, publishers, workflow

SETTINGS = forest.ForestSettings(trees=6, max_depth=6, max_bins=16)
GENES = 90


def write(path, header, rows):
    path.write_text("\n".join("\t".join(map(str, r)) for r in [header, *rows]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("cohort"), random.Random(5)
    genes = [f"G{i}" for i in range(GENES)]
    kind = lambda i: 1 if i % 6 == 0 else 2 if i % 6 == 1 else 0
    summary = [
        (g, "", 900 + i, 20 + rng.randrange(9), 3 + i % 5, rng.randrange(9) if kind(i) == 2 else 0, 0, 1, 0,
         12, 9 if kind(i) == 1 else 0, 0.5, 2.0, 1.0, 0.7, 30.5, 6.25)
        for i, g in enumerate(genes)
    ]
    head = ["Gene", "ID", "gene length", "non-silent snv", "silent snv", "nonsense", "lost stop", "splice site",
            "lost start", "missense", "recurrent missense", "normalized missense position entropy",
            "frameshift indel", "inframe indel", "normalized mutation entropy", "Total Missense MGAEntropy",
            "Total Missense VEST Score"]
    return {
        "summary": write(folder / "summary.txt", head, summary),
        "inactivating_test": write(folder / "tsg.txt", ["gene", "count", "inactivating p-value"],
                                   [(g, 1, rng.random()) for g in genes]),
        "clustering_test": write(folder / "og.txt", ["gene", "entropy p-value", "vest p-value", "combined p-value"],
                                 [(g, rng.random(), rng.random(), rng.random()) for g in genes[:70]]),
        "covariates": write(folder / "cov.txt", ["gene", "expression_CCLE", "replication_time", "HiC_compartment"],
                            [(g, rng.random(), 300, -3) for g in genes[10:]]),
        "network": write(folder / "net.txt", ["gene", "gene_betweeness", "gene_degree"],
                         [(g, rng.random(), i) for i, g in enumerate(genes[:60])]),
        "oncogenes": write(folder / "onco.txt", ["G0"], [(g,) for i, g in enumerate(genes) if i and kind(i) == 1]),
        "tsgs": write(folder / "tsgs.txt", ["G1"], [(g,) for i, g in enumerate(genes) if i > 1 and kind(i) == 2]),
        "folder": folder,
    }


@pytest.fixture(scope="module")
def feature_path(spark, files):
    output = str(files["folder"] / "features")
    tables = {k: files[k] for k in ("summary", "inactivating_test", "clustering_test", "covariates", "network")}
    matrix = workflow.build_features(spark, **tables, output=output)
    rows = matrix.collect()
    assert len(rows) == GENES and len(matrix.columns) == 25
    assert not any(v is None for r in rows for v in r)
    assert {r["gene_degree"] for r in rows if int(r["gene"][1:]) >= 60} == {0.0}
    known = [r["combined_p_value"] for r in rows if int(r["gene"][1:]) < 70]
    imputed = {round(r["combined_p_value"], 12) for r in rows if int(r["gene"][1:]) >= 70}
    assert imputed == {round(sum(known) / 70, 12)}
    return output


def test_permuted_network_keeps_values(spark, files):
    tables = {k: files[k] for k in ("summary", "inactivating_test", "clustering_test", "covariates", "network")}
    plain = workflow.build_features(spark, **tables)
    mixed = workflow.build_features(spark, **tables, permute_network=True, seed=4)
    degrees = lambda df: [r["gene_degree"] for r in df.orderBy("gene").collect()]
    assert sorted(degrees(plain)) == sorted(degrees(mixed)) and degrees(plain) != degrees(mixed)


def test_plain_forest(spark, files, feature_path):
    lists = (files["oncogenes"], files["tsgs"])
    settings = forest.ForestSettings(trees=4, max_depth=5, plain=True)
    model = workflow.train(spark, feature_path, *lists, str(files["folder"] / "plain"), settings=settings)
    _, matrix, names = workflow._labelled(spark, feature_path, *lists)
    rows = forest.score_forest(matrix, names, model).collect()
    assert len(rows) == GENES and any(r["oncogene_score"] > 0.5 for r in rows)


def test_null_then_classify_out_of_fold(spark, files, feature_path):
    lists = (files["oncogenes"], files["tsgs"])
    folder = files["folder"]
    bank = workflow.train(spark, feature_path, *lists, str(folder / "bank"), cv=True, settings=SETTINGS, folds=3, repeats=2)
    null = str(folder / "null")
    workflow.classify(spark, feature_path, *lists, null, trained=bank, cv=True, simulated=True,
                      settings=SETTINGS, folds=3, repeats=2)
    read = workflow.read_null(spark, null)
    assert read.filter((F.col("p") <= 0) | (F.col("p") > 1)).isEmpty()
    result = workflow.classify(spark, feature_path, *lists, str(folder / "out"), null=null,
                               settings=SETTINGS, folds=3, repeats=2)
    rows = result.collect()
    assert len(rows) == GENES
    for r in rows:
        assert r["oncogene_score"] + r["tsg_score"] + r["other_score"] == pytest.approx(1)
        for s in ("oncogene_score", "tsg_score", "driver_score"):
            assert 0 <= r[f"{s}_p"] <= 1 and r[f"{s}_q"] >= r[f"{s}_p"] - 1e-12
    performance = spark.read.csv(str(folder / "out" / "performance"), sep="\t", header=True).collect()
    assert {r["type"] for r in performance} == {"OG", "TSG", "Driver"}
    assert all(float(r["roc_auc"]) > 0.5 for r in performance)


def test_merged_cohort(spark):
    columns = "Gene string, Tumor_Sample string, Protein_Change string"
    a = spark.createDataFrame([("TP53", "s1", "p.R5C")], columns)
    b = spark.createDataFrame([("TP53", "s1", "p.R6C"), ("KRAS", "s2", "p.G12D")], columns)
    export = spark.createDataFrame(
        [("KRAS", "s2", "p.G13D", "c.38G>A"), ("APC", "s3", "p.R5*", "c.10+1G>A")], columns + ", DNA_Change string"
    )
    merged = mutations.merge_cohorts([a, b], export)
    rows = {r["Gene"]: r for r in mutations.annotate(merged, None).collect()}
    assert set(rows) == {"TP53", "KRAS", "APC"}
    assert rows["TP53"]["class"] == "Missense_Mutation" and rows["TP53"]["DNA_Change"] == "c.?"
    assert rows["APC"]["class"] == "Splice_Site"


def read(spark, path):
    return spark.read.csv(str(path), sep="\t", header=True)


def test_classify_writes_diagnostics_baseline_and_repeats(spark, files, feature_path):
    """Runs after the test that classified out of fold into ``out``."""
    folder = files["folder"] / "out"
    points = read(spark, folder / "qq").collect()
    assert len(points) == 3 * GENES and {r["score_type"] for r in points} == {"oncogene", "tsg", "driver"}
    first = min((r for r in points if r["score_type"] == "tsg"), key=lambda r: int(r["rank"]))
    assert float(first["expected"]) == pytest.approx(1 / (GENES + 1))
    changes = {r["score_type"]: r for r in read(spark, folder / "mlfc").collect()}
    result = {r["gene"]: r for r in read(spark, folder / "results").collect()}
    left = [float(r["tsg_score_p"]) for g, r in result.items() if int(g[1:]) % 6 > 1]  # on neither list
    least = min(p for p in left if p > 0)
    ranked = sorted(max(p, least) if p else least for p in left)
    import math

    mlfc = sum(abs(math.log2(p / ((i + 1) / len(ranked)))) for i, p in enumerate(ranked)) / len(ranked)
    assert float(changes["tsg"]["mlfc"]) == pytest.approx(mlfc)
    assert changes["tsg"]["alarm"] == str(mlfc > workflow.MLFC_ALARM).lower()
    baseline = {r["type"]: r for r in read(spark, folder / "baseline").collect()}
    assert set(baseline) == {"OG", "TSG", "Driver"} and all(float(r["roc_auc"]) == pytest.approx(0.5) for r in baseline.values())
    repeats = read(spark, folder / "repeats").collect()
    assert {(r["iteration"], r["class"]) for r in repeats} == {(i, c) for i in "12" for c in ("0", "1", "2", "driver", "macro")}
    support = {r["class"]: int(r["support"]) for r in repeats if r["iteration"] == "1" and r["support"]}
    assert support["1"] == support["2"] == GENES // 6 and support["0"] == GENES - 2 * (GENES // 6)


def test_null_from_several_runs(spark, files, feature_path):
    lists, folder = (files["oncogenes"], files["tsgs"]), files["folder"]
    model = workflow.train(spark, feature_path, *lists, str(folder / "for_runs"), settings=SETTINGS)
    one = workflow.classify(spark, feature_path, *lists, str(folder / "null_one"), trained=model, simulated=True)
    two = workflow.classify(spark, [feature_path, feature_path], *lists, str(folder / "null_two"), trained=model, simulated=True)
    table = lambda df: sorted((r["score_type"], r["score"], round(r["p"], 12)) for r in df.collect())
    assert table(one) == table(two)  # shares of twice the rows
    raw, _, _ = workflow._labelled(spark, [feature_path, feature_path], *lists)
    assert sorted(int(r["gene"]) for r in raw.collect()) == list(range(2, 2 * GENES + 2))


def test_network_file_from_edges(spark, files):
    edges = write(files["folder"] / "edges.txt", ["Official Symbol Interactor A", "Official Symbol Interactor B", "Score"],
                  [("A", "B", 1), ("B", "A", 2), ("B", "C", 3), ("C", "D", 4), ("B", "", 5), ("E", "E", 6)])
    output = str(files["folder"] / "network")
    rows = {r["gene"]: r for r in workflow.build_network(spark, edges, output).collect()}
    assert {g: r["gene_degree"] for g, r in rows.items()} == {"A": 1, "B": 2, "C": 2, "D": 1, "E": 2}
    # of five nodes, B lies on A-C and A-D, C on A-D and B-D
    assert {g: round(r["gene_betweeness"], 9) for g, r in rows.items()} == {"A": 0, "B": round(2 / 6, 9), "C": round(2 / 6, 9), "D": 0, "E": 0}


def test_publisher_tables(spark):
    located = spark.createDataFrame(
        [("TP53", "TCGA-02-0001-01", "OV", "chr7:10-12", "Indel In Frame", "A", "-", "p.K1in_frame_INSK", 0),
         ("KRAS", "X-1-2", "Ovarian Carcinoma", None, "Silent", "C", "T", "p.G12G", 1),
         ("APC", "s-Tumor", "Skin Melanoma", "chrX:5-5", "Nonsense", "C", "T", "p.R5*", 2)],
        "Gene string, Tumor_Sample string, Tumor_Type string, `Genome.position.hg19` string, Mutation_Type string, Reference string, Mutation string, Protein_Change string, ID int",
    )
    rows = {r["Gene"]: r for r in publishers.located_table(located).collect()}
    assert list(rows["TP53"].asDict()) == list(publishers.COLUMNS)
    assert rows["TP53"]["Tumor_Sample"] == "TCGA-02-0001" and rows["TP53"]["Protein_Change"] == "p.K1insK"
    assert (rows["TP53"]["Chromosome"], rows["TP53"]["Start_Position"], rows["TP53"]["End_Position"]) == ("chr7", 10, 12)
    assert rows["TP53"]["Variant_Classification"] == "In_Frame_Indel" and rows["KRAS"]["Start_Position"] == -1
    with pytest.raises(Exception, match="unknown category"):
        publishers.located_table(located.withColumn("Mutation_Type", F.lit("Odd"))).collect()
    checks = spark.createDataFrame([(0, None), (1, "low"), (2, None)], "ID int, `Mappability Warning` string")
    numbered = publishers.located_table(located).join(located.select("Gene", "ID"), "Gene")
    kept = {r["Gene"]: r for r in publishers.mappable(numbered, checks).collect()}
    assert set(kept) == {"TP53", "APC"} and kept["APC"]["Tumor_Type"] == "Melanoma" and kept["APC"]["Tumor_Sample"] == "s"
    assert publishers.mappable(numbered, None).count() == 3

    broad = spark.createDataFrame(
        [(0, "OV", "p1-Tumor", "KRAS", "Missense_Mutation", "12", "C", "T", 100), (1, "MEL", "p2", "APC", "Frame_Shift_Del", "X", "ACG", "-", 50),
         (2, "ZZ", "p3", "TP53", "In_Frame_Ins", "17", "-", "ACG", 7), (3, "OV", "p4", "EGFR", "Silent", "1", "A", "G", 1)],
        "ID int, ttype string, patient string, gene string, type string, chr string, ref_allele string, newbase string, pos bigint",
    )
    annotation = spark.createDataFrame(
        [(0, "MS", 12, "G", "D", "C", "T", None), (1, "FD", 5, None, None, "ACG", "-", None), (2, "II", 7, None, None, "-", "ACGA", None), (3, "SY", 3, "L", "L", "A", "G", "multi")],
        "ID int, `Sequence Ontology` string, `Amino acid position` int, `Reference amino acid(s)` string, `Alternate amino acid(s)` string, "
        "`Reference base` string, `Alternate base` string, `Mappability Warning` string",
    )
    rows = {r["Gene"]: r for r in publishers.pan_cancer_table(broad, annotation).collect()}
    assert set(rows) == {"KRAS", "APC", "TP53"}
    assert (rows["KRAS"]["Protein_Change"], rows["KRAS"]["End_Position"], rows["KRAS"]["Tumor_Type"]) == ("p.G12D", 100, "Ovarian")
    assert (rows["APC"]["Protein_Change"], rows["APC"]["End_Position"], rows["APC"]["Variant_Classification"]) == ("p.K5fs*", 52, "Frame_Shift_Indel")
    assert (rows["TP53"]["Protein_Change"], rows["TP53"]["End_Position"], rows["TP53"]["Chromosome"]) == ("p.K7_K8insK", 8, "chr17")
    assert rows["KRAS"]["Tumor_Sample"] == "p1" and rows["TP53"]["Tumor_Type"] == "ZZ"
    outside = {r["Gene"]: r for r in publishers.non_coding_table(broad.drop("ID")).collect()}
    assert list(outside["APC"].asDict()) == list(publishers.COLUMNS[:-1])
    assert (outside["APC"]["End_Position"], outside["TP53"]["End_Position"], outside["EGFR"]["End_Position"]) == (52, 8, 1)
    merged = mutations.merge_cohorts([publishers.located_table(located), publishers.pan_cancer_table(broad, annotation)])
    assert merged.count() == 6
