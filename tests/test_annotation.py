from genesieve.catalog import base
from genesieve.functions import hgvs

PROTEIN = {
    # change: (class, pos, pos2, initial, mutated, stop)
    "p.A267C": ("Missense_Mutation", 267, None, "A", "C", None),
    "p.a267c": ("Missense_Mutation", 267, None, "A", "C", None),
    "p.A5A": ("Silent", 5, None, "A", "A", None),
    "p.M1V": ("Translation_Start_Site", 1, None, "M", "V", None),
    "p.M1M": ("Silent", 1, None, "M", "M", None),
    "p.*100K": ("Nonstop_Mutation", 100, None, "*", "K", None),
    "p.*100KL*": ("Nonstop_Mutation", 100, None, "*", "KL*", None),
    "p.*5*": ("Silent", 5, None, "*", "*", 0),
    "p.E217*": ("Nonsense_Mutation", 217, None, "E", "*", 0),
    "p.E217>D*": ("not valid", None, None, "E", "*", 0),
    "p.K5_K6insKA": ("In_Frame_Indel", 5, 6, "KK", "KA", None),
    "p.K5_K6delKK": ("In_Frame_Indel", 5, 6, "KK", "KK", None),
    "p.K5del": ("In_Frame_Indel", 5, None, "K", None, None),
    "p.?_?ins?": ("missing", None, None, None, None, None),
    "p.K10fs": ("Frame_Shift_Indel", 10, None, "K", None, None),
    "p.K10fs*5": ("Frame_Shift_Indel", 10, None, "K", None, 5),
    "p.K10fs*": ("missing", None, None, "K", None, None),
    "p.K10AB*7": ("Frame_Shift_Indel", 10, None, "K", None, 7),
    "p.K10AB*": ("missing", None, None, "K", None, None),
    "p.?": ("unknown effect", None, None, None, None, None),
    "p.=": ("unknown effect", None, None, None, None, None),
    "p.(A5C)": ("unknown effect", None, None, None, None, None),
    "p.0": ("no protein", None, None, None, None, None),
    "p.0?": ("no protein", None, None, None, None, None),
    "p.A5?": ("missing", 5, None, "A", "?", None),
    "A5C": ("not valid", None, None, None, None, None),
    "p.5": ("not valid", None, None, None, None, None),
    "": ("not valid", None, None, None, None, None),
}
DNA = {
    # change: (class, pos, pos2, intron, intron2, initial, mutated, splice)
    "c.123A>G": ("substitution", 123, None, None, None, "A", "G", False),
    "123A>G": ("substitution", 123, None, None, None, "A", "G", False),
    "c.123+1G>A": ("substitution", 123, None, 1, None, "G", "A", True),
    "c.123-2G>A": ("substitution", 123, None, -2, None, "G", "A", True),
    "c.123+3G>A": ("substitution", 123, None, 3, None, "G", "A", False),
    "c.A>": ("not valid", None, None, None, None, None, None, False),
    "c.100_103delACGT": ("deletion", 100, 103, None, None, "ACGT", None, False),
    "c.100-5_103delACGT": ("deletion", 100, 103, -5, None, "ACGT", None, True),
    "c.100_103+9delACGT": ("deletion", 100, 103, None, 9, "ACGT", None, True),
    "c.100+5_103-5delACGT": ("deletion", 100, 103, 5, -5, "ACGT", None, False),
    "c.5-9_6+2delA": ("deletion", 5, 6, -9, 2, "A", None, True),
    "c.12del": ("deletion", None, None, None, None, None, None, False),
    "c.12_13delinsAC": ("deletion", None, None, None, None, None, None, False),
    "c.100_101insA": ("insertion", 100, 101, None, None, None, "A", False),
    "c.?": ("unknown effect", None, None, None, None, None, None, False),
    "c.(5)": ("unknown effect", None, None, None, None, None, None, False),
    "c.?_?insA": ("missing", None, None, None, None, None, "A", False),
    "c.5dup": ("not valid", None, None, None, None, None, None, False),
}


def test_protein_changes(spark):
    df = spark.createDataFrame([(c,) for c in PROTEIN], "change string")
    rows = {r[0]: tuple(r[1:]) for r in hgvs.annotate_protein(df, "change").collect()}
    assert rows == PROTEIN


def test_dna_changes(spark):
    df = spark.createDataFrame([(c,) for c in DNA], "change string")
    rows = {r[0]: tuple(r[1:]) for r in hgvs.annotate_dna(df, "change").collect()}
    assert rows == DNA


def test_null_changes_are_not_valid(spark):
    df = spark.createDataFrame([(None,)], "change string")
    assert hgvs.annotate_protein(df, "change").first()["protein_class"] == "not valid"
    assert hgvs.annotate_dna(df, "change").first()["dna_class"] == "not valid"


def test_splice_window_is_a_parameter(spark):
    df = spark.createDataFrame([("c.123+5G>A",)], "change string")
    assert not hgvs.annotate_dna(df, "change").first()["dna_splice"]
    assert hgvs.annotate_dna(df, "change", splice_5=6).first()["dna_splice"]


def test_mutations_of_many_splits_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Rows are dealt out anew only where a scan has too few splits for all cores."""
    items = spark.range(0, 400, 1, 64).selectExpr(
        "id AS l_orderkey", "id % 50 AS l_partkey", "id % 7 AS l_suppkey", "CAST(id % 5 AS INT) AS l_linenumber",
        "CAST(id % 9 AS DOUBLE) AS l_quantity", "'R' AS l_returnflag", "'F' AS l_linestatus",
    )
    items.write.parquet(str(tmp_path / "many" / "lineitem.parquet"))
    items.coalesce(1).write.parquet(str(tmp_path / "few" / "lineitem.parquet"))
    few = base.mutations(spark, str(tmp_path / "few")).collect()

    def never(spark):
        raise AssertionError("shuffled")

    monkeypatch.setattr(base, "shuffle_width", never)
    many = base.mutations(spark, str(tmp_path / "many")).collect()
    assert len(many) == 400 and sorted(many, key=repr) == sorted(few, key=repr)
