"""Protein and DNA change annotation as column expressions.

A change string is read in one projection of ``rlike`` / ``regexp_extract``
expressions.  There is no user function, so the work stays inside whole-stage
code generation and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _number(text: Column) -> Column:
    """A matched group as a number.

    A failing try_cast is slow, so the usual non-numbers are sorted out before it;
    the text is read twice and should be a column or array element.
    """
    return F.when(~text.isin("", "?"), text.try_cast("bigint"))


def annotate_protein(df: DataFrame, change: str, prefix: str = "protein_") -> DataFrame:
    """Add class, position, residues and stop position of a protein change.

    ``pos`` / ``pos2`` are the first two positions of an indel, otherwise ``pos``
    alone is set.  Columns are built in layers, each small enough for the JIT and
    each reading the one before several times, so that nothing is computed twice.
    """
    raw = F.col(change)
    upper, s = F.col("__upper"), F.col("__body")
    body = F.when(upper.startswith("P."), F.substring(upper, F.lit(3), F.length(upper))).otherwise(upper)
    first, last, form = F.col("__first"), F.col("__last"), F.col("__form")
    columns = df.columns
    df = df.withColumn("__upper", F.replace(F.upper(raw), F.lit(">"), F.lit("")))
    df = df.withColumn("__body", body).withColumns(
        {"__first": F.substring(s, 1, 1), "__last": F.substring(s, -1, 1), "__question": s.contains("?")}
    )

    # The form that the string is read as: the first that applies.
    effect = s.isin(*fv.P_UNKNOWN, *fv.P_NO_PROTEIN) | s.contains("(")
    df = df.withColumns(
        {
            "__replaced": F.regexp_extract(s, fv.P_REPLACED, 2),
            "__effect": effect,
        }
    ).withColumn("__replaced_pos", _number(F.col("__replaced"))).withColumn(
        "__form",
        F.when(raw.isNull() | ~F.upper(raw).contains("P."), NONE)
        .when(F.col("__effect"), EFFECT)
        .when(s.rlike(fv.P_LOST_STOP), LOST_STOP)
        .when((F.col("__replaced_pos") == 1) & (first != last), LOST_START)
        .when(F.col("__replaced_pos").isNotNull(), REPLACED)
        .when(raw.contains("ins"), INSERTED)
        .when(raw.contains("del"), DELETED)
        .when(raw.contains("fs") | raw.rlike(fv.P_FRAME_SHIFT_ORIGINAL), SHIFTED)
        .when((last == "*") & (F.length(s) > 1), STOPPED)
        .otherwise(NONE),
    )

    known_indel = F.col("__indel")
    df = df.withColumn("__indel", form.isin(INSERTED, DELETED) & ~F.col("__question"))
    df = df.withColumns(
        {
            "__numbers": F.when(known_indel, F.regexp_extract_all(s, F.lit(r"[A-Z](\d+)"), F.lit(1))),
            "__number_text": F.when(form.isin(LOST_STOP, SHIFTED), F.regexp_extract(s, r"[A-Z*](\d+)", 1))
            .when(form == STOPPED, F.regexp_extract(s, r"^.(\d+)\*$", 1)),
            "__stop_text": F.when(form == SHIFTED, F.regexp_extract(s, r"\*(\d+)$", 1)),
            "__stop_missing": (form == SHIFTED) & s.rlike(fv.P_ENDS_IN_STOP),
            f"{prefix}initial": _initial(s, known_indel),
            f"{prefix}mutated": _mutated(s, known_indel),
        }
    ).withColumns(
        {"__number": _number(F.col("__number_text")), "__stop": _number(F.col("__stop_text"))}
    )
    # A frame shift that ends in a stop has to say where the stop is.
    parsed = F.col("__number").isNotNull() & (~F.col("__stop_missing") | F.col("__stop").isNotNull())
    df = df.withColumn("__parsed", F.when(form.isin(SHIFTED, STOPPED), parsed).otherwise(True))

    ok = F.col("__parsed")
    synonymous = ((form == REPLACED) & (first == last)) | ((form == STOPPED) & (first == "*"))
    by_form = F.get(F.array(*[F.lit(c) for c in FORM_CLASSES]), form)
    category = (
        F.when((form == STOPPED) & ~ok, fv.NOT_VALID)
        .when((form == EFFECT) & s.isin(*fv.P_NO_PROTEIN), fv.NO_PROTEIN)
        .when((form > EFFECT) & (F.col("__question") | ~ok), fv.MISSING)
        .when(synonymous, fv.SILENT)
        .otherwise(by_form)
    )
    position = (
        F.when(form.isin(LOST_START, REPLACED), F.col("__replaced_pos"))
        .when(F.col("__indel"), _number(F.get("__numbers", F.lit(0))))
        .when(ok, F.col("__number"))
    )
    df = df.withColumns(
        {
            f"{prefix}class": category,
            f"{prefix}pos": position,
            f"{prefix}pos2": F.when(F.col("__indel"), _number(F.get("__numbers", F.lit(1)))),
            f"{prefix}mutated": _or_null(F.col(f"{prefix}mutated")),
            f"{prefix}stop_pos": F.when(form == STOPPED, F.lit(0).cast("bigint"))
            .when(ok, F.col("__stop")),
        }
    )
    added = [f"{prefix}{c}" for c in ("class", "pos", "pos2", "initial", "mutated", "stop_pos")]
    return df.select(*columns, *added)


# What a protein change string is read as, and the class that belongs to it.
NONE, EFFECT, LOST_STOP, LOST_START, REPLACED, INSERTED, DELETED, SHIFTED, STOPPED = range(9)
FORM_CLASSES = (
    fv.NOT_VALID, fv.UNKNOWN_EFFECT, fv.NONSTOP, fv.TRANSLATION_START, fv.MISSENSE,
    fv.IN_FRAME, fv.IN_FRAME, fv.FRAME_SHIFT, fv.NONSENSE,
)


def _initial(s: Column, indel: Column) -> Column:
    letters = F.regexp_extract_all(s, F.lit(r"([A-Z])\d+"), F.lit(1))
    return F.when(indel, F.array_join(F.slice(letters, 1, 2), "")).when(
        F.col("__form").isin(LOST_STOP, LOST_START, REPLACED, SHIFTED, STOPPED), F.col("__first")
    )


def _mutated(s: Column, indel: Column) -> Column:
    form = F.col("__form")
    inserted = F.btrim(F.regexp_extract(s, r"INS([A-Z0-9?*]+)", 1), F.lit("?"))
    return (
        F.when(form.isin(LOST_START, REPLACED, STOPPED), F.col("__last"))
        .when(form == LOST_STOP, F.regexp_extract(s, r"([A-Z?*]+)$", 1))
        .when(indel & (form == INSERTED), inserted)
        .when(indel, F.regexp_extract(s, r"DEL([A-Z]*)", 1))
    )


_SEPARATOR = "\u0001"


def _fields(text: Column, pattern: str, order: str) -> Column:
    """The groups of a pattern, in the given order, separated by a control character.

    One replacement instead of one extraction per group; text without a match is
    returned as it is.
    """
    return F.regexp_replace(text, f"^.*?{pattern}", _SEPARATOR.join(f"${g}" if g != "0" else "" for g in order))


def annotate_dna(
    df: DataFrame,
    change: str,
    prefix: str = "dna_",
    splice_3: int = fv.SPLICE_3,
    splice_5: int = fv.SPLICE_5,
) -> DataFrame:
    """Add class, positions, intron offsets, alleles and the splice flag of a DNA change."""
    raw, s, kind = F.col(change), F.col("__s"), F.col("__kind")
    columns = df.columns
    body = F.when(raw.startswith("c."), F.substring(raw, F.lit(3), F.length(raw))).otherwise(raw)
    df = df.withColumn("__s", body).withColumns(
        {
            "__kind": F.when(s.contains(">"), fv.SUBSTITUTION)
            .when(s.contains("del"), fv.DELETION)
            .when(s.contains("ins"), fv.INSERTION),
            "__unknown": F.lower(s).isin(*fv.C_UNKNOWN) | s.startswith("("),
        }
    )
    # near position, near offset, far position, far offset, removed, added
    fields = (
        F.when(kind == fv.SUBSTITUTION, _fields(s, fv.C_SUBSTITUTION, "123456"))
        .when(kind == fv.DELETION, _fields(s, fv.C_DELETION, "123450"))
        .when(kind == fv.INSERTION, _fields(s, fv.C_INSERTION, "123405"))
    )
    df = df.withColumn("__fields", F.split(fields, _SEPARATOR))

    def field(index: int) -> Column:
        return F.get("__fields", F.lit(index))

    df = df.withColumn("__matched", F.coalesce(F.size("__fields") > 1, F.lit(False))).withColumns(
        {
            "__ranged": F.col("__matched") & (field(0) != ""),
            "__p1": F.when(F.col("__matched"), _number(field(0))),
            "__i1": F.when(F.col("__matched"), _number(field(1))),
            "__p2": _number(field(2)),
            "__i2": _number(field(3)),
        }
    )
    matched, ranged, unknown = F.col("__matched"), F.col("__ranged"), F.col("__unknown")
    near, far = F.col("__i1"), F.col("__i2")
    category = (
        F.when(s.isNull(), fv.NOT_VALID)
        .when(kind.isNull() & ~unknown, fv.NOT_VALID)
        .when((kind == fv.SUBSTITUTION) & ~matched, fv.NOT_VALID)
        .when(unknown, fv.UNKNOWN_EFFECT)
        .when(s.contains("?"), fv.MISSING)
        .otherwise(kind)
    )

    def inside(offset: Column) -> Column:
        return F.coalesce(offset.between(splice_3, splice_5), F.lit(False))

    df = df.withColumns(
        # In a range, an end without intron offset lies in the exon and counts as 0.
        {"__a": F.coalesce(near, F.lit(0)), "__b": F.coalesce(far, F.lit(0))}
    )
    a, b = F.col("__a"), F.col("__b")
    ends_inside = ((a != 0) & inside(a)) | ((b != 0) & inside(b))
    jumps_site = ((a == 0) & (b > splice_5)) | ((a < splice_3) & (b == 0))
    df = df.withColumns(
        {
            f"{prefix}class": category,
            f"{prefix}pos": F.when(ranged, F.col("__p1")).otherwise(F.col("__p2")),
            f"{prefix}pos2": F.when(ranged, F.col("__p2")),
            f"{prefix}intron": F.when(ranged, near).otherwise(far),
            f"{prefix}intron2": F.when(ranged, far),
            f"{prefix}initial": F.when(matched, _or_null(field(4))),
            f"{prefix}mutated": F.when(matched, _or_null(field(5))),
            f"{prefix}splice": matched & F.when(ranged, ends_inside | jumps_site).otherwise(inside(far)),
        }
    )
    added = ("class", "pos", "pos2", "intron", "intron2", "initial", "mutated", "splice")
    return df.select(*columns, *[f"{prefix}{c}" for c in added])


def consequence(protein_class: Column, splice: Column, known: Column | None = None) -> Column:
    """The class of a mutation: a splice site hit overrides the protein class."""
    at_splice = F.coalesce(splice, F.lit(False))
    if known is not None:
        at_splice = at_splice | F.coalesce(known == fv.SPLICE, F.lit(False))
    return F.when(at_splice, F.lit(fv.SPLICE)).otherwise(protein_class)
