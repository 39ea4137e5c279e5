"""Cleaning expressions for identifiers, categories, positions and change strings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def recode(value: Column, names: Mapping[str, str], strict: bool = False) -> Column:
    """Replace known spellings; others are kept, or are an error when ``strict``.

    The dictionary becomes a literal map in the expression, so recoding needs
    neither a join nor a shuffle.
    """
    literal = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(literal, value)
    if not strict:
        return F.coalesce(found, value)
    unknown = F.raise_error(F.concat(F.lit("unknown category: "), value)).cast("string")
    return F.when(found.isNotNull() | value.isNull(), found).otherwise(unknown)


def first_substring(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The result of the first rule whose text occurs, ignoring case; else the value."""
    lowered = F.lower(value)
    needle, result = rules[0]
    chain = F.when(lowered.contains(needle), F.lit(result))
    for needle, result in rules[1:]:
        chain = chain.when(lowered.contains(needle), F.lit(result))
    return chain.otherwise(value)


def truncate_barcode(value: Column, prefix: str = "TCGA") -> Column:
    """Drop the last dash-separated part of identifiers with ``prefix``."""
    return F.when(
        value.startswith(prefix), F.regexp_replace(value, r"-[A-Za-z0-9]+$", "")
    ).otherwise(value)


def strip_suffix(value: Column, suffix: str = "-Tumor") -> Column:
    """Remove a trailing suffix, which is what the clean-up is meant to do."""
    return F.when(
        F.endswith(value, F.lit(suffix)),
        F.substring(value, F.lit(1), F.length(value) - F.lit(len(suffix))),
    ).otherwise(value)


def strip_characters(value: Column, characters: str = "-Tumor", marker: str = "tumor") -> Column:
    """Strip a *set* of characters from both ends of values that contain ``marker``.

    This is the historical behaviour; it also eats leading letters of the set.
    """
    return F.when(
        F.lower(value).contains(marker), F.btrim(value, F.lit(characters))
    ).otherwise(value)


def parse_locus(value: Column) -> dict[str, Column]:
    """``chromosome:start-end`` as three columns; a missing locus is ``'', -1, -1``."""
    pattern = r"^([^:]*):(-?\d+)-(\d+)$"
    known = value.isNotNull() & value.rlike(pattern)

    def part(group: int) -> Column:
        return F.regexp_extract(value, pattern, group)

    return {
        "chromosome": F.when(known, part(1)).otherwise(F.lit("")),
        "start": F.when(known, part(2).try_cast("bigint")).otherwise(F.lit(-1).cast("bigint")),
        "end": F.when(known, part(3).try_cast("bigint")).otherwise(F.lit(-1).cast("bigint")),
    }


def end_by_class(category: Column, start: Column, reference: Column) -> Column:
    """End position from the variant class: deletions span the reference allele."""
    return (
        F.when(category.isin(*fv.DELETION_CLASSES), start + F.length(reference) - 1)
        .when(category.isin(*fv.INSERTION_CLASSES), start + 1)
        .otherwise(start)
    )


def end_by_allele(start: Column, reference: Column, allele: Column) -> Column:
    """End position where a dash marks the absent allele."""
    deleted = F.when(allele == "-", F.length(reference) - 1).otherwise(0)
    inserted = F.when(reference == "-", 1).otherwise(0)
    return start + deleted + inserted


def synthesise_change(
    code: Column,
    position: Column,
    reference_residue: Column,
    residue: Column,
    reference_base: Column,
    base: Column,
) -> Column:
    """A protein change string from an ontology code; null for an unknown code."""
    at = position.cast("string")
    inserted = F.floor(F.greatest(F.length(base) - 1, F.lit(0)) / 3).cast("int")
    deleted = F.floor(F.length(reference_base) / 3).cast("int")
    return (
        F.when(
            code.isin(*fv.REPLACEMENT_CODES),
            F.concat(F.lit("p."), reference_residue, at, residue),
        )
        .when(
            code == fv.INSERTION_CODE,
            F.concat(
                F.lit("p.K"), at, F.lit("_K"), (position + 1).cast("string"),
                F.lit("ins"), F.repeat(F.lit("K"), inserted),
            ),
        )
        .when(
            code == fv.DELETION_CODE,
            F.concat(
                F.lit("p.K"), at, F.lit("_K"), (position + deleted - 1).cast("string"),
                F.lit("del"), F.repeat(F.lit("K"), deleted),
            ),
        )
        .when(code.isin(*fv.FRAME_SHIFT_CODES), F.concat(F.lit("p.K"), at, F.lit("fs*")))
        .when(code.isNull(), F.lit("p.?"))
    )


def fix_change_tokens(value: Column) -> Column:
    """Rewrite ``in_frame_ins`` / ``in_frame_del`` as ``ins`` / ``del``, ignoring case.

    A value with an insertion token keeps any deletion token.
    """
    return F.when(
        F.lower(value).contains("in_frame_ins"),
        F.regexp_replace(value, "(?i)in_frame_ins", "ins"),
    ).otherwise(F.regexp_replace(value, "(?i)in_frame_del", "del"))


def chromosome_name(value: Column) -> Column:
    return F.concat(F.lit("chr"), recode(value, fv.CHROMOSOME_NAMES))


def anchored_alleles(
    reference: Column, allele: Column, category: Column | None = None
) -> tuple[Column, Column]:
    """Both alleles with an anchor base in front when the variant is an indel."""
    indel = reference.contains("-") | allele.contains("-")
    if category is not None:
        indel = indel | category.isin("INS", "DEL")

    def anchored(value: Column) -> Column:
        return F.when(
            indel, F.concat(F.lit("A"), F.replace(value, F.lit("-"), F.lit("")))
        ).otherwise(value)

    return anchored(reference), anchored(allele)


def is_coding(category: Column, excluded: Sequence[str] = fv.NONCODING_CLASSES) -> Column:
    """True unless the class is excluded or names an untranslated region; null is kept."""
    return F.coalesce(~category.isin(*excluded) & ~category.rlike(fv.UNTRANSLATED), F.lit(True))


def is_placed(column: Column) -> Column:
    """True unless the column says that its value is unknown; null is kept."""
    return F.coalesce(column != "Unknown", F.lit(True))


def status_allowed(status: Column, use_unknown: bool = False) -> Column:
    """Somatic status without germline, and without unknown unless asked for."""
    lowered = F.lower(status)
    allowed = ~lowered.contains("germline")
    return allowed if use_unknown else allowed & ~lowered.contains("unknown")


def is_informative(protein: Column, dna: Column, status: Column) -> Column:
    """Both changes given, not both unknown, and a known somatic status."""
    given = (protein != "") & (dna != "")
    unknown_both = (protein == "p.?") & (dna == "c.?")
    return given & ~unknown_both & ~F.lower(status).contains("unknown")
