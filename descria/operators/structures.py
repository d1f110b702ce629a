"""Compound tables: structure filter, descriptors, class union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.columns import quoted, require_columns
from descria.functions import sdf, smiles
from descria.functions.numeric import signed_log
from descria.operators.align import zip_join

SMILES, RECORD = "SMILES", "record"


def structure_flags(compounds: DataFrame, column: str = SMILES) -> DataFrame:
    """Add ``elements``, ``fragments`` and ``is_valid`` of a SMILES column."""
    s = quoted(column)
    require_columns(compounds, [column])
    return compounds.withColumns(
        {"elements": smiles.elements(s), "fragments": smiles.fragments(s), "is_valid": smiles.is_valid(s)}
    )


def sdf_flags(records: DataFrame) -> DataFrame:
    """Add ``elements``, ``fragments``, ``n_atoms`` and ``n_bonds`` of SDF records."""
    r = F.col(RECORD)
    return records.withColumns(
        {
            "elements": sdf.elements(r),
            "fragments": sdf.fragments(r),
            "n_atoms": F.coalesce(sdf.atom_count(r), F.lit(0)),
            "n_bonds": F.coalesce(sdf.bond_count(r), F.lit(0)),
        }
    )


def keep_condition(compounds: DataFrame) -> Column:
    """Structure filter for whichever structure column the table has."""
    if RECORD in compounds.columns:
        r = F.col(RECORD)
        from_record = sdf.is_valid(r) & smiles.has_non_metal(sdf.elements(r)) & (sdf.fragments(r) == 1)
        if SMILES not in compounds.columns:
            return from_record
        return F.when(F.col(RECORD).isNotNull(), from_record).otherwise(smiles.passes_standard(F.col(SMILES)))
    require_columns(compounds, [SMILES])
    return smiles.passes_standard(F.col(SMILES))


def standardize_filter(compounds: DataFrame) -> DataFrame:
    """Drop unreadable, metal-only and multi-fragment compounds. A stateless row filter."""
    return compounds.filter(keep_condition(compounds))


def standardize_report(compounds: DataFrame, *by: str) -> DataFrame:
    """``(kept, removed)`` counts, optionally per group."""
    flagged = compounds.select(*[quoted(c) for c in by], keep_condition(compounds).alias("k"))
    return flagged.groupBy(*by).agg(F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("removed"))


def constitutional_descriptors(
    compounds: DataFrame, remove_salt: bool = True, standardize_nitro: bool = True, log: bool = False
) -> DataFrame:
    """Input columns plus one double column per constitutional descriptor.

    The structure text can be cleaned first; ``log`` replaces every descriptor by
    its signed logarithm.
    """
    if RECORD in compounds.columns:
        columns = sdf.descriptor_columns(F.col(RECORD))
        base = compounds
    else:
        require_columns(compounds, [SMILES])
        s = F.col(SMILES)
        s = smiles.normalize_nitro(s) if standardize_nitro else s
        s = smiles.strip_salts(s) if remove_salt else s
        base = compounds.withColumn("__s", s).withColumn("__a", smiles.atoms(F.col("__s")))
        columns = smiles.descriptor_columns(F.col("__s"), F.col("__a"))
    if log:
        columns = {n: signed_log(c) for n, c in columns.items()}
    return base.withColumns(columns).drop("__s", "__a")


def union_labelled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Positive rows labelled 1, then negative rows labelled 0; columns are united, ``Label`` is last."""
    both = positive.withColumn("Label", F.lit(1)).unionByName(
        negative.withColumn("Label", F.lit(0)), allowMissingColumns=True
    )
    return both.select(*[quoted(c) for c in both.columns if c != "Label"], "Label")


def zip_descriptors(identifiers: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Paste identifier columns next to descriptors computed elsewhere.

    Both carry ``row_idx``; different lengths are an error; ``Name`` is dropped.
    """
    return zip_join(identifiers, descriptors.drop("Name"))


def descriptor_log(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: signed_log(quoted(f)) for f in features})
