"""Structure columns of one SDF record held as text (fixed-width V2000 tables)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from descria.functions import smiles

# Layout of the counts line, the atom lines and the bond lines.
HEADER_LINES = 3
COUNT_WIDTH = 3
SYMBOL_START, SYMBOL_WIDTH = 32, 3


def lines(record: Column) -> Column:
    return F.split(F.replace(record, F.lit("\r"), F.lit("")), "\n")


def line_count(record: Column) -> Column:
    return F.length(record) - F.length(F.replace(record, F.lit("\n"), F.lit(""))) + 1


def _counts_line(record: Column) -> Column:
    """Line after the header; empty when the record is too short."""
    upto = F.substring_index(record, "\n", HEADER_LINES + 1)
    return F.when(line_count(record) > HEADER_LINES, F.substring_index(upto, "\n", -1)).otherwise(F.lit(""))


def _count(record: Column, at: int) -> Column:
    return F.trim(F.substring(_counts_line(record), 1 + at * COUNT_WIDTH, COUNT_WIDTH)).try_cast("int")


def atom_count(record: Column) -> Column:
    return _count(record, 0)


def bond_count(record: Column) -> Column:
    return _count(record, 1)


def _table(record: Column, skip: Column, n: Column) -> Column:
    return F.slice(lines(record), skip + HEADER_LINES + 2, F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))


def is_valid(record: Column) -> Column:
    """Readable counts line and as many atom and bond lines as it announces."""
    atoms_n, bonds_n = atom_count(record), bond_count(record)
    enough = line_count(record) >= F.lit(HEADER_LINES + 1) + atoms_n + bonds_n
    return F.coalesce((atoms_n >= 0) & (bonds_n >= 0) & enough, F.lit(False))


def atoms(record: Column) -> Column:
    """Element symbol of every atom line."""
    rows = _table(record, F.lit(0), atom_count(record))
    return F.transform(rows, lambda x: F.trim(F.substring(x, SYMBOL_START, SYMBOL_WIDTH)))


def elements(record: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(atoms(record), lambda x: x != "")))


def bonds(record: Column) -> Column:
    """``array<struct<a, b, order>>``: one-based atom numbers and the bond type."""
    rows = _table(record, F.coalesce(atom_count(record), F.lit(0)), bond_count(record))
    return F.transform(
        rows,
        lambda x: F.struct(
            F.trim(F.substring(x, 1, COUNT_WIDTH)).try_cast("int").alias("a"),
            F.trim(F.substring(x, 1 + COUNT_WIDTH, COUNT_WIDTH)).try_cast("int").alias("b"),
            F.trim(F.substring(x, 1 + 2 * COUNT_WIDTH, COUNT_WIDTH)).try_cast("int").alias("order"),
        ),
    )


def fragments(record: Column) -> Column:
    """Number of connected components: bonds merge the labels of the atoms they join."""
    n = F.coalesce(atom_count(record), F.lit(0))
    start = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def merge(labels: Column, bond: Column) -> Column:
        keep, gone = F.get(labels, bond["a"] - 1), F.get(labels, bond["b"] - 1)
        return F.transform(labels, lambda x: F.when(x == gone, keep).otherwise(x))

    return F.size(F.array_distinct(F.aggregate(bonds(record), start, merge)))


def descriptor_columns(record: Column) -> dict[str, Column]:
    """The constitutional descriptors of a record, under the names used for SMILES."""
    symbols, links = atoms(record), bonds(record)
    heavy = F.size(F.filter(symbols, lambda x: x != "H"))

    def of_order(k: int) -> Column:
        return F.size(F.filter(links, lambda b: b["order"] == k))

    def of_symbol(e: str) -> Column:
        return F.size(F.filter(symbols, lambda x: x == e))

    out = {f"n_{e}": of_symbol(e) for e in smiles.COUNTED}
    out |= {
        "n_heavy": heavy,
        "n_hetero": heavy - of_symbol("C"),
        "n_halogen": F.size(F.filter(symbols, lambda x: x.isin(*smiles.HALOGENS))),
        "n_aromatic": of_order(4),
        "n_rings": F.size(links) - F.size(symbols) + fragments(record),
        "n_bonds": F.size(links),
        "n_double": of_order(2),
        "n_triple": of_order(3),
        "mw": smiles.weight(symbols),
    }
    return {name: c.cast("double") for name, c in out.items()}


def title(record: Column) -> Column:
    return F.trim(F.replace(F.substring_index(record, "\n", 1), F.lit("\r"), F.lit("")))


def tag(record: Column, name: str) -> Column:
    """First value line of a ``> <name>`` data item; NULL when absent."""
    found = F.regexp_extract(record, rf"> *<{name}>[^\n]*\n([^\n\r]*)", 1)
    return F.when(record.rlike(rf"> *<{name}>"), found)
