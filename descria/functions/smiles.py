"""Structure columns derived from SMILES text with built-in expressions only.

This is a lexical reading (tokens, brackets, ring labels), not a chemistry
toolkit: no valence check and no aromaticity perception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols counted as metals by the structure filter.
METALS = (
    "Li", "Be", "Na", "Mg", "Al", "K", "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu",
    "Zn", "Ga", "Ge", "Rb", "Sr", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In",
    "Sn", "Sb", "Cs", "Ba", "La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er",
    "Tm", "Yb", "Lu", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Th",
    "Pa", "U",
)

# Standard atomic weights of the elements common in drug-like compounds.
ATOMIC_WEIGHTS = {
    "H": 1.008, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45,
    "K": 39.098, "Ca": 40.078, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693,
    "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904,
    "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "Sn": 118.71, "Sb": 121.76, "Te": 127.60, "I": 126.90,
    "Pt": 195.08, "Au": 196.97, "Hg": 200.59, "Pb": 207.2, "Bi": 208.98,
}

# Lexical patterns.
TOKEN = r"(\[[^\]]*\]|Cl|Br|[BCNOPSFI]|[bcnops])"
BRACKET_ELEMENT = r"^\[[0-9]*([A-Z][a-z]?|[a-z]{1,2})"
RING_LABEL = r"(%[0-9]{2}|[0-9])"
LEGAL = r"(\[[0-9]*[A-Za-z][^\[\]]*\]|Cl|Br|[BCNOPSFI]|[bcnops]|%[0-9]{2}|[0-9]|[-=#:/\\.()$~])"
NITRO = (
    (r"\[N\+\]\(=O\)\[O-\]", "N(=O)=O"),
    (r"\[N\+\]\(\[O-\]\)=O", "N(=O)=O"),
    (r"O=\[N\+\]\(\[O-\]\)", "O=N(=O)"),
    (r"\[O-\]\[N\+\]\(=O\)", "O=N(=O)"),
)

COUNTED = ("C", "N", "O", "S", "P", "F", "Cl", "Br", "I")
HALOGENS = ("F", "Cl", "Br", "I")
DESCRIPTORS = (
    *[f"n_{e}" for e in COUNTED],
    "n_heavy", "n_hetero", "n_halogen", "n_aromatic", "n_charged",
    "n_rings", "n_bonds", "n_double", "n_triple", "n_branches", "mw",
)


def tokens(s: Column) -> Column:
    """Atom tokens in text order."""
    return F.regexp_extract_all(s, F.lit(TOKEN), F.lit(1))


def _symbol(token: Column) -> Column:
    inner = F.when(token.startswith("["), F.regexp_extract(token, BRACKET_ELEMENT, 1)).otherwise(token)
    return F.initcap(inner)


def atoms(s: Column) -> Column:
    """Element symbol of every atom token; aromatic lower-case symbols are capitalised."""
    return F.filter(F.transform(tokens(s), _symbol), lambda x: x != "")


def elements(s: Column) -> Column:
    """Sorted distinct element symbols."""
    return F.array_sort(F.array_distinct(atoms(s)))


def fragments(s: Column) -> Column:
    """Number of dot-separated components; 0 for empty text."""
    return F.when(F.trim(s) == "", F.lit(0)).otherwise(F.size(F.split(s, r"\.")))


def _occurrences(s: Column, text: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(text), F.lit("")))


def without_brackets(s: Column) -> Column:
    return F.regexp_replace(s, r"\[[^\]]*\]", "")


def ring_labels(s: Column) -> Column:
    return F.regexp_extract_all(without_brackets(s), F.lit(RING_LABEL), F.lit(1))


def _parentheses_nest(s: Column) -> Column:
    steps = F.transform(
        F.regexp_extract_all(s, F.lit(r"([()])"), F.lit(1)), lambda x: F.when(x == "(", 1).otherwise(-1)
    )
    # A negative depth is kept negative, so a closing bracket cannot come first.
    depth = F.aggregate(steps, F.lit(0), lambda acc, x: F.when(acc < 0, acc).otherwise(acc + x))
    return depth == 0


def _rings_close(s: Column) -> Column:
    labels = ring_labels(s)
    return F.forall(F.array_distinct(labels), lambda x: F.size(F.filter(labels, lambda y: y == x)) % 2 == 0)


def is_valid(s: Column) -> Column:
    """Lexically well formed: legal tokens only, nested parentheses, closed rings, at least one atom."""
    ok = (
        (F.regexp_replace(s, LEGAL, "") == "")
        & (F.size(atoms(s)) > 0)
        & _parentheses_nest(s)
        & _rings_close(s)
    )
    return F.coalesce(ok, F.lit(False))


def has_non_metal(symbols: Column) -> Column:
    """Some element is not in the metal list; false for an empty list."""
    return F.size(F.array_except(symbols, F.array(*[F.lit(m) for m in METALS]))) > 0


def passes_standard(s: Column) -> Column:
    """Structure filter: parses, is not made of metals only, is one connected fragment."""
    return F.coalesce(is_valid(s) & has_non_metal(elements(s)) & (fragments(s) == 1), F.lit(False))


def strip_salts(s: Column) -> Column:
    """Component with the most atoms (longest text, then text order, on ties)."""
    ranked = F.transform(
        F.split(s, r"\."),
        lambda x: F.struct(F.size(atoms(x)).alias("a"), F.length(x).alias("n"), x.alias("s")),
    )
    return F.array_max(ranked)["s"]


def normalize_nitro(s: Column) -> Column:
    """Charge-separated nitro groups to the neutral form ``N(=O)=O``."""
    for pattern, plain in NITRO:
        s = F.regexp_replace(s, pattern, plain)
    return s


def weight(symbols: Column) -> Column:
    """Summed weight of the written atoms (implicit hydrogens are not counted)."""
    table = F.create_map(*[F.lit(x) for pair in ATOMIC_WEIGHTS.items() for x in pair])
    return F.aggregate(
        symbols, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(table, x), F.lit(0.0))
    )


def descriptor_columns(s: Column, packed: Column | None = None) -> dict[str, Column]:
    """Constitutional descriptors of one SMILES column, all doubles.

    ``packed`` may carry the atom symbols when they are already computed.
    """
    symbols = atoms(s) if packed is None else packed
    bare = without_brackets(s)

    def count(e: str) -> Column:
        return F.size(F.filter(symbols, lambda x: x == e))

    def among(names: tuple[str, ...]) -> Column:
        return F.size(F.filter(symbols, lambda x: x.isin(*names)))

    heavy = F.size(F.filter(symbols, lambda x: x != "H"))
    rings = F.size(ring_labels(s)) / 2
    aromatic = F.size(F.filter(tokens(s), lambda t: t.rlike(r"^(\[[0-9]*)?[a-z]")))
    out = {f"n_{e}": count(e) for e in COUNTED}
    out |= {
        "n_heavy": heavy,
        "n_hetero": heavy - count("C"),
        "n_halogen": among(HALOGENS),
        "n_aromatic": aromatic,
        "n_charged": F.size(F.filter(tokens(s), lambda t: t.rlike(r"^\[.*[+-]"))),
        "n_rings": rings,
        "n_bonds": F.size(symbols) - fragments(s) + rings,
        "n_double": _occurrences(bare, "="),
        "n_triple": _occurrences(bare, "#"),
        "n_branches": _occurrences(bare, "("),
        "mw": weight(symbols),
    }
    return {name: out[name].cast("double") for name in DESCRIPTORS}
