"""Elements and amino acids as dimension tables: numbers, symbols, covalent radii, residue letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Covalent radii in angstrom, by atomic number from 1.
RADII = """H 0.32 He 0.93 Li 1.23 Be 0.90 B 0.82 C 0.77 N 0.75 O 0.73 F 0.72 Ne 0.71 Na 1.54 Mg 1.36 Al 1.18 Si 1.11 P 1.06 S 1.02 Cl 0.99 Ar 0.98
K 2.03 Ca 1.74 Sc 1.44 Ti 1.32 V 1.22 Cr 1.18 Mn 1.17 Fe 1.17 Co 1.16 Ni 1.15 Cu 1.17 Zn 1.25 Ga 1.26 Ge 1.22 As 1.20 Se 1.16 Br 1.14 Kr 1.12
Rb 2.16 Sr 1.91 Y 1.62 Zr 1.45 Nb 1.34 Mo 1.30 Tc 1.27 Ru 1.25 Rh 1.25 Pd 1.28 Ag 1.34 Cd 1.48 In 1.44 Sn 1.41 Sb 1.40 Te 1.36 I 1.33 Xe 1.31
Cs 2.35 Ba 1.98 La 1.69 Ce 1.65 Pr 1.65 Nd 1.64 Pm 1.63 Sm 1.62 Eu 1.85 Gd 1.61 Tb 1.59 Dy 1.59 Ho 1.58 Er 1.57 Tm 1.56 Yb 1.74 Lu 1.56
Hf 1.44 Ta 1.34 W 1.30 Re 1.28 Os 1.26 Ir 1.27 Pt 1.30 Au 1.34 Hg 1.49 Tl 1.48 Pb 1.47 Bi 1.46 Po 1.46 At 1.45 Rn 1.50
Fr 2.60 Ra 2.21 Ac 2.15 Th 2.06 Pa 2.00 U 1.96 Np 1.90 Pu 1.87 Am 1.80 Cm 1.69"""
#: Residues by number from 0, and their letters.
RESIDUES = "UNK ? ALA A ASX B CYS C ASP D GLU E PHE F GLY G HIS H ILE I LYS K LEU L MET M ASN N PRO P GLN Q ARG R SER S THR T VAL V TRP W TYR Y GLX Z"


def elements(spark: SparkSession) -> DataFrame:
    """number, symbol, covalent_radius."""
    w = RADII.split()
    return spark.createDataFrame([(k + 1, s, float(r)) for k, (s, r) in enumerate(zip(w[::2], w[1::2]))], "number int, symbol string, covalent_radius double")


def residues(spark: SparkSession) -> DataFrame:
    """number, residue, letter."""
    w = RESIDUES.split()
    return spark.createDataFrame([(k, r, a) for k, (r, a) in enumerate(zip(w[::2], w[1::2]))], "number int, residue string, letter string")


def with_elements(atoms: DataFrame, element: str = "element", unknown: float = 0.1) -> DataFrame:
    """atoms with number (0 for an unknown symbol, whatever its case) and covalent_radius; the table of elements is sent everywhere (96 rows)."""
    e = elements(atoms.sparkSession).withColumnRenamed("symbol", "_symbol")
    return atoms.join(F.broadcast(e), F.initcap(element) == F.col("_symbol"), "left").drop("_symbol").withColumns({"number": F.coalesce("number", F.lit(0)), "covalent_radius": F.coalesce("covalent_radius", F.lit(unknown))})


def with_residues(atoms: DataFrame, residue: str = "restype") -> DataFrame:
    """atoms with residue_number and letter; unknown names are number 0."""
    r = residues(atoms.sparkSession).select(F.col("residue").alias("_name"), F.col("number").alias("residue_number"), "letter")
    return atoms.join(F.broadcast(r), F.upper(residue) == F.col("_name"), "left").drop("_name").withColumns({"residue_number": F.coalesce("residue_number", F.lit(0)), "letter": F.coalesce("letter", F.lit("?"))})
