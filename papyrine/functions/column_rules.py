"""Families of columns by their names.

Fixed values: patterns, labels and their order in this module must be as they are for the same results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.rule_tables import Rules
from papyrine.functions.text import SPACE, strip

# Patterns of a name in lower case, with one underscore for dashes, blanks and underscores; the first family that fits counts.
COLUMN_FAMILIES: Rules = (
    ("gene", (
        r"^gene$", r"^gene[_ ]?id$", r"^gene[_ ]?name$", r"^gene[_ ]?symbol$",
        r"^locus$", r"^locus[_ ]?tag$", r"^transcript$", r"^transcript[_ ]?id$",
        r"^symbol$", r"^orf$", r"^gene[_ ]?list$", r"^gene[_ ]?accession$",
    )),
    ("protein", (
        r"^protein$", r"^protein[_ ]?id$", r"^accession$", r"^uniprot$",
        r"^peptide$", r"^protein[_ ]?name$", r"^protein[_ ]?accession$",
    )),
    ("compound", (
        r"^compound$", r"^metabolite$", r"^chemical$", r"^molecule$",
        r"^drug$", r"^inhibitor$", r"^activator$", r"^substrate$",
    )),
    ("treatment", (
        r"^treatment$", r"^condition$", r"^group$", r"^sample$", r"^sample[_ ]?id$",
        r"^tissue$", r"^stage$", r"^time[_ ]?point$", r"^dose$", r"^concentration$",
    )),
    ("sample", (
        r"^strain$", r"^isolate$", r"^species$", r"^organism$", r"^cell[_ ]?line$",
        r"^cell[_ ]?type$", r"^specimen$", r"^source$", r"^collection$", r"^origin$",
    )),
    ("phenotype", (
        r"^phenotype$", r"^morpholog", r"^trait$", r"^characteristic$",
        r"^symptom$", r"^disease$", r"^severity$", r"^outcome$",
    )),
    ("statistical_value", (
        r"^fc$", r"^fold[_ ]?change$", r"^log2fc$", r"^log[_ ]?2[_ ]?fc$",
        r"^expression$", r"^expr$", r"^count$", r"^tpm$", r"^fpkm$", r"^rpkm$",
        r"^intensity$", r"^abundance$", r"^concentration$",
        r"^lc[_ ]?50$", r"^ld[_ ]?50$", r"^ic[_ ]?50$", r"^ec[_ ]?50$",
        r"^mortality$", r"^survival$", r"^inhibition$", r"^activity$",
        r"^p[\-_ ]?value$", r"^pvalue$", r"^padj$", r"^q[\-_ ]?value$", r"^qvalue$",
        r"^fdr$", r"^adj[_ ]?p", r"^significance$",
        r"^slope$", r"^se$", r"^std[_ ]?err", r"^ci$", r"^odds[_ ]?ratio$",
        r"^ratio$", r"^percent", r"^percentage$", r"^rate$", r"^score$",
    )),
)
BOM = "﻿"


def plain_name(name: Column) -> Column:
    """A column's name as the patterns read it."""
    joined = F.regexp_replace(F.lower(strip(name)), f"(?:[_-]|{SPACE})+", "_")
    return F.ltrim(F.btrim(joined, F.lit("_")), F.lit(BOM))


def column_family(name: Column, rules: Rules = COLUMN_FAMILIES) -> Column:
    """Family of a column by its name, ``unknown`` without one; a null name is unknown."""
    plain = plain_name(F.coalesce(name, F.lit("")))
    family: Column = F.lit("unknown")
    for label, patterns in reversed(rules):
        family = F.when(plain.rlike("|".join(f"(?:{p})" for p in patterns)), label).otherwise(family)
    return family
