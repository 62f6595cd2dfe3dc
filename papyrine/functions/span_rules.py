"""Patterns of places in texts that name figures, tables, data and supplements.

Fixed values: they must be as they are for right results.  All are read regardless of case; the first group is the number.
"""

from __future__ import annotations

Patterns = tuple[tuple[str, str], ...]

#: Mentions by kind, in the order in which longer spans are taken first.
MENTIONS: Patterns = (
    ("figure", r"(?:(?:Supplementary|Suppl\.?|Appendix|App\.?)\s+)?(?:Fig\.?|Figure|FIG\.?|Figs\.?|Figures)\s+(S?\d+(?:[A-Za-z])?(?:[–\-]\d+[A-Za-z]?)?(?:,\s*(?:and\s+)?\d+[A-Za-z]?)*)"),
    ("table", r"(?:(?:Supplementary|Suppl\.?|Appendix|App\.?)\s+)?(?:Table|TAB\.?|Tables)\s+(S?\d+(?:[A-Za-z])?(?:[–\-]\d+[A-Za-z]?)?(?:,\s*(?:and\s+)?\d+[A-Za-z]?)*)"),
    ("dataset", r"(?:(?:Supplementary|Suppl\.?|Appendix|App\.?)\s+)?(?:Data|Dataset|DATASET)\s+(S?\d+(?:[A-Za-z])?)"),
    ("supplementary", r"(?:Supplementary\s+(?:Material|Information|Data|File|Note|Text|Methods|Results|Discussion))|(?:SI\s+Appendix)|(?:Supporting\s+Information)|(?:Additional\s+[Ff]ile\s+\d+)"),
    ("supplementary", r"(?:Appendix|App\.?)\s+([A-Z]\d*)"),
)

#: Labels in a mention, by type and the word that the label begins with.
LABELS: tuple[tuple[str, str, str], ...] = (
    ("figure", "Figure", r"(?:(?:Supplementary|Suppl\.?|Appendix|App\.?)\s+)?(?:Fig\.?|Figs\.?|Figure|Figures|FIG\.?|FIGS\.?)\s+(S?\d+(?:[A-Za-z])?(?:[–\-]\d+[A-Za-z]?)?(?:,\s*(?:and\s+)?\d+[A-Za-z]?)*)"),
    ("table", "Table", r"(?:(?:Supplementary|Suppl\.?|Appendix|App\.?)\s+)?(?:Table|TAB\.?)\s+(S?\d+(?:[A-Za-z])?(?:[–\-]\d+[A-Za-z]?)?(?:,\s*\d+[A-Za-z]?)*)"),
    ("dataset", "Dataset", r"(?:(?:Supplementary|Suppl\.?|Appendix|App\.?)\s+)?(?:Data|Dataset|DATASET)\s+(S?\d+(?:[A-Za-z])?)"),
)
SUPPLEMENT_LABEL = r"(?:Supplementary\s+(?:Material|Information|Data|File|Note|Text|Methods|Results|Discussion))|(?:SI\s+Appendix)|(?:Supporting\s+Information)|(?:Additional\s+[Ff]ile\s+\d+)|(?:(?:Appendix|App\.?)\s+[A-Z]\d*)"
SUPPLEMENT_PREFIX = r"^(?:Supplementary|Suppl\.?|Appendix|App\.?)\s+"

#: References to supplements by type.
SUPPLEMENTS: Patterns = (
    ("supplementary_table", r"(?:Supplementary|Supplemental|Suppl\.?)\s+(?:Table|TABLE)\s+(S?\d+[A-Za-z]?(?:[–\-]\d+[A-Za-z]?)?)"),
    ("table_s_label", r"(?:^|(?<=[\s(]))(?:Table|TABLE)\s+(S\d+[A-Za-z]?(?:[–\-]S?\d+[A-Za-z]?)?)"),
    ("tables_s_range", r"(?:Tables|TABLES)\s+((?:S?\d+[A-Za-z]?(?:[–\-]\d+[A-Za-z]?)?(?:,\s*|\s+and\s+))*S?\d+[A-Za-z]?(?:[–\-]\d+[A-Za-z]?)?)"),
    ("supplementary_data", r"(?:Supplementary|Supplemental|Suppl\.?)\s+(?:Data|Dataset|Data\s+Set)\s+(\d+[A-Za-z]?)"),
    ("additional_file", r"(?:Additional|Additional\s+File|Additional\s+file)\s+(\d+[A-Za-z]?)"),
    ("supporting_info_table", r"Supporting\s+Information\s+(?:Table|Fig\.?|Figure)\s+(S?\d+[A-Za-z]?)"),
    ("supplemental_material", r"(?:Table|Fig\.?|Figure)\s+(S?\d+[A-Za-z]?)\s+in\s+the\s+(?:supplemental|supplementary|supporting)\s+material"),
    ("supplementary_file", r"(?:Supplementary|Supplemental|Suppl\.?)\s+(?:Excel|File|Spreadsheet|Document)\s*(\d+[A-Za-z]?)?"),
    ("supplementary_url", r"https?://[^\s]*suppl[^\s]*\.(?:xlsx|xls|csv|tsv|pdf|zip)"),
)

#: Where captions begin, what they end before, and references where a text has no caption.
CAPTION_STARTS = {
    "figure": r"(?:Supplementary\s+)?(?:Figure|Fig\.?|FIGURE)\s+(S?\d+[A-Za-z]?(?:[–\-]\d+[A-Za-z]?)?)\s*\.",
    "table": r"(?:Supplementary\s+)?(?:Table|TABLE|Tab\.?)\s+(S?\d+[A-Za-z]?(?:[–\-]\d+[A-Za-z]?)?)\s*[.:]",
}
CAPTION_STOPS = {
    "figure": (
        r"\n\s*\n\s*(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5}\s*\n)",
        r"\n\s*(?:REFERENCES|ACKNOWLEDGMENTS|Funding|Conflicts|Author Contributions)\b",
        r"\n\s*(?:Table\s+\d+|Figure\s+\d+|Fig\.?\s+\d+)\.",
        r"\n\s*\d+\.\d+\s*\(",
    ),
    "table": (
        r"\n\s*\n\s*(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5}\s*\n)",
        r"\n\s*(?:REFERENCES|ACKNOWLEDGMENTS|ACKNOWLEDGEMENTS|Funding|Conflicts|Author Contributions|Competing interests|Data Availability|Supplementary Information)\b",
        r"\n\s*(?:Table\s+\d+|TABLE\s+\d+|Tab\.?\s+\d+|Figure\s+\d+|Fig\.?\s+\d+|Supplementary\s+Table\s+\w+|Supplementary\s+Figure\s+\w+)\.",
        r"\n\s*\d+\.\d+\s*\(",
        r"\n\s*(?:Abbreviations|Acronyms|Nomenclature)\b",
        r"\n\s*\*[^*]",
    ),
}
BARE_REFERENCES = {
    "figure": r"(?:Fig\.?|Figure|FIGURE)\s+(\d+[A-Za-z]?(?:[–\-]\d+[A-Za-z]?)?)",
    "table": r"(?:Supplementary\s+)?(?:Tab\.?|Table|TABLE)\s+(S?\d+[A-Za-z]?(?:[–\-]\d+[A-Za-z]?)?)",
}
#: Characters around a mention and a reference, shortest and longest captions and the lengths of their quality.
AROUND_MENTION, AROUND_REFERENCE = 200, 120
LEAST_CAPTION, FAIR_CAPTION, GOOD_CAPTION, MOST_CAPTION = 15, 30, 100, 2500

#: Words of which a text must hold one, in any case, before a fixed pattern can match in it.
NEEDED: dict[str, tuple[str, ...]] = {p: words for (_, p), words in zip((*MENTIONS, *SUPPLEMENTS), (("fig",), ("tab",), ("data",), ("suppl", "appendix", "supporting", "additional"), ("app",), *((w,) for w in ("suppl", "table", "tables", "suppl", "additional", "supporting", "material", "suppl", "suppl"))), strict=True)}
