"""Rule tables of evidence extraction, question routing and table statistics.

Fixed values: patterns, keywords, labels and their order in this module must be as they are for the same results.
"""

from __future__ import annotations

from papyrine.functions.rule_tables import Rules

# Headings of the sections of a paper; patterns are searched regardless of case, the first section that fits is taken.
SECTIONS: Rules = (
    ("abstract", (r"\babstract\b",)),
    ("introduction", (r"\bintroduction\b", r"\bbackground\b")),
    ("methods", (r"\bmethods?\b", r"\bmaterials?\s+(?:and|&)\s+methods?\b", r"\bexperimental\s+(?:procedures?|design|setup|section)\b", r"\bmethodology\b", r"\bstudy\s+design\b", r"\bdata\s+analysis\b", r"\bstatistical\s+analysis\b", r"\bexperimental\s+procedures?\b")),
    ("results", (r"\bresults?\b", r"\bfindings?\b", r"\bexperimental\s+results?\b", r"\bobservations?\b", r"\bresults?\s+(?:and|&)\s+discussion\b")),
    ("discussion", (r"\bdiscussion\b", r"\bresults?\s+(?:and|&)\s+discussion\b", r"\bgeneral\s+discussion\b", r"\bconclusions?\s+(?:and|&)\s+discussion\b")),
    ("conclusion", (r"\bconclusions?\b", r"\bconcluding\s+remarks?\b", r"\bsummary\b", r"\bconclusions?\s+(?:and|&)\s+(?:future\s+)?(?:directions?|perspectives?|outlook)\b")),
)
COMBINED = "results_and_discussion"

# Words of a sentence that reports a result, and words that give its direction.
RESULT_WORDS = (
    "show", "showed", "shown", "shows", "find", "found", "finding", "observe", "observed", "observation", "demonstrate",
    "demonstrated", "reveal", "revealed", "indicate", "indicated", "suggest", "suggested", "confirm", "confirmed", "identify",
    "identified", "detect", "detected", "discover", "discovered", "report", "reported",
)
DIRECTIONS: Rules = (
    ("increase", ("increased", "increase", "elevated", "higher", "greater", "enhanced", "upregulated", "up-regulated")),
    ("decrease", ("decreased", "decrease", "reduced", "lower", "diminished", "downregulated", "down-regulated", "suppressed")),
    ("no_change", ("no difference", "not significantly", "no significant", "similar", "comparable", "unchanged")),
    ("association", ("associated", "correlated", "linked")),
    ("no_association", ("no association", "not associated", "not correlated")),
)

# Phrases of an author's conclusion, searched regardless of case.
CONCLUDING = (
    r"\b(?:in conclusion|in summary|taken together|overall|collectively|altogether|these results|these findings|our results|our findings|this study|the present study)\b",
    r"\b(?:we conclude|we propose|we demonstrate|we show|we have shown|we found|our data)\b",
    r"\b(?:the results demonstrate|the results show|the findings suggest|these data)\b",
)

# Method terms, the word fragments that give a term's type, and phrases around a method.
METHOD_TERMS = (
    "assay", "analysis", "sequencing", "microscopy", "imaging", "structure", "structural analysis", "crystallography", "cryo-em",
    "cryo em", "modeling", "simulation", "docking", "profiling", "transcriptomics", "proteomics", "metabolomics", "screen",
    "screening", "survey", "comparison", "validation", "experiment", "expression", "purification", "binding", "culture",
    "bioassay", "electrophoresis", "western blot", "western blotting", "qpcr", "quantitative pcr", "pcr", "rna-seq",
    "rna sequencing", "lc-ms", "lc ms", "mass spectrometry", "statistical analysis", "phylogenetic analysis", "phylogeny",
    "genome sequencing", "genomic", "genomics", "mutagenesis", "knockout", "knockdown", "overexpression", "pull-down", "co-ip",
    "co immunoprecipitation", "elisa", "immunofluorescence", "flow cytometry", "diet-overlay", "leaf-disk", "feeding",
    "injection", "bioinformatics", "chromatography", "spectroscopy", "nmr", "electron microscopy", "recombinant",
    "heterologous expression", "cloning", "site-directed mutagenesis", "alanine scanning", "surface plasmon resonance", "spr",
    "isothermal titration calorimetry", "itc",
)
METHOD_TYPES: Rules = (
    ("sequencing", ("sequencing", "seq", "genom")),
    ("microscopy", ("microscop", "imaging", "cryo", "em ", "crystall")),
    ("computational", ("model", "simulat", "dock", "bioinform")),
    ("statistical", ("statistic", "phylogen")),
    ("assay", ("assay", "elisa", "blot", "pcr", "qpcr", "electrophor")),
    ("biochemical", ("spectro", "nmr", "chromatograph", "lc-ms", "mass spec")),
    ("genetic", ("mutagen", "knockout", "knockdown", "overexpress", "cloning", "recomb")),
)
METHOD_PHRASES = (
    r"(\w+(?:\s+\w+){0,8})\s+(?:was|were)\s+(?:used|performed|conducted|carried\s+out|applied|employed|utilized|executed)",
    r"(?:using|via|by)\s+(\w+(?:\s+\w+){0,5}(?:\s+(?:assay|analysis|method|technique|approach|protocol|procedure|system)))",
    r"(?:performed|conducted|carried\s+out)\s+(?:using|with|by)\s+(\w+(?:\s+\w+){0,6})",
    r"(?:measured|quantified|determined|assessed|evaluated|examined)\s+(?:using|via|by|with)\s+(\w+(?:\s+\w+){0,6})",
)
# Words of which a text holds one where the phrase at the same place is met.
METHOD_PHRASE_WORDS = (
    ("was", "were"),
    ("assay", "analysis", "method", "technique", "approach", "protocol", "procedure", "system"),
    ("performed", "conducted", "carried"),
    ("measured", "quantified", "determined", "assessed", "evaluated", "examined"),
)

# Phrases of a method text that says nothing, and words of one that does.
GENERIC_METHODS = (
    "using the approach", "using this method", "this method", "the approach", "leaves were used", "japonica were used",
    "samples were used", "was used", "were used", "using a method", "using the methods", "the method described",
    "as described previously", "performed as described", "according to the manufacturer", "using the same method",
    "the same approach", "using this approach", "as described above", "as previously described", "carried out as described",
    "following the protocol", "using standard protocols", "conventional methods", "standard methods were", "routine methods",
    "according to standard", "as recommended by", "following the method", "the procedure described", "the protocol described",
    "as reported previously",
)
SPECIFIC_METHODS = (
    "pcr", "qpcr", "rt-qpcr", "rna-seq", "rnaseq", "transcriptom", "proteomics", "western blot", "sds-page", "sds page", "elisa",
    "binding assay", "ligand blot", "competition assay", "bioassay", "lc50", "ld50", "mortality assay", "toxicity assay",
    "crispr", "rnai", "cloning", "expression", "purification", "microscopy", "confocal", "immunofluorescence",
    "immunohistochemistry", "phylogenetic", "sequence alignment", "molecular docking", "cryo-em", "cryo em",
    "structure modeling", "homology modeling", "statistical analysis", "regression", "anova", "t-test",
    "surface plasmon resonance", "spr", "mass spectrometry", "chromatography", "hplc", "flow cytometry", "fac",
    "electrophoresis", "blot", "hybridization", "site-directed mutagenesis", "mutagenesis", "knockout", "knockdown",
    "recombinant", "heterologous expression", "transformation", "sequencing", "genotyping", "phenotyping", "diet overlay",
    "leaf disc", "feeding assay", "diet incorporation", "field trial", "greenhouse", "field-collected", "lab colony",
)

# Questions outside the collection: a word of the first list and none of the second.
OUT_OF_SCOPE = (
    "weather", "world cup", "poem", "song", "recipe", "joke", "stock price", "election", "president", "movie", "celebrity",
    "sports", "football", "basketball", "crypto", "bitcoin",
)
IN_SCOPE = (
    "vip3", "cry", "toxin", "insect", "protein", "bt ", "bacillus", "receptor", "binding", "resistance", "method", "assay",
    "paper", "evidence", "study", "research", "gene", "cell", "larvae",
)

# Intents of the literature agent: words, tried in order before and after the two intents on named entities.
LITERATURE_INTENTS: Rules = (
    ("search_by_species", ("species", "spodoptera", "helicoverpa", "heliothis", "mythimna", "insect", "larvae", "lepidopteran")),
    ("search_by_toxin", ("toxin", "vip3", "cry1", "cry ", "insecticidal protein", "bt toxin", "vip", "crystal protein")),
    ("method_query", ("what methods are commonly", "find evidence related to", "which papers mention", "what bioassay methods", "what experimental methods", "what techniques are", "what assays are", "methods are commonly used", "methods are used in this", "how to measure", "protein expression", "binding assay")),
    ("result_query", ("which results are", "what results are", "what experimental outcomes", "what findings are", "what effects are", "what are the main results", "frequently reported", "repeatedly observed", "outcomes are described", "findings are repeatedly", "what conclusions are supported by")),
    ("search_by_method", ("rna-seq", "spr", "how to", "how are", "method ", "methods ", "protocol", "technique", "assay", "bioassay")),
    ("search_by_mechanism", ("mechanism", "mode of action", "pathway", "resistance", "binding", "receptor", "domain", "processing", "activation", "synergy", "toxicity", "apoptosis")),
    ("research_gap_query", ("research gap", "knowledge gap", "missing evidence", "missing data", "unresolved", "still needed", "remain unanswered", "insufficient evidence", "future work", "remains to be determined", "what gaps", "what evidence is missing", "what remains", "what experiments are still", "limitations are repeatedly", "mechanisms are unclear", "gap", "gaps")),
    ("claim_query", ("claim", "claims", "conclusion", "conclusions", "stronger evidence", "weak evidence", "weakly supported", "need validation", "unsupported", "indirect evidence", "lack direct evidence", "drawn across papers", "supported only indirectly", "need stronger", "lack sufficient", "which claims", "what claims")),
)
LATE_INTENTS: Rules = (("search_by_year", ("year", "recent", "latest", "new", "202")),)
COMPARING = ("compare", "across papers", "across supplementary", "all records", "all supplementary records", "consistent direction", "across imported", "show all", "which papers contain")

# Names of entities in a question, words that are none, and what makes it a question on supplementary data.
ENTITY_NAME = r"\b[A-Z][A-Z0-9]{1,15}(?:_[A-Z][A-Z0-9]{1,15})*\b|\b[A-Z][a-z]{2,15}[A-Z0-9][A-Za-z0-9]*\b|\b[a-z][a-z0-9]{1,8}[0-9]+[a-z0-9]*\b"
NOT_ENTITIES = (
    "is", "are", "was", "were", "the", "a", "an", "in", "on", "at", "to",
    "of", "for", "with", "by", "from", "as", "or", "and", "not", "no",
    "it", "its", "be", "has", "have", "had", "do", "does", "did",
    "this", "that", "these", "those", "what", "which", "who", "where",
    "when", "how", "why", "can", "could", "may", "might", "will",
    "would", "should", "shall", "Table", "Tables", "Figure", "Figures",
    "Supplementary", "Supplement", "Data", "Dataset", "File", "Files",
    "Sheet", "Row", "Column", "Gene", "Protein", "Compound", "Entity",
    "Found", "Find", "Search", "Query", "Result", "Results", "Present",
    "Contains", "Contain", "FC", "Expression", "Log2FC", "LogFC",
    "Does", "Where", "What", "Which", "Are", "Is", "Any", "Some",
)
SUPPLEMENT_WORDS = (
    "supplementary", "supplement", "supplemental", "suppl", "table s", "table_s", "supplementary table", "supplementary data",
    "supplementary file", "supplementary dataset",
)
ENTITY_KINDS: Rules = (
    ("gene", ("gene", "genes", "gene symbol", "gene name", "gene id", "locus")),
    ("protein", ("protein", "proteins", "peptide", "accession", "uniprot")),
    ("compound", ("compound", "metabolite", "chemical", "molecule")),
    ("treatment", ("treatment", "condition", "dose", "concentration")),
)
ENTITY_WORDS = tuple(word for _, words in ENTITY_KINDS for word in words)
PLACE_PHRASES = (
    r"where\s+is\s+\w+\s+found",
    r"is\s+\w+\s+present\s+in",
    r"find\s+\w+\s+in\s+\w+\s+(?:table|file|supplement)",
    r"which\s+(?:supplementary\s+)?table\s+contains",
    r"what\s+(?:supplementary\s+)?(?:data|file|table)\s+contains",
    r"does\s+\w+\s+appear\s+in",
    r"what\s+are\s+the\s+(?:fc|p.value|expression|log2fc|lc50|ld50)",
    r"in\s+(?:supplementary|supplemental)\s+(?:file|data|table)",
)

# Statistical fields of a table: (field, category, words of a header after _ - . became spaces).
STAT_FIELDS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("p_value", "significance", ("p value", "p-value", "pvalue", "p val", "p_val", "raw p", "unadjusted p")),
    ("adjusted_p_value", "significance", ("padj", "p adj", "p_adj", "adjusted p", "adjusted p-value", "fdr adjusted p", "bonferroni", "bh adjusted")),
    ("q_value", "significance", ("q value", "q-value", "qvalue", "q val", "storey q")),
    ("fdr", "significance", ("fdr", "false discovery rate", "bh fdr")),
    ("log2FC", "effect_size", ("log2fc", "log2 fc", "log2 fold", "logfc", "log fc", "l2fc", "log2(fc)", "log2 fold change")),
    ("fold_change", "effect_size", ("fold change", "fc", "fold-change", "foldchange", "fold enrichment", "ratio")),
    ("mean", "descriptive", ("mean", "average", "avg", "arithmetic mean", "geometric mean")),
    ("sd", "descriptive", ("sd", "std dev", "standard deviation", "stdev", "std")),
    ("se", "descriptive", ("se", "sem", "std err", "standard error", "std error", "standard error of mean")),
    ("ci", "descriptive", ("ci", "confidence interval", "95% ci", "95% confidence", "lower ci", "upper ci", "lcl", "ucl")),
    ("n", "descriptive", ("n", "sample size", "n per group", "n total", "number", "count", "replicates")),
    ("replicate", "descriptive", ("replicate", "rep", "bio rep", "tech rep", "biological replicate", "technical replicate")),
    ("t_test", "test", ("t test", "t-test", "t statistic", "t stat", "student t", "welch t", "paired t")),
    ("anova", "test", ("anova", "f test", "f-test", "f statistic", "f value", "f ratio", "one-way", "two-way", "kruskal", "friedman")),
    ("correlation", "test", ("correlation", "pearson", "spearman", "kendall", "r value", "r squared", "r2", "rho", "tau", "corr")),
    ("survival", "test", ("survival", "kaplan", "meier", "hazard ratio", "hr", "log rank", "log-rank", "cox", "median survival")),
    ("lc50", "effect_size", ("lc50", "ld50", "ec50", "ic50", "lethal conc", "lethal dose", "effective conc")),
)
P_COLUMNS = ("p value", "p-value", "pvalue", "padj", "fdr", "q value")

# Weight of a hit by the role of its section.
SECTION_WEIGHTS: tuple[tuple[str, float], ...] = (
    ("title", 3.0),
    ("abstract", 2.5),
    ("summary", 2.5),
    ("results", 2.0),
    ("discussion", 2.0),
    ("introduction", 1.0),
    ("methods", 0.5),
    ("references", 0.0),
    ("raw_text", 1.0),
    ("chunks", 0.75),
    ("unknown", 1.0),
)
WEAK_SECTIONS = ("methods", "references")
