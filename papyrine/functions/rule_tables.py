"""Rule tables of the classifiers and rubrics.

Fixed values: patterns, keywords, weights and labels in this module must be as they are for the same results.
"""

from __future__ import annotations

Rules = tuple[tuple[str, tuple[str, ...]], ...]

# Question intents of the search over all assets; patterns are searched in lower-case text.
QUERY_INTENTS: Rules = (
    ("claim_support_search", (r"which\s+(?:evidence|figure|table|data)\s+support", r"support(?:s|ing|ed)?\s+(?:evidence|data)", r"evidence\s+(?:for|of|supporting)", r"what\s+(?:evidence|data)\s+support", r"claim.*support", r"support.*claim")),
    ("figure_search", (r"figure", r"fig\.?\s", r"image", r"micrograph", r"western blot image", r"microscopy image", r"photomicrograph", r"panel")),
    ("table_search", (r"table", r"tabular", r"spreadsheet", r"\.xlsx", r"\.csv", r"column", r"row", r"header")),
    ("supplementary_search", (r"supplementary", r"supplement", r"supporting information", r"appendix", r"additional file", r"suppl")),
    ("entity_search", (r"gene\b", r"protein\b", r"receptor\b", r"toxin\b", r"enzyme\b", r"species\b", r"strain\b", r"compound\b", r"chemical\b", r"pathway\b", r"kinase\b", r"transcription factor")),
    ("method_search", (r"method", r"protocol", r"procedure", r"technique", r"assay\b", r"pcr\b", r"blot", r"sequencing", r"how\s+(?:was|is|were|are)\s+(?:measured|determined|detected)")),
    ("gap_search", (r"gap", r"knowledge gap", r"unknown", r"unclear", r"not known", r"remains?\s+(?:to be|unclear)", r"further\s+(?:research|study|investigation)")),
    ("hypothesis_search", (r"hypothesis", r"hypothes[ie]s", r"proposed mechanism", r"predicted", r"might be", r"could be", r"may be")),
    ("graph_neighborhood_search", (r"related to", r"connected to", r"linked to", r"neighbor(?:s|hood)?", r"graph")),
    ("bioassay_search", (r"lc50", r"ld50", r"ec50", r"ic50", r"bioassay", r"mortality", r"toxicity", r"dose.response")),
    ("expression_search", (r"expression", r"upregulat", r"downregulat", r"transcript", r"fpkm", r"rpkm", r"tpm", r"rna.seq", r"qpcr", r"rt.pcr")),
)

# Intents of the research agent, and the tools that each intent calls, in order.
AGENT_INTENTS: Rules = (
    ("dataset_question", (r"dataset", r"\.csv", r"\.xlsx", r"\.tsv", r"data file", r"data table", r"appear.*data", r"contain.*gene")),
    ("entity_comparison_question", (r"which paper", r"across paper", r"compare", r"comparison", r"different paper", r"appear.*in which")),
    ("claim_support_question", (r"which claim", r"weakly support", r"strongly support", r"evidence.*support", r"support.*claim", r"what.*support")),
    ("figure_table_question", (r"figure", r"table", r"fig\.", r"fig ", r"chart", r"plot", r"graph", r"image")),
    ("supplementary_question", (r"supplementary", r"supplement", r"appendix", r"supporting information")),
    ("gap_question", (r"gap", r"knowledge gap", r"unknown", r"unclear", r"not known", r"missing evidence")),
    ("hypothesis_question", (r"hypothesis", r"hypotheses", r"proposed", r"might be", r"could be", r"potential mechanism")),
    ("research_plan_generation", (r"research plan", r"next step", r"experiment.*design", r"what.*next", r"further study", r"generate.*plan", r"what should.*do")),
    ("method_comparison", (r"method", r"protocol", r"technique", r"assay compare", r"different method")),
    ("literature_question", (r"what is", r"how does", r"mechanism", r"function", r"role", r"describe", r"explain")),
    ("opportunity_question", (r"opportunit", r"future research", r"promising", r"potential.*research")),
)
TOOL_PLANS: Rules = (
    ("dataset_question", ("dataset_query", "cross_asset_query")),
    ("entity_comparison_question", ("dataset_entity_compare", "cross_asset_query")),
    ("claim_support_question", ("unified_graph_query", "cross_asset_query")),
    ("figure_table_question", ("cross_asset_query",)),
    ("supplementary_question", ("cross_asset_query",)),
    ("gap_question", ("gap_search", "unified_graph_query")),
    ("hypothesis_question", ("hypothesis_search", "unified_graph_query", "cross_asset_query")),
    ("research_plan_generation", ("gap_search", "hypothesis_search", "opportunity_search", "unified_graph_query", "cross_asset_query", "dataset_query")),
    ("method_comparison", ("cross_asset_query", "unified_graph_query")),
    ("literature_question", ("cross_asset_query", "unified_graph_query")),
    ("opportunity_question", ("opportunity_search", "unified_graph_query")),
    ("unknown", ("cross_asset_query",)),
)

# Dataset types; keywords are searched in headers, caption and cells with _ - . as spaces.
DATASET_TYPES: Rules = (
    ("differential_expression", ("log2fc", "logfc", "padj", "pvalue", "fdr", "baseMean", "lfcse", "stat")),
    ("gene_expression", ("fpkm", "rpkm", "tpm", "counts", "gene symbol", "gene id", "expression")),
    ("proteomics", ("protein", "peptide", "accession", "uniprot", "intensity", "spectral count")),
    ("pathway_enrichment", ("pathway", "go term", "kegg", "enrichment score", "gene ratio", "nes")),
    ("sample_metadata", ("sample id", "treatment", "condition", "group", "replicate", "tissue", "cell line")),
    ("primer_table", ("primer", "sequence", "forward", "reverse", "product size", "amplicon", "tm")),
    ("strain_table", ("strain", "isolate", "genotype", "serotype", "biotype")),
    ("phenotype_table", ("phenotype", "mortality", "growth", "weight", "length", "score", "disease index")),
    ("bioassay", ("mortality", "corrected mortality", "total", "dead", "alive", "inhibition")),
    ("lc50", ("lc50", "ld50", "ec50", "ic50", "95% ci", "lethal concentration")),
    ("mortality", ("mortality", "dead", "alive", "survival rate", "mortality rate")),
    ("survival", ("survival", "kaplan", "meier", "hazard ratio", "time", "event", "censored")),
    ("binding_assay", ("kd", "binding affinity", "spr", "itc", "pull-down", "co-ip")),
    ("statistical_result", ("p value", "statistic", "t-test", "anova", "correlation", "effect size")),
    ("taxonomy", ("phylum", "class", "order", "family", "genus", "species", "otu", "16s", "its")),
    ("method_parameters", ("parameter", "value", "setting", "instrument", "column", "gradient", "temperature")),
    ("source_data", ("source data", "raw data", "underlying data", "data behind")),
    ("supplementary_index", ("supplementary", "table s", "figure s", "file name", "description")),
)

# Roles of a section by its heading, in order; sources of these names are their own role.
OWN_ROLES = ("title", "abstract", "summary", "chunks")
SECTION_ROLES: Rules = (
    ("references", (r"\b(reference|references|bibliography|literature cited)\b",)),
    ("results", (r"\b(result|results)\b",)),
    ("discussion", (r"\b(discussion|conclusion|conclusions|summary)\b",)),
    ("results", ("analysis of binding", "binding to pm proteins", "homologous competition", "heterologous competition")),
    ("methods", ("method", "methods", "material", "materials", "preparation", "purification", "expression", "cloning", "assay", "assays", "radiolabeling", "immunohistochemical", "source of", "bbmv preparation", "rearing", "strain", "culture", "sample", "protocol")),
    ("introduction", ("introduction", "background", "untitled")),
)

# Relation of a mention to the asset it names, by words of the sentence and what goes before, in order.
RELATIONS: Rules = (
    ("method_detail", ("method", "protocol", "procedure", "detailed in", "described in", "see supplementary", "see si")),
    ("reports_data", ("data shown", "data presented", "summarizes", "reports", "lists", "provides", "contains", "dataset")),
    ("illustrates", ("shown in", "illustrated", "depicted", "presented in", "see figure", "see fig", "plotted", "visualized")),
    ("supports", ("support", "confirm", "validate", "consistent with", "demonstrate", "reveal", "indicate", "suggest")),
)

# Gap rubric: weights of evidence, specificity and novelty; novelty by type, all others 0.6.
GAP_WEIGHTS = (0.40, 0.35, 0.25)
GAP_NOVELTY = (("unknown", 0.8), ("mechanistic", 0.75), ("contradiction", 0.85), ("evidence", 0.5), ("methodological", 0.4), ("scope", 0.35), ("translation", 0.55))
VAGUE_GAPS = (
    r"^(more|further|additional)\s+(research|studies|work|investigation)\s+(is|are)\s+(needed|required)",
    r"^the\s+(mechanism|role|function|effect)\s+(is|remains|are)\s+(unclear|unknown|not\s+well\s+understood)",
    r"^little\s+is\s+known",
    r"^future\s+studies\s+should",
)
GAP_ENTITY = r"\b[A-Z][a-z]{2,}[A-Z0-9]+\b"
GAP_PATHWAY = r"\b(?:pathway|signaling|cascade|axis)\b"

# Hypothesis rubric: weights of testability, rationale and feasibility; patterns that raise scores or warn.
HYPOTHESIS_WEIGHTS = (0.35, 0.30, 0.35)
DIRECTION = r"\b(?:increas|decreas|reduc|elevat|higher|lower|chang|alter)\b"
MEASURABLE = r"\b(?:significant|measurable|detectable|quantif)\b"
TECHNIQUE = r"(?i)\b(?:RNA-seq|RNAi|CRISPR|knockout|knockdown|overexpression|inhibitor|siRNA|shRNA|qPCR|western|ELISA|microscopy|TEM|SEM|flow\s+cytometry)\b"
MODEL_SYSTEM = r"\b(?:cell|mice|mouse|rat|zebrafish|drosophila|c\.\s*elegans|yeast|arabidopsis|in\s+vitro|in\s+vivo|ex\s+vivo)\b"
OVER_SPECIFIC = (
    r"(?i)\b[a-z]+\s+\d+\s*(mg|g|ml|ul|L)\s*/\s*(kg|g|ml|L)\b",
    r"(?i)\b\d{2,3}\s*%\s*\(?(v/v|w/v|w/w)\)?",
    r"(?i)\bpH\s*\d+\.\d+\b",
    r"(?i)\bincubat(e|ion).*?\d+\s*(min|h|hr|hour)",
    r"(?i)\bvendor.*?(Sigma|Thermo|Invitrogen|Abcam|Cell Signaling)",
)
DANGEROUS = (
    r"(?i)\bhuman\s+subject\b",
    r"(?i)\bclinical\s+trial\b",
    r"(?i)\bpatient\b",
    r"(?i)\bBSL-?3\b",
    r"(?i)\bBSL-?4\b",
    r"(?i)\bselect\s+agent\b",
    r"(?i)\bcontrolled\s+substance\b",
    r"(?i)\bnarcotic\b",
    r"(?i)\bweaponiz",
    r"(?i)\bbioterror",
    r"(?i)\bgain\s+of\s+function\b",
    r"(?i)\blethal\s+dose\b",
    r"(?i)\bLD50\b",
)

# Kinds of a discussion point; the kind with most matches wins, the first named of equals, interpretation if none match.
DISCUSSION: Rules = (
    ("interpretation", (r"\b(?:suggest|indicat|imply|interpret|mean|infer|appear|seem|likely|possibly|probably|therefore|thus|hence|consequently)\b",)),
    ("mechanism", (r"\b(?:mechanism|pathway|mode of action|signal|signalling|cascade|interaction)\b",)),
    ("comparison", (r"\b(?:compar|contrast|similar|differ|unlike|whereas|while|however)\b",)),
    ("limitation", (r"\b(?:limitation|limiting|caveat|caution|drawback|shortcoming|although|notably)\b",)),
    ("future_direction", (r"\b(?:future|further|additional|more|next step|remain|needed|required|warranted)\b",)),
    ("implication", (r"\b(?:implication|significance|importance|relevance|impact|consequence)\b",)),
    ("uncertainty", (r"\b(?:unclear|uncertain|unknown|not clear|not known|remains to be|ambigu)\b",)),
)

# Words of an answer that claims too much.
OVERCLAIM = ("prove", "confirm", "establish", "breakthrough", "novel", "first time", "definitively", "undoubtedly")

# Kinds of a figure and of a table by words of caption and mentions; the first kind with a word counts.
FIGURE_KINDS: Rules = (
    ("gel_or_blot", ("sds-page", "western blot", "blot", "gel", "electrophoresis", "immunoblot", "coomassie")),
    ("microscopy", ("fluorescence", "confocal", "microscop", "immunofluorescence", "tem", "sem", "cryo-em", "electron micrograph")),
    ("bioassay_curve", ("bioassay", "feeding assay", "leaf disc", "diet overlay", "surface contamination")),
    ("dose_response", ("dose-response", "dose response", "lc50", "ld50", "concentration-response", "mortality curve")),
    ("binding_assay", ("binding", "competition", "ligand blot", "bbmv", "spr", "surface plasmon", "radiolabel")),
    ("phylogeny", ("phylogenetic", "tree", "cladogram", "neighbor-joining", "maximum likelihood", "bootstrap")),
    ("structure_model", ("structure", "cryo-em", "model", "domain", "ribbon", "cartoon", "pdb", "3d", "crystal structure")),
    ("heatmap", ("heatmap", "heat map", "transcriptome", "rna-seq", "microarray", "expression profile", "clustering")),
    ("bar_chart", ("bar chart", "bar graph", "histogram", "bars represent", "error bars")),
    ("line_chart", ("line chart", "line graph", "time course", "kinetics", "growth curve")),
    ("sequence_alignment", ("alignment", "sequence", "conserved", "residues", "weblogo", "consensus")),
    ("domain_structure", ("domain organization", "domain architecture", "schematic", "diagram of", "domain I", "domain II")),
    ("workflow_model", ("schematic", "workflow", "flowchart", "overview", "pipeline", "model depicting")),
    ("table_like", ("table", "summary", "list of", "overview of", "comparison of")),
)
TABLE_KINDS: Rules = (
    ("toxicity_or_bioassay", ("lc50", "lc 50", "ld50", "ld 50", "mortality", "toxicity", "bioassay", "feeding assay", "leaf disc", "diet overlay", "surface contamination", "survival", "corrected mortality", "lethal concentration", "lethal dose", "median lethal", "insecticidal activity")),
    ("expression_or_production", ("expression", "purification", "yield", "production", "recombinant", "heterologous", "soluble", "insoluble", "inclusion body", "mg/l", "protein yield", "expression level", "expression vector", "production yield", "purification fold")),
    ("binding_or_affinity", ("binding", "affinity", "kd", "ka", "competition", "ligand blot", "bbmv", "brush border membrane", "spr", "surface plasmon", "radiolabel", "dissociation constant", "binding affinity", "competitive binding", "receptor binding")),
    ("omics_data", ("rna-seq", "rnaseq", "transcriptome", "proteome", "deg", "differentially expressed", "differential expression", "microarray", "gene expression profile", "fpkm", "rpkm", "fold change", "upregulated", "downregulated", "go term", "kegg", "enrichment", "cluster analysis")),
    ("gene_or_protein_list", ("gene ", "genes ", "protein list", "gene list", "accession", "locus tag", "gene id", "protein id", "orf", "open reading frame", "genomic", "gene name", "gene symbol", "gene family")),
    ("primer_or_plasmid", ("primer", "plasmid", "vector", "oligonucleotide", "construct", "restriction site", "cloning", "pcr primer", "forward primer", "reverse primer")),
    ("strain_or_sample", ("strain", "isolate", "sample", "specimen", "collection site", "geographic", "field-collected", "lab colony", "population", "accession number", "isolate name")),
    ("statistics_or_model", ("p-value", "p value", "regression", "anova", "model", "statistical", "correlation", "coefficient", "r-squared", "standard deviation", "standard error", "confidence interval", "odds ratio", "hazard ratio", "goodness of fit", "aic", "bic", "chi-square", "t-test", "mann-whitney", "kruskal-wallis")),
    ("phenotype_summary", ("phenotype", "morpholog", "growth rate", "body weight", "lesion", "symptom", "disease severity", "disease incidence", "efficacy", "potency", "activity against")),
    ("sequence_or_domain", ("sequence", "domain", "identity", "alignment", "conserved", "residues", "motif", "signal peptide", "transmembrane", "nucleotide sequence", "amino acid sequence", "homology")),
    ("supplementary_index", ("supplementary table", "supplementary information", "additional file", "supporting information", "see supplementary", "data not shown")),
)
