"""Types of tables and figures by words of two tiers, key columns of tables and subtypes of figures.

Fixed values: labels, words and their order in this module must be as they are for the same results.
"""

from __future__ import annotations

from papyrine.functions.rule_tables import Rules

Tiers = tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]

# Table types: (type, words of high confidence, words of medium confidence).
TABLE_TYPES: Tiers = (
    (
        "differential_expression",
        ("log2fc", "logfc", "log2 fold", "padj", "pvalue", "p_value", "fdr", "baseMean", "lfcse", "stat", "fold change", "adj pval", "adjusted p"),
        ("gene", "expression", "fc", "p ", "degs", "differentially expressed"),
    ),
    (
        "gene_expression",
        ("gene id", "gene symbol", "gene name", "fpkm", "rpkm", "tpm", "counts", "expression", "transcript id", "probe id"),
        ("expression", "count", "gene", "transcript", "normalized"),
    ),
    (
        "proteomics",
        ("protein id", "protein name", "accession", "uniprot", "peptide", "spectral count", "ms/ms", "intensity", "protein group", "plgs", "maxquant"),
        ("protein", "peptide", "spectra", "intensity", "abundance"),
    ),
    (
        "metabolomics",
        ("metabolite", "compound", "m/z", "retention time", "rt", "mass", "metabolomics", "kegg id", "hmdb", "pubchem", "pathway"),
        ("metabolite", "compound", "mass", "ion", "adduct"),
    ),
    (
        "sample_metadata",
        ("sample id", "sample name", "treatment", "condition", "group", "replicate", "batch", "time point", "tissue", "cell line", "strain", "genotype", "age", "sex", "source", "collection date"),
        ("sample", "group", "condition", "treatment", "metadata"),
    ),
    (
        "primer_table",
        ("primer", "sequence", "forward", "reverse", "oligo", "product size", "amplicon", "tm", "melting temp", "gc content", "target gene", "primer name", "fwd", "rev", "5'", "3'"),
        ("primer", "sequence", "oligo", "pcr"),
    ),
    (
        "strain_table",
        ("strain", "isolate", "genotype", "source", "origin", "collection", "serotype", "biotype", "pathovar", "host", "plasmid"),
        ("strain", "isolate", "genotype", "mutant"),
    ),
    (
        "phenotype_table",
        ("phenotype", "trait", "mortality", "weight", "length", "growth", "germination", "survival rate", "disease index", "severity", "lesion", "symptom", "score"),
        ("phenotype", "trait", "mortality", "growth"),
    ),
    (
        "bioassay_table",
        ("mortality", "corrected mortality", "concentration", "dose", "treatment", "replicate", "total", "dead", "alive", "inhibition rate", "growth inhibition"),
        ("bioassay", "mortality", "dose", "concentration"),
    ),
    (
        "survival_table",
        ("survival", "kaplan", "meier", "hazard ratio", "median survival", "time", "event", "censored", "alive", "dead", "days", "survival probability", "log-rank", "cox"),
        ("survival", "time", "event", "censored"),
    ),
    (
        "lc50_table",
        ("lc50", "lc50", "ld50", "ld50", "ec50", "ec50", "ic50", "ic50", "95% ci", "confidence interval", "slope", "intercept", "lethal concentration", "effective concentration"),
        ("lc50", "ld50", "ec50", "ic50", "lethal", "mortality"),
    ),
    (
        "statistical_result",
        ("p value", "p-value", "pvalue", "fdr", "q value", "statistic", "t-test", "anova", "chi", "correlation", "r value", "significance", "df", "effect size", "cohen", "eta"),
        ("p ", "statistic", "test", "significance", "correlation"),
    ),
    (
        "pathway_enrichment",
        ("pathway", "go term", "kegg", "enrichment", "gene ratio", "bg ratio", "enrichment score", "nes", "gene set", "ontology", "bp ", "cc ", "mf ", "biological process", "cellular component", "molecular function"),
        ("pathway", "enrichment", "go ", "ontology", "kegg"),
    ),
    (
        "taxonomy_table",
        ("taxonomy", "phylum", "class", "order", "family", "genus", "species", "kingdom", "otu", "asv", "16s", "its", "abundance", "relative abundance", "bacteria", "fungi"),
        ("taxonomy", "phylum", "species", "abundance", "otu"),
    ),
    (
        "method_parameter_table",
        ("parameter", "value", "setting", "configuration", "instrument", "column", "gradient", "flow rate", "temperature", "voltage", "wavelength", "buffer", "concentration", "ph"),
        ("parameter", "setting", "method", "instrument"),
    ),
    (
        "supplementary_index",
        ("supplementary", "table s", "figure s", "supplementary table", "supplementary figure", "suppl", "file name", "description", "appendix"),
        ("supplementary", "appendix", "file", "description"),
    ),
)

# Headers that are key columns of a table type.
KEY_COLUMNS: Rules = (
    ("differential_expression", ("gene", "log2fc", "padj", "pvalue", "fold change")),
    ("gene_expression", ("gene", "expression", "fpkm", "tpm", "count")),
    ("bioassay_table", ("concentration", "mortality", "treatment", "replicate")),
    ("lc50_table", ("lc50", "95% ci", "slope", "mortality")),
    ("survival_table", ("time", "survival", "hazard", "event")),
    ("primer_table", ("primer", "sequence", "product size", "tm")),
    ("sample_metadata", ("sample", "treatment", "condition", "group", "replicate")),
    ("pathway_enrichment", ("pathway", "go term", "enrichment", "p value")),
)

# Figure types: (type, words of high confidence, words of low confidence).
FIGURE_TYPES: Tiers = (
    (
        "microscopy",
        ("microscop", "confocal", "fluorescence microscop", "tem image", "sem image", "electron microscop", "immunofluorescence", "brightfield", "phase contrast", "confocal laser scanning", "transmission electron", "scanning electron", "light microscop", "fluorescent microscop", "live cell imaging", "time-lapse"),
        ("image", "morpholog", "cellular localiz", "subcellular"),
    ),
    (
        "western_blot",
        ("western blot", "immunoblot", "western blotting", "immunoblotting", "protein blot", "wb analysis"),
        ("band", "kda", "protein expression", "protein level"),
    ),
    (
        "gel_image",
        ("gel electrophores", "sds-page", "sds page", "agarose gel", "polyacrylamide gel", "dna gel", "rna gel", "native gel", "gel image", "gel staining", "coomassie", "ethidium bromide", "gel shift", "emsa", "electrophoretic mobility"),
        ("gel", "electrophores", "ladder", "molecular weight"),
    ),
    (
        "survival_curve",
        ("survival curve", "kaplan-meier", "kaplan meier", "survival analys", "survival probability", "survival rate", "survival plot", "mortality curve", "longevity", "lifespan", "cumulative survival", "percent survival"),
        ("survival", "mortality", "time", "days post"),
    ),
    (
        "bioassay",
        ("bioassay", "lc50", "ld50", "ec50", "ic50", "dose-response", "dose response", "concentration-response", "mortality assay", "toxicity assay", "inhibition curve", "growth inhibition", "feeding assay", "diet bioassay", "surface contamination"),
        ("assay", "concentration", "dose", "mortality", "inhibition"),
    ),
    (
        "binding_assay",
        ("binding assay", "binding affinity", "kd value", "spr", "surface plasmon resonance", "isothermal titration", "itc", "pull-down", "pull down", "co-immunoprecipitation", "co-ip", "yeast two-hybrid", "y2h", "biolayer interferometry", "mst", "microscale thermophoresis"),
        ("binding", "affinity", "interaction", "ligand", "receptor binding"),
    ),
    (
        "expression_analysis",
        ("expression analys", "gene expression", "rt-pcr", "rt pcr", "qpcr", "rt-qpcr", "rna-seq", "rna seq", "transcriptom", "microarray", "heat ?map", "expression profile", "differential expression", "fpkm", "rpkm", "transcript level", "rna level", "mrna expression", "northern blot"),
        ("expression", "transcript", "fold change", "upregulat", "downregulat"),
    ),
    (
        "heatmap",
        ("heatmap", "heat map", "clustered heatmap", "expression heatmap", "correlation heatmap", "hierarchical clustering"),
        ("cluster", "color scale", "row", "column", "z-score"),
    ),
    (
        "volcano_plot",
        ("volcano plot", "volcano", "ma plot", "ma-plot"),
        ("log2 fold", "p-value", "fdr", "differential"),
    ),
    (
        "phylogeny",
        ("phylogen", "phylogenetic tree", "cladogram", "neighbor-joining", "maximum likelihood tree", "bayesian tree", "bootstrap", "evolutionary tree", "dendrogram", "molecular phylogen", "sequence alignment", "multiple sequence alignment"),
        ("tree", "bootstrap", "branch", "clade", "node"),
    ),
    (
        "structure_model",
        ("structure model", "crystal structure", "nmr structure", "homology model", "protein structure", "3d structure", "molecular docking", "docking model", "ribbon diagram", "cartoon representation", "predicted structure", "alphafold", "x-ray crystallograph", "cryo-em", "cryo em"),
        ("structure", "model", "docking", "conformation", "domain"),
    ),
    (
        "statistical_plot",
        ("bar chart", "bar graph", "scatter plot", "box plot", "boxplot", "violin plot", "histogram", "pie chart", "line graph", "correlation plot", "regression", "linear regression", "anova", "t-test", "statistical analys", "error bar", "standard deviation", "standard error", "mean ±"),
        ("plot", "graph", "chart", "error", "significant"),
    ),
    (
        "workflow_diagram",
        ("workflow", "schematic", "diagram", "flow chart", "flowchart", "experimental design", "study design", "protocol overview", "graphical abstract", "model figure", "illustration", "cartoon", "overview", "summary figure"),
        ("schema", "overview", "design", "protocol", "step"),
    ),
)

# Subtypes of figure types: (type, ((word, subtype), ...)), the first word found counts.
SUBTYPES: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = (
    ("microscopy", (("confocal", "confocal"), ("electron", "electron microscopy"), ("fluorescence", "fluorescence microscopy"), ("live_cell", "live cell imaging"), ("tem", "transmission electron microscopy"), ("sem", "scanning electron microscopy"))),
    ("western_blot", (("quantitative", "quantitative western blot"), ("semi_quantitative", "semi-quantitative"))),
    ("gel_image", (("sds_page", "SDS-PAGE"), ("agarose", "agarose gel"), ("emsa", "EMSA/gel shift"), ("native", "native gel"))),
    ("bioassay", (("lc50", "LC50 determination"), ("ld50", "LD50 determination"), ("ec50", "EC50 determination"), ("ic50", "IC50 determination"), ("dose_response", "dose-response"), ("feeding", "feeding assay"))),
    ("expression_analysis", (("qpcr", "qPCR"), ("rna_seq", "RNA-seq"), ("microarray", "microarray"), ("northern", "northern blot"))),
    ("phylogeny", (("ml_tree", "maximum likelihood"), ("bayesian", "bayesian"), ("nj_tree", "neighbor-joining"))),
    ("structure_model", (("crystal", "X-ray crystallography"), ("cryo_em", "cryo-EM"), ("docking", "molecular docking"), ("alphafold", "AlphaFold prediction"))),
)
# Confidence by tier: (base, step, most) of many words, the same of some, one word, how many are some; and what the reason begins with.
TABLE_TIERS = ((0.70, 0.10, 0.95), (0.50, 0.08, 0.70), 0.35, 3)
FIGURE_TIERS = ((0.70, 0.15, 0.98), (0.40, 0.10, 0.65), 0.30, 2)
TABLE_REASONS = ("Matched headers: ", "Partial match: ", "Weak match: ", "No matching patterns found.")
FIGURE_REASONS = ("Matched keywords: ", "Partial match: ", "Weak match: ", "")
