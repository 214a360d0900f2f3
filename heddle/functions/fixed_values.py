"""Vocabularies, thresholds and patterns that results depend on. Rules that use them are in ``rules``."""

# Roles of score-type labels, in lower case. Higher is fitter:
DIR_POS = [
    "log2fc", "log2", "zlfc", "z-score", "crispr score (cs)", "ceres score", "beta score", "castle effect",
    "mean depletion", "essentiality score", "rho (log2e treated vs. untreated)", "mean fold change",
    "gamma (normalized log2e/t)", "gamma", "delta", "nes (normalized enrichment score)", "enrichment",
    "depletion-enrichment (de) score", "t-score", "differential score", "differential crispr score", "gene score",
    "gene-level three score (ts)", "riger score", "nscore", "fs (fitness score)", "ranks score",
    "phenotype scores based on log2 fold enrichments", "second best guide score", "second best guide score x rsa",
]
# Higher is more essential:
DIR_NEG = ["bayes factor", "dependency score"]
# Unsigned, larger is more significant:
SIG_MAG = ["stars score", "rsa", "castle score", "cgi"]
# Unsigned, smaller is more significant:
SIG_P = ["p-value", "fdr", "q-value", "mageck score", "rra score", "neg score p-value", "pos score p-value"]
# No effect at all:
IGNORE = ["rank", "rra rank", "sgrna number", "read counts", "umi", "percent sorted cells", "reduced chi squared", "deseq2"]
# A logarithm of unknown sign and base:
AMBIGUOUS_LOG_MARKERS = ["log10", "log 10", "-log(", "-log (", "logp", "log-p"]
P_MARKERS = ["p-val", "p_val", "fdr", "q-val", "q_val"]
EFFECT_MARKERS = ["log2", "lfc", "z-score", "zlfc", "effect", "beta", "fold change", "enrichment score"]
PAIR_P_MARKERS = ["p-value", "p_val", "fdr", "q-val", "mageck", "rra"]

# Score quality: values that mean missing, the floor of p-values, limits of collapsed and coarse screens.
MISSING_SCORES = ["-", "", "None"]
P_FLOOR = 1e-10
COLLAPSE_MIN_GENES, COLLAPSE_DISTINCT, COARSE_SHARE = 500, 20, 0.01
MAD_TO_SIGMA = 1.4826

# Experimental setup to class of condition.
SETUP_CLASS = {
    "timecourse": "baseline",
    "drug exposure": "drug",
    "virus exposure": "pathogen",
    "bacteria exposure": "pathogen",
    "toxin exposure": "toxin",
    "radiation exposure": "radiation",
    "t cell exposure": "immune",
    "nk cell exposure": "immune",
    "cytokine exposure": "signal",
    "cytokine depletion": "signal",
    "ligand exposure": "signal",
    "implantation to mouse model": "in-vivo",
    "oxygen exposure": "metabolic",
    "sars-cov-2 spike-rbd exposure": "binding",
    "sars-cov-2 spike exposure (293t-spike-gfp11-p2a-mcherry cells)": "binding",
    "transferrin receptor (tfrc/cd71) exposure": "binding",
}
SUPPRESSING = ["drug", "pathogen", "toxin", "radiation", "immune", "nutrient", "metabolic"]
NO_PRESSURE = ["baseline", "in-vivo"]
SIGNAL_AGENT = r"(?i)\b(wnt|rspo|r-spondin|estrogen|oestrogen|androgen|gm-csf|m-csf|lif|growth factor|cytokine)\b"
SIGNAL_WITHDRAWN = r"(?i)absence of|without|withdraw|[- ]independent"
NUTRIENT = (
    r"(?i)(restrict|deprivation|starvation|depleted|low |withdraw).{0,40}"
    r"(valine|glutamine|glucose|serine|methionine|amino acid|nutrient|cystine|arginine|lipid|sugar)"
)
BINDING = r"(?i)binding|surfaceome|interactome"
DEATH = r"(?i)necropt|apopto|death.?induc|cytotox|toxicity|ferropto|ceramide"
MARKER = r"(?i)\breporter\b"

# Drug to mechanism: the first bucket that has a substring of the name.
MECHANISMS = [
    ("DDR·PARP", ["olaparib", "talazoparib", "niraparib", "rucaparib", "thioparib", "cpd-391", "cpd‐391", "phthalazin"]),
    ("DDR·ATR/ATM/CHK1", ["azd6738", "berzosertib", "ve822", "ve-822", "prexasertib", "rabusertib", "ly2603618", "m3541", "atm inhibitor", "atr inhibitor", "chk1", "ceralasertib"]),
    ("DDR·genotoxic", ["cisplatin", "oxaliplatin", "carboplatin", "etoposide", "camptothecin", "irinotecan", "topotecan", "doxorubicin", "gemcitabine", "hydroxyurea", "fluorouracil", "temozolomide", "mitomycin", "methanesulfonate", "mms", "bleomycin", "cytarabine", "methotrexate", "formaldehyde", "illudin", "pyridostatin"]),
    ("Microtubule", ["paclitaxel", "taxol", "docetaxel", "colchicine", "vincristine", "nocodazole", "vinblastine"]),
    ("PLK", ["bi-2536", "bi2536", "volasertib"]),
    ("CDK", ["dinaciclib", "palbociclib", "ribociclib", "abemaciclib", "ro-3306", "thz-1", "thz1", "cdk9i", "azd5576", "cdk7", "seliciclib", "cdk"]),
    ("MAPK", ["vemurafenib", "dabrafenib", "plx-4720", "plx4720", "trametinib", "selumetinib", "cobimetinib", "sorafenib", "shp099", "erlotinib", "gefitinib", "osimertinib", "binimetinib"]),
    ("BET/BRD4", ["jq1", "abbv-744", "abbv744", "i-bet", "ibet", "bet inhibitor"]),
    ("BCL2/apoptosis", ["venetoclax", "navitoclax", "abt-737", "abt-199", "abt737", "s63845"]),
    ("XPO1", ["selinexor", "kpt-"]),
    ("Proteasome/UPS", ["bortezomib", "carfilzomib", "ixazomib", "mg132", "mg-132", "tak-243", "tak243", "mln4924"]),
    ("Cereblon/IMiD", ["lenalidomide", "pomalidomide", "avadomide", "cc-122", "cc122", "thalidomide"]),
    ("HDAC", ["panobinostat", "vorinostat", "saha", "romidepsin", "entinostat"]),
    ("ER-stress/UPR", ["tunicamycin", "thapsigargin", "brefeldin"]),
    ("Mito/OXPHOS", ["antimycin", "oligomycin", "cccp", "rotenone", "oar", "dichloroacetic", "dca", "fccp"]),
    ("Ferroptosis", ["rsl3", "ml-210", "ml210", "erastin", "gpx4"]),
    ("Spliceosome", ["pladienolide", "pladb", "e7107", "h3b"]),
    ("Autophagy", ["hydroxychloroquine", "chloroquine", "bafilomycin"]),
    ("Oxidative", ["h2o2", "hydrogen peroxide", "peroxide", "tbhp", "menadione", "paraquat"]),
    ("KEAP1/NRF2", ["ki-696", "ki696"]),
    ("mTOR/PI3K", ["rapamycin", "torin", "everolimus", "temsirolimus", "pi3k", "wortmannin"]),
    ("Antiviral", ["remdesivir", "molnupiravir"]),
]

# Substrings of a phenotype that make its assay domain.
FITNESS_PHENOTYPES = ["prolifer", "viab", "fitness", "growth", "essential", "tumor"]
REPORTER_PHENOTYPES = [
    "protein", "peptide", "rna", "accumulation", "distribution", "transport", "localization", "signal transduction",
    "phagocyt", "autophag", "mitophag", "lysosome", "vesicle", "frameshift", "nonsense-mediated", "binding", "secretion",
    "differentiation", "reprogram", "migration", "cell cycle", "senescen", "syncytium", "pyroptosis", "lipid",
]

# Gene lean, edge tiers, darkness.
LEAN_CUT = 0.15
TIER_LABELS = {1: "both channels", 2: "mutual best only", 3: "co-hit only", 4: "neither"}

# Uploads: values that mean missing, words that mean hit, names of columns.
UPLOAD_MISSING = ["", "-", "na", "nan", "null", "none", "."]
HIT_WORDS = ["yes", "1", "true", "hit", "y"]
HIT_COLUMNS = ["hit", "hit_flag", "is_hit"]
STARS_COLUMNS = ["gene", "q-value", "p-value", "lfc", "rank"]
DESEQ_COLUMNS, DESEQ_OPTIONAL = ["basemean", "log2foldchange", "padj"], ["lfcse", "stat", "pvalue"]
SIMPLE_ID_TERMS = ["gene", "symbol", "gene_symbol", "name", "genename", "gene_name", "id"]
SIMPLE_SCORE_TERMS = ["score", "lfc", "log2fc", "log2foldchange", "fc", "rank", "pvalue", "fdr", "value"]
MIN_UPLOAD_GENES = 5

# Bytes per row by which storage is estimated: screens, genes, raw pairs, facts, screen and gene dimensions.
ROW_BYTES = {"screen": 2000, "gene": 800, "screen_gene_raw": 100, "fact_screen_gene": 100, "dim_screen": 500, "dim_gene": 300}

# Symbols that are controls or guides rather than genes; what stands before the process in a screen's rationale.
CONTROL_SYMBOL = (
    r"(?i)^(ntc|non[-_ ]?targeting|control[_-]|control$|safe[-_ ]?harbor|neg(ative)?[-_ ]?control"
    r"|no[-_ ]?site|lacz|e?gfp|luciferase|luc$|sgnt|sgcontrol|scramble)"
)
GUIDE_SYMBOL = r"(?i)(^SGR\d|_XPR|_SG\d|^SGR000)"
PROCESS_FRAMINGS = [
    r"(?i)^(positive|negative)\s+regulators?\s+of\s+",
    r"(?i)^regulators?\s+of\s+",
    r"(?i)^genes?\s+(involved\s+in|for|regulating)\s+",
]

# Directions proposed for a screen apply from this confidence; core-essential genes that may veto them, and where.
DIRECTION_CONFIDENCE = 0.7
CORE_ESSENTIAL = ["POLR2A", "POLR2L", "RPL3", "RPL4", "RPS11", "EIF4A3", "PSMB3", "PSMA1", "SNRNP200", "CDK1"]
VIABILITY_MARKERS = ["prolifer", "viab", "fitness", "growth", "essential", "dropout", "depletion"]
# Modality and sign of a methodology.
MODALITIES = {"Knockout": ("KO", -1), "Inhibition": ("CRISPRi", -1), "Activation": ("CRISPRa", 1)}
# What kind of comparison a score type allows; others are unknown.
SCORE_BUCKETS = {
    "Log2FC": "effect", "Log2": "effect", "Z-score": "effect", "pos Z-score": "effect",
    "MaGeCK Score": "effect", "MAGeCK neg score": "effect", "MAGeCK pos score": "effect",
    "STARS Score": "effect", "CasTLE Score": "effect", "CasTLE Effect": "effect",
    "CRISPR Score (CS)": "effect", "Beta Score": "effect", "CERES score": "effect",
    "Depletion-Enrichment (DE) score": "effect",
    "p-Value": "significance", "FDR": "significance", "Bayes Factor": "significance",
    "Rank": "rank",
    "Read counts": "unusable",
}
# What requests may name.
SYMBOL_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,39}$"
SCREEN_ID_PATTERN = r"^[0-9]{1,9}$"
CONTEXT_PATTERN = r"^[A-Za-z0-9:·._-]{1,40}$"
ORGANISM_ALIASES = {
    "human": "human", "homo sapiens": "human", "hsapiens": "human", "hs": "human", "9606": "human",
    "mouse": "mouse", "mus musculus": "mouse", "mmusculus": "mouse", "mm": "mouse", "10090": "mouse",
}
