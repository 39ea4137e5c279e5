"""Fixed values.

Class codes, class names, category spellings and change-string patterns that
have to be exactly these for results to be right.  Lists follow the order in
which rules apply.
"""

# Training classes.
OTHER, ONCOGENE, TSG = 0, 1, 2

# Consequence classes of a change.
MISSENSE = "Missense_Mutation"
SILENT = "Silent"
NONSENSE = "Nonsense_Mutation"
NONSTOP = "Nonstop_Mutation"
TRANSLATION_START = "Translation_Start_Site"
IN_FRAME = "In_Frame_Indel"
FRAME_SHIFT = "Frame_Shift_Indel"
SPLICE = "Splice_Site"
NOT_VALID = "not valid"
UNKNOWN_EFFECT = "unknown effect"
NO_PROTEIN = "no protein"
MISSING = "missing"
SUBSTITUTION = "substitution"
DELETION = "deletion"
INSERTION = "insertion"

PROTEIN_CLASSES = (
    NOT_VALID, UNKNOWN_EFFECT, NO_PROTEIN, MISSING, NONSTOP, TRANSLATION_START,
    SILENT, MISSENSE, IN_FRAME, NONSENSE, FRAME_SHIFT, SPLICE,
)

# Consequence class names of one mutation export.
EXPORT_CONSEQUENCES = {
    "Substitution - Missense": MISSENSE,
    "Substitution - coding silent": SILENT,
    "Substitution - Nonsense": NONSENSE,
    "Frameshift": FRAME_SHIFT,
    "Deletion - Frameshift": FRAME_SHIFT,
    "Insertion - Frameshift": FRAME_SHIFT,
    "Complex - frameshift": FRAME_SHIFT,
    "Deletion - In frame": IN_FRAME,
    "Insertion - In frame": IN_FRAME,
    "Complex - insertion inframe": IN_FRAME,
    "Complex - deletion inframe": IN_FRAME,
}

# Consequence class names of a second publisher; any other name is an error.
STRICT_CONSEQUENCES = {
    "Silent": SILENT,
    "Splice Site": SPLICE,
    "Missense": MISSENSE,
    "Indel Frameshift": FRAME_SHIFT,
    "Nonsense": NONSENSE,
    "Indel In Frame": IN_FRAME,
    "Complex Missense": IN_FRAME,
    "Translation_Start_Site": TRANSLATION_START,
    "De_novo_Start_OutOfFrame": TRANSLATION_START,
    "De_novo_Start_InFrame": TRANSLATION_START,
    "Nonstop Extension": NONSTOP,
    "Complex Nonsense": NONSENSE,
    "Indel Nonsense": NONSENSE,
    "5'UTR": "5'UTR",
    "3'UTR": "3'UTR",
    "Intron": "Intron",
    "Promoter": "Promoter",
}

# Consequence class by the first substring found, ignoring case.
CONSEQUENCE_SUBSTRINGS = (
    ("missense", MISSENSE),
    ("splice_site", SPLICE),
    ("frame_shift", FRAME_SHIFT),
    ("in_frame", IN_FRAME),
    ("synonymous", SILENT),
    ("nonsense", NONSENSE),
    ("silent", SILENT),
    ("nonstop", NONSTOP),
    ("translation_start_site", TRANSLATION_START),
)

# Tumour type abbreviations.
TUMOR_TYPE_CODES = {
    "OV": "Ovarian",
    "ESO": "Esophageal Adenocarcinoma",
    "CRC": "Colorectal",
    "NB": "Neuroblastoma",
    "GBM": "Glioblastoma Multiforme",
    "PRAD": "Prostate Adenocarcinoma",
    "UCEC": "Endometrial Carcinoma",
    "BLCA": "Bladder Urothelial Carcinoma",
    "BRCA": "Breast Adenocarcinoma",
    "MEL": "Melanoma",
    "LUSC": "Lung Squamous Cell Carcinoma",
    "MED": "Medulloblastoma",
    "HNSC": "Head and Neck Squamous Cell Carcinoma",
    "LUAD": "Lung Adenocarcinoma",
    "KIRC": "Kidney Clear Cell Carcinoma",
}

# Tumour type spellings, misspellings included.
TUMOR_TYPE_SPELLINGS = {
    "Ovarian Carcinoma": "Ovarian",
    "Ovarian Adenocarcinoma": "Ovarian",
    "Colorectal Adenocarcinoma": "Colorectal",
    "Glioblastoma": "Glioblastoma Multiforme",
    "Thyroic Carcinoma": "Thyroid Carcinoma",
    "Endometerial Carcinoma ": "Endometrial Carcinoma",
    "Uterin Carcinoma": "Endometrial Carcinoma",
    "Bladder Carcinoma": "Bladder Urothelial Carcinoma",
    "Skin Melanoma": "Melanoma",
}

# Non-coding classes, and the pattern of the untranslated regions.
NONCODING_CLASSES = ("IGR", "Unknown", "Intron", "RNA", "Non-coding_Transcript")
UNTRANSLATED = r"^[35]'"

# Sex chromosomes written as numbers.
CHROMOSOME_NAMES = {"23": "X", "24": "Y"}

# Alias that the symbol tables get wrong.
ALIAS_OVERRIDES = {"MLL4": "KMT2B"}

# Classes whose end position differs from the start position.
DELETION_CLASSES = ("In_Frame_Del", "Frame_Shift_Del")
INSERTION_CLASSES = ("In_Frame_Ins", "Frame_Shift_Ins")

# Sequence ontology codes: one residue replaced, insertion, deletion, frame shift.
REPLACEMENT_CODES = ("SY", "SL", "SG", "MS", "CS")
INSERTION_CODE = "II"
DELETION_CODE = "ID"
FRAME_SHIFT_CODES = ("FI", "FD")

# Protein change patterns, "p." removed and upper-cased unless noted.
P_REPLACED = r"^([A-Z?])(\d+)([A-Z?])$"
P_LOST_STOP = r"^\*\d+[A-Z?]+\*?$"
P_ENDS_IN_STOP = r".+\*(\d+)?$"
P_FRAME_SHIFT_ORIGINAL = r"[A-Z]\d+[A-Z]+\*"
P_UNKNOWN = ("?", "(=)", "=")
P_NO_PROTEIN = ("0", "0?")

# DNA change patterns, "c." removed.
C_SUBSTITUTION = r"(?:(\d+)([+-]\d+)?_)?(\d+)([+-]\d+)?([A-Z]+)>([A-Z]+)$"
C_DELETION = r"(?:([0-9?]+)([-+]\d+)?(?:_))?([0-9?]+)([-+]\d+)?del([A-Z?0-9]+)$"
C_INSERTION = r"(?:([0-9?]+)([-+]\d+)?(?:_))?([0-9?]+)([-+]\d+)?ins([A-Z?0-9]+)$"
C_UNKNOWN = ("c.?", "?")

# Splice window around an exon boundary, in bases.
SPLICE_3, SPLICE_5 = -2, 2

# Points of the evaluation curves.
GRID_POINTS = 100
