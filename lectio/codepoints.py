"""Code-point classes of pointed Hebrew and the closed vocabularies built on them."""

# Code-point ranges of the text classes, as regular-expression classes for Java and Python alike.
CONSONANT = r"\u05D0-\u05EA"
TROP = r"\u0591-\u05AF"
NIKKUD = r"\u05B0-\u05BD"
VOWEL_DECISION = r"\u05B0-\u05BD\u05C1\u05C2\u05C7"
TIER2_EXTRA = r"\u05BD\u05BF\u05C0\u05C3\u05C6"
LOADER_TIER1_DROP = r"\u0591-\u05AF\u05B0-\u05BD\u05BF-\u05C7"
CGJ, MAQAF, CIRCELLUS, RAFE, SOF_PASUQ, DAGESH = "\u034F", "\u05BE", "\u05AF", "\u05BF", "\u05C3", "\u05BC"
BEGADKEFAT = "\u05D1\u05D2\u05D3\u05DB\u05DA\u05E4\u05E3\u05EA"

# Names of the points by code point.
MARK_NAMES = {
    0x05B0: "shva", 0x05B1: "hataf_segol", 0x05B2: "hataf_patach", 0x05B3: "hataf_qamatz", 0x05B4: "hiriq", 0x05B5: "tsere",
    0x05B6: "segol", 0x05B7: "patach", 0x05B8: "qamatz", 0x05B9: "holam", 0x05BA: "holam_haser", 0x05BB: "qubuts",
    0x05BC: "dagesh", 0x05BD: "meteg", 0x05C1: "shin_dot", 0x05C2: "sin_dot", 0x05C7: "qamats_qatan",
}
ABSENT = "__absent__"
OWN_CLASS = ("dagesh", "meteg")
DOT_CLASS = ("shin_dot", "sin_dot")

# The mark vocabulary by group, its aliases, and the types that only catalogs know.
MARK_TYPES = {"parashah": ["pe", "samekh"], "letter": ["large_letter", "small_letter", "suspended_letter", "inverted_nun", "puncta_extraordinaria"], "masorah": ["circellus", "rafe", "double_rafe"]}
ALIASES = {"reversednun": "inverted_nun", "puncta": "puncta_extraordinaria"}
ALL_TYPES = [t for group in MARK_TYPES.values() for t in group]

# Codes of marked letters in the edition, its marker elements, and short book names.
X_CODES = {"4": "puncta_extraordinaria", "5": "large_letter", "6": "small_letter", "7": "suspended_letter", "8": "inverted_nun"}
MARKER_TAGS = {"pe": "pe", "samekh": "samekh", "reversednun": "inverted_nun"}
BOOKS = {"Deuteronomy": "Deut", "Genesis": "Gen", "Exodus": "Exod", "Leviticus": "Lev", "Numbers": "Num", "Samuel 1": "1Sam", "Samuel 2": "2Sam", "Isaiah": "Isa"}

# Weights of the composite, partial credit, resampling defaults.
WEIGHTS = (0.5, 0.3, 0.2)
PARTIAL = 1.0 / 3.0
RESAMPLES, SEED, BOUNDS = 10_000, 0xBEEF, (2.5, 97.5)
