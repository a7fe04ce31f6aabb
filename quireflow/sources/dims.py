"""Static dimensions: languages, scripts of detection, candidate fonts and their coverage. All are small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireflow.functions.text import SCRIPT_BLOCKS

#: Recognition languages by rough number of speakers (fixed values): code, scripts, locale prefixes, region of Han glyphs.
LANGUAGES = (
    ("eng", ("latin",), ("en",), None),
    ("chi_sim", ("han",), ("zh", "zh-cn", "zh-sg", "zh-hans"), "sc"),
    ("hin", ("devanagari",), ("hi",), None),
    ("spa", ("latin",), ("es",), None),
    ("fra", ("latin",), ("fr",), None),
    ("ara", ("arabic",), ("ar",), None),
    ("ben", ("bengali",), ("bn", "as"), None),
    ("por", ("latin",), ("pt",), None),
    ("rus", ("cyrillic",), ("ru", "be", "kk"), None),
    ("urd", ("arabic",), ("ur",), None),
    ("ind", ("latin",), ("id",), None),
    ("deu", ("latin",), ("de",), None),
    ("jpn", ("han", "kana"), ("ja",), "jp"),
    ("mar", ("devanagari",), ("mr",), None),
    ("tel", ("telugu",), ("te",), None),
    ("tur", ("latin",), ("tr",), None),
    ("tam", ("tamil",), ("ta",), None),
    ("vie", ("latin",), ("vi",), None),
    ("kor", ("hangul", "han"), ("ko",), "kr"),
    ("ita", ("latin",), ("it",), None),
    ("fas", ("arabic",), ("fa",), None),
    ("tha", ("thai",), ("th",), None),
    ("guj", ("gujarati",), ("gu",), None),
    ("pan", ("gurmukhi",), ("pa",), None),
    ("kan", ("kannada",), ("kn",), None),
    ("mal", ("malayalam",), ("ml",), None),
    ("nep", ("devanagari",), ("ne",), None),
    ("chi_tra", ("han",), ("zh-tw", "zh-hk", "zh-mo", "zh-hant"), "tc"),
    ("pol", ("latin",), ("pl",), None),
    ("ukr", ("cyrillic",), ("uk",), None),
    ("msa", ("latin",), ("ms",), None),
    ("swa", ("latin",), ("sw",), None),
    ("tgl", ("latin",), ("fil", "tl"), None),
    ("nld", ("latin",), ("nl",), None),
    ("ron", ("latin",), ("ro",), None),
    ("ell", ("greek",), ("el",), None),
    ("ces", ("latin",), ("cs",), None),
    ("hun", ("latin",), ("hu",), None),
    ("swe", ("latin",), ("sv",), None),
    ("heb", ("hebrew",), ("he", "iw"), None),
)
AUTO, MAX_LANGUAGES = "auto", 3

#: Names that script detection reports (fixed values), and the key of their languages; most are their own key.
DETECTED = {s: s for s in ("latin", "cyrillic", "greek", "arabic", "hebrew", "devanagari", "bengali", "gurmukhi", "gujarati", "tamil", "telugu", "kannada", "malayalam", "thai", "han", "japanese", "korean")} | {
    "fraktur": "latin", "hans": "han-sc", "hant": "han-tc", "hiragana": "japanese", "katakana": "japanese", "hangul": "korean",
}
#: Languages of a detected key, the default first (fixed values).
SCRIPT_LANGUAGES = {
    "latin": ("eng", "spa", "fra", "por", "ind", "deu", "tur", "vie", "ita", "pol", "msa", "swa", "tgl", "nld", "ron", "ces", "hun", "swe"),
    "cyrillic": ("rus", "ukr"),
    "greek": ("ell",),
    "arabic": ("ara", "urd", "fas"),
    "hebrew": ("heb",),
    "devanagari": ("hin", "nep", "mar"),
    "bengali": ("ben",),
    "gurmukhi": ("pan",),
    "gujarati": ("guj",),
    "tamil": ("tam",),
    "telugu": ("tel",),
    "kannada": ("kan",),
    "malayalam": ("mal",),
    "thai": ("tha",),
    "han": ("chi_sim", "chi_tra"),
    "han-sc": ("chi_sim",),
    "han-tc": ("chi_tra",),
    "japanese": ("jpn",),
    "korean": ("kor",),
}
#: Key of the branch that takes the reader's own language.
ANY = "*"
#: Scripts with a headline, by the primary tag of a locale (fixed values).
HEADLINE_LOCALES = {"ne": "devanagari", "hi": "devanagari", "mr": "devanagari", "sa": "devanagari", "bn": "bengali", "as": "bengali", "pa": "gurmukhi"}

#: Candidate fonts in order of preference (fixed values): id, category, scripts, region of Han glyphs.
FONTS = (
    ("arimo", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("tinos", "serif", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("cousine", "mono", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("carlito", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("roboto", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("open-sans", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("roboto-condensed", "condensed", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("noto-serif", "serif", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("caladea", "serif", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("gelasio", "serif", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("libre-franklin", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("eb-garamond", "serif", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("libre-baskerville", "serif", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("archivo-narrow", "condensed", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("ibm-plex-mono", "mono", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("inter", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("lato", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("montserrat", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("source-sans-3", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("noto-sans", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("pt-sans", "sans", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("pt-serif", "serif", ("latin", "cyrillic", "greek", "hebrew"), None),
    ("noto-sans-devanagari", "sans", ("devanagari",), None),
    ("noto-serif-devanagari", "serif", ("devanagari",), None),
    ("mukta", "sans", ("devanagari",), None),
    ("hind", "sans", ("devanagari",), None),
    ("yantramanav", "sans", ("devanagari",), None),
    ("poppins", "sans", ("latin", "devanagari"), None),
    ("tiro-devanagari-hindi", "serif", ("devanagari",), None),
    ("martel", "serif", ("devanagari",), None),
    ("laila", "serif", ("devanagari",), None),
    ("karma", "serif", ("devanagari",), None),
    ("khand", "condensed", ("devanagari",), None),
    ("gotu", "sans", ("devanagari",), None),
    ("noto-sans-bengali", "sans", ("bengali",), None),
    ("noto-serif-bengali", "serif", ("bengali",), None),
    ("hind-siliguri", "sans", ("bengali",), None),
    ("noto-sans-gurmukhi", "sans", ("gurmukhi",), None),
    ("noto-serif-gurmukhi", "serif", ("gurmukhi",), None),
    ("mukta-mahee", "sans", ("gurmukhi",), None),
    ("noto-sans-gujarati", "sans", ("gujarati",), None),
    ("noto-serif-gujarati", "serif", ("gujarati",), None),
    ("hind-vadodara", "sans", ("gujarati",), None),
    ("noto-sans-tamil", "sans", ("tamil",), None),
    ("noto-serif-tamil", "serif", ("tamil",), None),
    ("mukta-malar", "sans", ("tamil",), None),
    ("noto-sans-telugu", "sans", ("telugu",), None),
    ("noto-serif-telugu", "serif", ("telugu",), None),
    ("hind-guntur", "sans", ("telugu",), None),
    ("noto-sans-kannada", "sans", ("kannada",), None),
    ("noto-serif-kannada", "serif", ("kannada",), None),
    ("baloo-tamma-2", "sans", ("kannada",), None),
    ("noto-sans-malayalam", "sans", ("malayalam",), None),
    ("noto-serif-malayalam", "serif", ("malayalam",), None),
    ("manjari", "sans", ("malayalam",), None),
    ("noto-naskh-arabic", "serif", ("arabic",), None),
    ("noto-sans-arabic", "sans", ("arabic",), None),
    ("amiri", "serif", ("arabic",), None),
    ("cairo", "sans", ("arabic",), None),
    ("vazirmatn", "sans", ("arabic",), None),
    ("noto-nastaliq-urdu", "serif", ("arabic",), None),
    ("noto-sans-hebrew", "sans", ("hebrew",), None),
    ("noto-serif-hebrew", "serif", ("hebrew",), None),
    ("rubik", "sans", ("latin", "cyrillic", "hebrew"), None),
    ("frank-ruhl-libre", "serif", ("hebrew",), None),
    ("noto-sans-thai", "sans", ("thai",), None),
    ("noto-serif-thai", "serif", ("thai",), None),
    ("sarabun", "sans", ("thai",), None),
    ("kanit", "sans", ("thai",), None),
    ("noto-sans-sc", "sans", ("han",), "sc"),
    ("noto-serif-sc", "serif", ("han",), "sc"),
    ("noto-sans-tc", "sans", ("han",), "tc"),
    ("noto-sans-jp", "sans", ("han", "kana"), "jp"),
    ("noto-serif-jp", "serif", ("han", "kana"), "jp"),
    ("noto-sans-kr", "sans", ("hangul", "han"), "kr"),
    ("noto-serif-kr", "serif", ("hangul", "han"), "kr"),
    ("caveat", "handwriting", ("latin", "cyrillic"), None),
    ("patrick-hand", "handwriting", ("latin",), None),
    ("indie-flower", "handwriting", ("latin",), None),
    ("reenie-beanie", "handwriting", ("latin",), None),
    ("kalam", "handwriting", ("latin", "devanagari"), None),
    ("aref-ruqaa", "handwriting", ("arabic",), None),
    ("sriracha", "handwriting", ("thai",), None),
    ("ma-shan-zheng", "handwriting", ("han",), "sc"),
    ("klee-one", "handwriting", ("han", "kana"), "jp"),
    ("nanum-pen-script", "handwriting", ("hangul",), "kr"),
)
#: Glyphs that a stand-in draws unlike its models, and the font to borrow them from (fixed value).
GLYPH_DEFAULTS = {("arimo", "1"): "roboto"}
#: Fonts that draw what a family can't, by script (fixed values): sans, serif, handwriting.
FALLBACKS = {
    "latin": ("noto-sans", "noto-serif", "caveat"),
    "cyrillic": ("noto-sans", "noto-serif", "caveat"),
    "greek": ("noto-sans", "noto-serif", "noto-sans"),
    "neutral": ("noto-sans", "noto-serif", "noto-sans"),
    "devanagari": ("noto-sans-devanagari", "noto-serif-devanagari", "kalam"),
    "arabic": ("noto-sans-arabic", "noto-naskh-arabic", "aref-ruqaa"),
    "hebrew": ("noto-sans-hebrew", "noto-serif-hebrew", "noto-sans-hebrew"),
    "thai": ("noto-sans-thai", "noto-serif-thai", "sriracha"),
    "han": ("noto-sans-sc", "noto-serif-sc", "ma-shan-zheng"),
    "kana": ("noto-sans-jp", "noto-serif-jp", "klee-one"),
    "hangul": ("noto-sans-kr", "noto-serif-kr", "nanum-pen-script"),
    "bengali": ("noto-sans-bengali", "noto-serif-bengali", "noto-sans-bengali"),
    "gurmukhi": ("noto-sans-gurmukhi", "noto-serif-gurmukhi", "noto-sans-gurmukhi"),
    "gujarati": ("noto-sans-gujarati", "noto-serif-gujarati", "noto-sans-gujarati"),
    "tamil": ("noto-sans-tamil", "noto-serif-tamil", "noto-sans-tamil"),
    "telugu": ("noto-sans-telugu", "noto-serif-telugu", "noto-sans-telugu"),
    "kannada": ("noto-sans-kannada", "noto-serif-kannada", "noto-sans-kannada"),
    "malayalam": ("noto-sans-malayalam", "noto-serif-malayalam", "noto-sans-malayalam"),
}
REGION_FALLBACKS = {
    "sc": ("noto-sans-sc", "noto-serif-sc", "ma-shan-zheng"),
    "tc": ("noto-sans-tc", "noto-sans-tc", "noto-sans-tc"),
    "jp": ("noto-sans-jp", "noto-serif-jp", "klee-one"),
    "kr": ("noto-sans-kr", "noto-serif-kr", "nanum-pen-script"),
}


def font_rows() -> list[tuple[int, str, str, list[str], str | None]]:
    return [(k, font, category, list(scripts), region) for k, (font, category, scripts, region) in enumerate(FONTS)]


def slice_rows() -> list[tuple[str, str, int, int]]:
    """(font, slice, lo, hi): code points that a font draws, by rule, as no coverage data come with the fonts.

    A font draws the blocks of its scripts and basic punctuation and digits; families of other scripts also carry Latin
    letters, as a secondary design. One slice a script.
    """
    out = []
    for _, font, _, scripts, _ in font_rows():
        out.append((font, "latin", 0x20, 0x40))
        out.append((font, "latin", 0x5B, 0x60))
        out.append((font, "latin", 0x7B, 0xBF))
        for script in dict.fromkeys([*scripts, "latin"]):
            out += [(font, script, a, b) for a, b, s in SCRIPT_BLOCKS if s == script and b < 0x20000]
    return out


def languages(spark: SparkSession) -> DataFrame:
    rows = [(k, c, list(s), list(loc), r) for k, (c, s, loc, r) in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "ord int, code string, scripts array<string>, locales array<string>, region string")


def candidates(spark: SparkSession) -> DataFrame:
    """(key, ord, code): languages to choose from for a detected key; ANY has all."""
    rows = [(k, i, c) for k, v in SCRIPT_LANGUAGES.items() for i, c in enumerate(v)] + [(ANY, i, r[0]) for i, r in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "key string, ord int, code string")


def detected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(DETECTED.items()), "name string, key string")


def fonts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(font_rows(), "ord int, id string, category string, scripts array<string>, region string")


def font_slices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(slice_rows(), "font_id string, slice_id string, lo int, hi int")
