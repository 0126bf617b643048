"""Part-of-speech tags: the reading of each notation, and the maps between tagsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brown tags and their nearest Penn Treebank tags.
BROWN_TO_PENN = {
    "AT": "DT", "DT": "DT", "DTI": "DT", "DTS": "DT", "DTX": "DT",
    "ABL": "PDT", "ABN": "PDT", "ABX": "PDT",
    "AP": "JJ",
    "CC": "CC", "CS": "IN",
    "CD": "CD", "OD": "JJ",
    "BE": "VB", "BED": "VBD", "BEDZ": "VBD", "BEG": "VBG",
    "BEM": "VBP", "BEN": "VBN", "BER": "VBP", "BEZ": "VBZ",
    "DO": "VB", "DOD": "VBD", "DOZ": "VBZ",
    "HV": "VB", "HVD": "VBD", "HVG": "VBG", "HVN": "VBN", "HVZ": "VBZ",
    "EX": "EX", "FW": "FW", "UH": "UH",
    "IN": "IN", "MD": "MD", "RP": "RP", "TO": "TO",
    "JJ": "JJ", "JJR": "JJR", "JJS": "JJS", "JJT": "JJS",
    "NN": "NN", "NN$": "NN", "NNS": "NNS", "NNS$": "NNS",
    "NP": "NNP", "NP$": "NNP", "NPS": "NNPS", "NPS$": "NNPS",
    "NR": "NN", "NR$": "NN", "NRS": "NNS", "NC": "NN",
    "PN": "NN", "PN$": "NN",
    "PP$": "PRP$", "PP$$": "PRP",
    "PPL": "PRP", "PPLS": "PRP", "PPO": "PRP", "PPS": "PRP", "PPSS": "PRP",
    "QL": "RB", "QLP": "RB",
    "RB": "RB", "RBR": "RBR", "RBT": "RBS", "RN": "RB",
    "*": "RB",
    "VB": "VB", "VBD": "VBD", "VBG": "VBG", "VBN": "VBN",
    "VBP": "VBP", "VBZ": "VBZ",
    "WDT": "WDT", "WP$": "WP$", "WPO": "WP", "WPS": "WP",
    "WQL": "WRB", "WRB": "WRB",
    ".": ".", ",": ",", ":": ":", "(": "-LRB-", ")": "-RRB-",
    "``": "``", "''": "''", "--": ":",
    "NIL": "X",
}
# Universal tags and their most frequent Penn Treebank tags.
UNIVERSAL_TO_PENN = {
    "NOUN": "NN", "VERB": "VBD", "ADJ": "JJ", "ADV": "RB", "PRON": "PRP", "DET": "DT",
    "ADP": "IN", "CONJ": "CC", "PRT": "RP", "NUM": "CD", "X": "FW", ".": ".",
}
# Suffixes that mark a use of a word and not its part of speech, in the order in which they are taken off.
BROWN_SUFFIXES = ("-HL", "-TL", "-NC", "-TL-HL", "-NC-TL")
# Feature values and their short forms in a tag.
MORPHOLOGY = {
    "Gender": {"Fem": "Fem", "Masc": "Masc", "Neut": "Neut", "Com": "Com"},
    "Number": {"Sing": "Sg", "Plur": "Pl", "Dual": "Du", "Ptan": "Pl", "Coll": "Sg"},
    "Person": {"1": "1", "2": "2", "3": "3"},
    "Case": {"Nom": "Nom", "Acc": "Acc", "Dat": "Dat", "Gen": "Gen"},
}
AGREEMENT = ("Gender", "Number")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def normalise_brown_tag(tag: Column) -> Column:
    """Without marks of use, joins and negation; an empty tag is X."""
    t = F.upper(F.trim(F.coalesce(tag, F.lit(""))))
    for suffix in BROWN_SUFFIXES:
        t = F.regexp_replace(t, f"{suffix}$", "")
    t = F.regexp_replace(F.regexp_replace(t, "\\+.*$", ""), "(.)\\*$", "$1")
    return F.regexp_replace(t, "^$", "X")


def brown_to_penn(tag: Column) -> Column:
    return F.coalesce(_lookup(BROWN_TO_PENN, normalise_brown_tag(tag)), F.lit("X"))


def universal_to_penn(tag: Column) -> Column:
    return F.coalesce(_lookup(UNIVERSAL_TO_PENN, tag), F.lit("NN"))


def parse_features(field: Column) -> Column:
    """`A=x,y|B=z` as a map with the first alternative of each; items without = are passed over."""
    items = F.filter(F.split(F.coalesce(field, F.lit("_")), "\\|"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(
        F.array_sort(F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), F.substring_index(F.substring_index(x, "=", -1), ",", 1).alias("value"))))
    )


def morph_tag(pos: Column, features: Column, names: tuple[str, ...] = AGREEMENT) -> Column:
    """The tag with the short forms of its agreement features; unknown values are left out."""
    return F.concat_ws("-", pos, *(_lookup(MORPHOLOGY[n], F.try_element_at(features, F.lit(n))) for n in names))


def coarse_tag(tag: Column) -> Column:
    """What stands before the first hyphen; a tag that starts with one is unchanged."""
    return F.when(F.startswith(tag, F.lit("-")), tag).otherwise(F.substring_index(tag, "-", 1))


def tag_feature(tag: Column, name: str) -> Column:
    """The short form of a feature that a tag carries, or null."""
    shorts = sorted(set(MORPHOLOGY[name].values()))
    found = F.filter(F.slice(F.split(tag, "-"), 2, 9), lambda x: x.isin(shorts))
    return F.try_element_at(found, F.lit(1))
