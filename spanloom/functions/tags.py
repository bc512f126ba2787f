"""Part-of-speech sets and tag crosswalks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag sets of English and Chinese treebanks. The plain base form VB is not in the verbs.
VERBS = ("VA", "VC", "VE", "VV", "VBD", "VBG", "VBN", "VBP", "VBZ")
NOUNS = ("NR", "NT", "NN", "NNS", "NNP", "NNPS")
PROPER_NOUNS = ("NR", "NNP", "NNPS")
PRONOUNS = ("PN", "WP", "WP$", "PRP", "PRP$")

#: First letters of content tags and the lexical category that each stands for.
LEXICAL = {"J": "ADJECTIVE", "R": "ADVERB", "N": "NOUN", "V": "VERB"}
FRAME_LEXICAL = {"A": "ADJECTIVE", "ADV": "ADVERB", "N": "NOUN", "V": "VERB"}

#: Frame lexicon tag -> treebank tags.
FRAME_TO_TREEBANK = {
    "A": ("JJ", "JJR", "JJS"), "ADV": ("RB", "RBR", "RBS"), "ART": ("DT", "PDT"), "C": ("CC",), "INTJ": ("UH",), "N": ("NN", "NNP", "NNPS", "NNS"),
    "NUM": ("CD",), "PREP": ("IN",), "SCON": ("IN",), "V": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"),
}

#: Tags of punctuation and other tokens without content.
NUISANCE = ("", "NFP", "HYPH", "LS", "UH", "-LRB-", "-RRB-", ":", ",", ".", "``", "''", "SYM")


def is_verb(tag: Column) -> Column:
    return tag.isin(*VERBS)


def is_noun(tag: Column) -> Column:
    return tag.isin(*NOUNS)


def is_proper_noun(tag: Column) -> Column:
    return tag.isin(*PROPER_NOUNS)


def is_pronoun(tag: Column) -> Column:
    return tag.isin(*PRONOUNS)


def is_content(tag: Column) -> Column:
    """Tags that begin with V, N, R or J."""
    return F.substring(tag, 1, 1).isin("V", "N", "R", "J")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def lexical_category(treebank_tag: Column) -> Column:
    """Adjective, adverb, noun or verb by the tag's first letter, else null."""
    return _lookup(LEXICAL, F.substring(treebank_tag, 1, 1))


def lexical_category_of_frame_tag(tag: Column) -> Column:
    return _lookup(FRAME_LEXICAL, tag)


def frame_tag(treebank_tag: Column) -> Column:
    """The frame lexicon's tag of a treebank tag; IN is PREP, the one tag that two share."""
    back = {t: k for k, v in FRAME_TO_TREEBANK.items() for t in v} | {"IN": "PREP"}
    return _lookup(back, treebank_tag)
