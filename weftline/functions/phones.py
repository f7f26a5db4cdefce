"""Phone classes, contexts, and the mapping between two phone sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phone classes and the phone-set mapping.
VOWELS = "aa ae ah ao aw ax ay eh er ey ih ix iy ow oy uh uw ux axr".split()
CONSONANTS = "b ch d dh dx f g hh hv jh k l m n ng nx p r s sh t th v w y z zh q".split()
CLASSES = {
    "V": VOWELS,
    "C": CONSONANTS,
    "stop": "b p d t g k dx q".split(),
    "fric": "f v th dh s z sh zh hh hv".split(),
    "nasal": "m n ng nx em en eng".split(),
    "liquid": "l r el".split(),
    "glide": "w y".split(),
    "syllabic": "em en eng el axr".split(),
}
SILENCES = ("epi", "pau", "h#")
#: Phones whose target is not simply their upper case; q is dropped.
SPECIAL_TARGETS = {"ax": "AH", "ix": "IH", "ux": "UW", "axr": "ER", "ax-h": "AH", "em": "M", "en": "N", "eng": "NG", "el": "L", "nx": "N", "dx": "D", "q": "", "hv": "HH"}
TARGET_VOWELS = "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split()


def spoken(label: str) -> Column:
    """Whether a label is a phone: no closure, pause or silence."""
    return ~(F.col(label).endswith("cl") | F.col(label).isin(*SILENCES))


def simplified(label: str) -> Column:
    return F.when(F.col(label) == "ax-h", "ax").otherwise(F.col(label))


def phone_classes(phone: Column) -> Column:
    """All feature classes of a phone."""
    return F.filter(F.array(*[F.when(phone.isin(members), name) for name, members in CLASSES.items()]), lambda x: x.isNotNull())


def side(phone: Column) -> Column:
    """V, C, or # for a word edge and for phones in neither class."""
    return F.when(phone.isin(VOWELS), "V").when(phone.isin(CONSONANTS), "C").otherwise("#")


def with_context(phones: DataFrame, word: list[str], order: str, phone: str = "phone") -> DataFrame:
    """Adds ctx, such as V_#, from the neighbours of each phone in its word."""
    by = Window.partitionBy(*word).orderBy(order)
    return phones.withColumn("ctx", F.concat_ws("_", side(F.lag(phone).over(by)), side(F.lead(phone).over(by))))


def to_target(phone: Column) -> Column:
    """A phone in the target set; empty if it has none."""
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_TARGETS.items() for x in pair])
    return F.coalesce(F.try_element_at(special, phone), F.upper(phone))


def stress(phone: Column) -> tuple[Column, Column]:
    """(base, stress digits) of a target phone."""
    return F.regexp_replace(phone, r"\d", ""), F.regexp_replace(phone, r"\D", "")


def dialect(path: Column) -> Column:
    found = F.regexp_extract(path, r"/(DR\d)/", 1)
    return F.when(found != "", found)
