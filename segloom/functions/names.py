"""Rules about names of states, methods and files, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_state(name: Column) -> Column:
    """12_TssA -> TssA."""
    return F.regexp_replace(F.trim(name), r"^\d+_", "")


def natural_order(name: Column, width: int = 12) -> Column:
    """A string that sorts as the name does with its runs of digits read as numbers and its letters in lower case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), width, "0")).otherwise(p)), "")


def natural_key(name: str | None) -> list:
    """The same order for small lists in Python."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", (name or "").lower())]


def first_number(name: Column) -> Column:
    """The first whole number in a name, null if there is none."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint")


# Names of states by class.
PROMOTER_CORE = ["Tss", "TssA", "TssAFlnk"]
PROMOTER_FLANK = ["TssFlnk", "TssFlnkU", "TssFlnkD"]
DISTAL_ENHANCER = ["Enh", "EnhA", "EnhAFlnk", "Enh1", "Enh2"]
GENIC_ENHANCER = ["EnhG", "EnhG1", "EnhG2", "EnhLo"]
TRANSCRIBED = ["Tx", "TxA", "TxWk", "TxFlnk"]
TRANSCRIBED_CORE = ["Tx", "TxA", "TxFlnk"]
BIVALENT = ["TssBiv", "BivFlnk", "EnhBiv", "Biv"]

#: State classes by name; a state is in a class if its name without number is in the list.
CLASSES = {
    "promoter_core": PROMOTER_CORE,
    "promoter_flank": PROMOTER_FLANK,
    "promoter": PROMOTER_CORE + PROMOTER_FLANK,
    "distal_enhancer": DISTAL_ENHANCER,
    "genic_enhancer": GENIC_ENHANCER,
    "enhancer": DISTAL_ENHANCER + GENIC_ENHANCER,
    "active_open": PROMOTER_CORE + DISTAL_ENHANCER,
    "active": PROMOTER_CORE + PROMOTER_FLANK + DISTAL_ENHANCER + GENIC_ENHANCER,
    "transcribed": TRANSCRIBED,
    "transcribed_core": TRANSCRIBED_CORE,
    "bivalent": BIVALENT,
}


def in_class(name: Column, which: str) -> Column:
    return normalize_state(name).isin(CLASSES[which])


def is_quiescent(name: Column) -> Column:
    low = F.lower(normalize_state(name))
    return low.startswith("quies") | (low == "background")


def is_background(name: Column) -> Column:
    low = F.lower(normalize_state(name))
    return is_quiescent(name) | low.rlike("het|znf|rpts|reprpc")


# Callers, and other names of the models without a caller.
CALLERS = ["homer", "macs2", "omni"]
INDIVIDUAL = ["chromhmm", "default_chromhmm", "chromhmm_default", "ref_15", "individual"]
JOINT = ["joint_chromhmm", "joint_ref_15", "joint"]
METRICS = ["jaccard", "kappa", "cosine", "ami"]


def _plain(name: Column, aliases: dict[str, str] | None) -> Column:
    """A name in lower case with longer spellings of a caller (aliases: spelling to caller) made short."""
    low = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
    for spelling, caller in (aliases or {}).items():
        low = F.replace(low, F.lit(spelling.lower()), F.lit(caller))
    return low


def normalize_method(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Key of a method from any of its names, null if it is unknown."""
    low = _plain(name, aliases)
    joint = low.startswith("joint_")
    core = F.regexp_replace(low, "^joint_", "")
    core = F.when(core.startswith("kmeans_"), F.substring(core, 8, 1000)).otherwise(F.regexp_replace(core, "_kmeans$", ""))
    key = F.when(joint, F.concat(F.lit("joint_kmeans_"), core)).otherwise(F.concat(F.lit("kmeans_"), core))
    return F.when(low.isin(INDIVIDUAL), "chromhmm_default").when(low.isin(JOINT), "joint_chromhmm").when(core.isin(CALLERS), key)


def normalize_metric(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.isin(METRICS), low)


def caller_of(method: Column, aliases: dict[str, str] | None = None) -> Column:
    """Caller of a method key: one of the peak callers, else that of the default model."""
    got = F.regexp_extract(_plain(method, aliases), r"(?:^|_)(homer|macs2|omni)(?:_|$)", 1)
    return F.when(got == "", "chromhmm").otherwise(got)


def is_joint(method: Column) -> Column:
    return F.lower(method).contains("joint")


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def segmentation_label(path: Column) -> Column:
    """Method key, with its replicate, from the path of a segmentation file."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.substring_index(unix, "/", -1)
    part = lambda names: F.regexp_extract(unix, rf"(?:^|/)({names})(?=/|$)", 1)
    caller, rep = part("omni|homer|macs2"), part("(?:rep|replicate)[12]")
    rep = F.when(rep == "", F.regexp_extract(base, r"^((?:rep|replicate)[12])_", 1)).otherwise(rep)
    rep = F.replace(rep, F.lit("replicate"), F.lit("rep"))
    named = lambda stem: F.when(caller == "", stem).otherwise(F.concat(F.lit(stem + "_"), caller))
    under = lambda folder: unix.rlike(rf"(^|/){folder}(/|$)")
    model = (
        F.when(base.contains("kmeans_states"), named("kmeans"))
        .when(under("joint_kmeans") | base.contains("joint_kmeans"), named("joint_kmeans"))
        .when(under("joint_chromhmm") | base.contains("joint_chromhmm"), "joint_chromhmm")
        .when(under("chromhmm_default_result"), "chromhmm_default")
        .otherwise(F.replace(F.replace(base, F.lit(".bed"), F.lit("")), F.lit("_matched"), F.lit("")))
    )
    return F.when(base.startswith("ENCFF"), F.replace(base, F.lit(".bed"), F.lit(""))).otherwise(F.when(rep == "", model).otherwise(F.concat(model, F.lit("_"), rep)))


def is_replicate(label: Column) -> Column:
    return label.endswith("_rep1") | label.endswith("_rep2")


def is_replicate_pair(one: Column, two: Column) -> Column:
    """The two replicates of one method."""
    return is_replicate(one) & is_replicate(two) & (one != two) & (F.regexp_replace(one, "_rep[12]$", "") == F.regexp_replace(two, "_rep[12]$", ""))


def should_compare(one: Column, two: Column) -> Column:
    """A pooled labelling with a reference, or two replicates of one method."""
    ref1, ref2 = one.startswith("ENCFF"), two.startswith("ENCFF")
    alike = is_replicate(one) & is_replicate(two) & (F.regexp_replace(one, "_rep[12]$", "") == F.regexp_replace(two, "_rep[12]$", ""))
    return F.when(ref1, ~is_replicate(two)).when(ref2, ~is_replicate(one)).otherwise(alike)


def bin_size(label: Column, fine: int = 100, coarse: int = 200) -> Column:
    """Bin of a labelling: coarse for the default model and references, fine for those of peak callers."""
    return F.when(caller_of(label) == "chromhmm", coarse).otherwise(fine)


def parse_mapping(text: Column) -> Column:
    """'w=r;w=r' -> map."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(";"), F.lit("=")))


def rgb_hex(rgb: Column) -> Column:
    """'255,0,10' -> '#FF000A'; black and what is not a colour are unset (null)."""
    parts = F.transform(F.split(rgb, ","), lambda x: F.trim(x).try_cast("int"))
    good = (F.size(parts) == 3) & F.forall(parts, lambda x: x.between(0, 255))
    text = F.concat(F.lit("#"), *(F.lpad(F.hex(F.get(parts, F.lit(i))), 2, "0") for i in range(3)))
    return F.when(good & (text != "#000000"), text)


def flag(value: Column, default: bool = True) -> Column:
    """A flag that may come as text; null takes the default."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(value.isNull(), F.lit(default)).otherwise(~low.isin("false", "0", "no", "", "none"))
