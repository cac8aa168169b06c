"""Functions of sequences, mutations and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters in order, and the unknown one.
ALPHABET = "ACDEFGHIKLMNPQRSTVWXY"
UNKNOWN = "X"


def clean_rare(seq: Column) -> Column:
    return F.regexp_replace(seq, "[UZOB]", UNKNOWN)


def spaced(seq: Column, mask: str | None = None) -> Column:
    """Letters apart by blanks; occurrences of the mask token stay whole."""
    if not mask:
        return F.array_join(F.split(seq, ""), " ")
    parts = F.transform(F.split(seq, r"\Q" + mask + r"\E"), lambda p: F.when(p == "", "").otherwise(F.array_join(F.split(p, ""), " ")))
    return F.trim(F.regexp_replace(F.array_join(parts, f" {mask} "), " +", " "))


def fold_prefix(seq: Column) -> Column:
    return F.concat(F.lit("<AA2fold> "), seq)


def letter_index(letter: Column) -> Column:
    """Position in the alphabet, from 0; letters outside of it count as unknown."""
    return F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), letter), F.lit(0)), F.lit(ALPHABET.index(UNKNOWN) + 1)) - 1


def one_hot(letter: Column) -> Column:
    at = letter_index(letter)
    return F.transform(F.sequence(F.lit(0), F.lit(len(ALPHABET) - 1)), lambda i: (i == at).cast("float"))


def residue_labels(target: Column) -> Column:
    """A label per residue from a string of one-letter labels."""
    return F.split(target, "")


def residue_values(target: Column) -> Column:
    """A value per residue from numbers apart by semicolons; unreadable ones are null."""
    return F.transform(F.split(target, ";"), lambda x: x.try_cast("double"))


def mask_bits(mask: Column) -> Column:
    return F.transform(F.split(mask, ""), lambda x: x.cast("int"))


def parse_variant(variant: Column, one_indexed: bool = True) -> Column:
    """``A15G:K20R`` as an array of (wt, position from 0, mt); null if a part can't be read or a position occurs twice."""
    part = lambda m: F.struct(F.substring(m, 1, 1).alias("wt"), (m.substr(F.lit(2), F.length(m) - 2).try_cast("int") - int(one_indexed)).alias("position"),
                              F.substring(m, -1, 1).alias("mt"))
    parsed = F.transform(F.split(variant, ":"), part)
    sound = F.forall(F.split(variant, ":"), lambda m: m.rlike("^[A-Za-z][0-9]+[A-Za-z]$"))
    apart = F.size(F.array_distinct(F.transform(parsed, lambda m: m["position"]))) == F.size(parsed)
    return F.when(sound & apart, parsed)


def _put(seq: Column, mutations: Column, old: str, new: str) -> Column:
    fits = F.forall(mutations, lambda m: F.substring(seq, m["position"] + 1, 1) == m[old])
    done = F.aggregate(mutations, seq, lambda s, m: F.overlay(s, m[new], m["position"] + 1))
    return F.when(fits, done)


def mutant_sequence(wild_type: Column, mutations: Column) -> Column:
    """The sequence with all mutations; null if a residue to be replaced isn't there."""
    return _put(wild_type, mutations, "wt", "mt")


def wild_type_sequence(mutant: Column, mutations: Column) -> Column:
    return _put(mutant, mutations, "mt", "wt")


def set_name(raw: Column) -> Column:
    """train, val, pred or the lower-cased name of a test set; older spellings of val count."""
    low = F.lower(F.trim(raw))
    return F.when(low.startswith("train"), "train").when(low.isin("val", "validation", "valid", "dev"), "val").when(low.isin("pred", "predict"), "pred").otherwise(low)


def kmers(seq: Column, k: int = 3) -> Column:
    """All overlapping runs of k letters, in one scan."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def chunks(seq: Column, k: int = 3) -> Column:
    """Runs of k letters end to end, the last one shorter if need be."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{k}}}"), F.lit(0))
