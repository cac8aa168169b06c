"""Codons of amino acids, and composition of nucleotide sequences."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import chunks

#: The codons of each letter, in the order in which expansions use them; X is the masked letter.
CODONS = """A GCT GCC GCA GCG
R CGT CGC CGA CGG AGA AGG
N AAT AAC
D GAT GAC
C TGT TGC
Q CAA CAG
E GAA GAG
G GGT GGC GGA GGG
H CAT CAC
I ATT ATC ATA
L CTT CTC CTA CTG TTA TTG
K AAA AAG
M ATG
F TTT TTC
P CCT CCC CCA CCG
S TCT TCC TCA TCG AGT AGC
T ACT ACC ACA ACG
W TGG
Y TAT TAC
V GTT GTC GTA GTG
* TAA TGA TAG
X XXX"""
BY_LETTER = {line[0]: line.split()[1:] for line in CODONS.splitlines()}
NUCLEOTIDES = "ACTG"
TRIPLETS = sorted(c for cs in BY_LETTER.values() for c in cs if "X" not in c)


def _table() -> Column:
    return F.create_map(*[x for letter, codons in BY_LETTER.items() for x in (F.lit(letter), F.array(*map(F.lit, codons)))])


def back_translated(rows: DataFrame, seq: str, n: int, out: str = "nucleotides") -> DataFrame:
    """Each row up to ``n`` times with ``nth`` (from 0) and the nth nucleotide sequence that stands for ``seq``; the last letter's codon changes first.

    The nth sequence is read off the digits of n, in the mixed base of the letters' numbers of codons, so no product is built. Only the last letters, which have ``n`` sequences
    between them, are written anew for each; what stands before them is written once. Letters without a codon give no row.
    """
    letters = F.filter(F.split(seq, ""), lambda x: x != "")
    each = rows.withColumn("_c", F.transform(F.reverse(letters), lambda x: F.try_element_at(_table(), x))).where(F.forall("_c", lambda c: c.isNotNull()))
    enough = F.aggregate("_c", F.struct(F.lit(1).cast("long").alias("product"), F.lit(0).alias("k")), lambda s, c: F.when(s["product"] >= n, s).otherwise(
        F.struct((s["product"] * F.size(c)).alias("product"), (s["k"] + 1).alias("k"))), lambda s: s["k"])
    each = each.withColumns({"_k": enough, "_first": F.array_join(F.transform(F.reverse("_c"), lambda c: c[0]), "")})
    kept = [c for c in rows.columns if c != "nth"]
    each = each.select(*kept, F.slice("_c", F.lit(1), F.col("_k")).alias("_last"), F.substring("_first", F.lit(1), (F.size("_c") - F.col("_k")) * 3).alias("_head"),
                       F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("nth"))
    start = F.struct(F.col("nth").cast("long").alias("rest"), F.lit("").alias("text"))
    done = F.aggregate("_last", start, lambda s, c: F.struct(
        F.floor(s["rest"] / F.size(c)).cast("long").alias("rest"),
        F.concat(F.element_at(c, (s["rest"] % F.size(c) + 1).cast("int")), s["text"]).alias("text")))
    found = F.inline(F.filter(F.array(done), lambda x: x["rest"] == 0)).alias("_rest", "_text")  # a filter over a column of it would make it anew for each use
    return each.select(*kept, "_head", "nth", found).withColumn(out, F.concat("_head", "_text")).drop("_head", "_rest", "_text")


def unigram_shares(nucleotides: Column) -> Column:
    """The shares of A, C, T and G; masked letters count in none."""
    return F.array(*[(F.length(nucleotides) - F.length(F.replace(nucleotides, F.lit(x)))) / F.length(nucleotides) for x in NUCLEOTIDES])


def triplet_shares(nucleotides: Column) -> Column:
    """The share of each of the 64 triplets, in alphabetical order, among the triplets end to end; masked ones count in none."""
    found = chunks(nucleotides)
    return F.transform(F.array(*map(F.lit, TRIPLETS)), lambda t: F.size(F.filter(found, lambda x: x == t)) / F.size(found))


def mean_triplet_shares(rows: DataFrame, nucleotides: str = "nucleotides") -> DataFrame:
    """triplet and share, the mean of ``triplet_shares`` over all rows, of the triplets that occur. Triplets are counted by the number of them in their row, so that the sums are whole numbers
    and a task shuffles a row for each triplet and number."""
    sized = rows.select(chunks(F.col(nucleotides)).alias("_t"))
    each = sized.select(F.size("_t").alias("_of"), F.posexplode_outer("_t").alias("_i", "triplet"))
    counts = each.groupBy("triplet", "_of").agg(F.count("*").alias("n"), F.count_if(F.coalesce("_i", F.lit(0)) == 0).alias("_rows"))
    counts = counts.withColumn("_rows", F.sum("_rows").over(Window.partitionBy()))  # a row for each triplet and number
    known = counts.where(F.col("triplet").isin(TRIPLETS))
    return known.groupBy("triplet").agg((F.sum(F.col("n") / F.col("_of")) / F.max("_rows")).alias("share"))
