"""Queries over sequences, embeddings and variants, with their SQL."""

from pyspark.sql import functions as F

from .functions import codons, sequences, vectors as vec
from .functions.hashing import hash_int, uniform
from .operators import embedders, targets, validate, variants, vectors
from .queries import (LETTERS, RECORDS, SAMPLES, VARIANTS, WILD_TYPE, query, r6, read, records, samples, sql_hash, variant_rows)

MUTANTS = VARIANTS + f""", mu AS (SELECT p_partkey, array_to_string(list_transform(range(1, 51), lambda i: coalesce(list_filter(mutations, lambda m: m.position = i - 1)[1].mt,
  substr('{WILD_TYPE}', i, 1))), '') AS seq FROM v)"""
MUTANT_LETTERS = MUTANTS + ", le AS (SELECT p_partkey, seq, unnest(range(0, 50)) AS position, unnest(string_split(seq, '')) AS aa FROM mu)"


def mutants(spark, d):
    return variant_rows(spark, d).select("p_partkey", "variant", sequences.mutant_sequence(F.lit(WILD_TYPE), F.col("mutations")).alias("seq"))


# --- text of sequences ---------------------------------------------------------------------------------------------

@query(f"WITH {RECORDS} SELECT seq_id, regexp_replace(seq, '[UZOB]', 'X', 'g') AS cleaned, '<AA2fold> ' || seq AS folded, array_to_string(string_split(seq, ''), ' ') AS apart FROM records")
def preprocessed(spark, d):
    seq = F.col("seq")
    return records(spark, d).select("seq_id", sequences.clean_rare(seq).alias("cleaned"), sequences.fold_prefix(seq).alias("folded"), sequences.spaced(seq).alias("apart"))


@query(f"""WITH {RECORDS} SELECT seq_id, trim(regexp_replace(array_to_string(list_transform(string_split(replace(seq, 'QU', '#'), ''), lambda x: CASE WHEN x = '#' THEN ' QU ' ELSE x || ' ' END), ''), ' +', ' ', 'g')) AS apart FROM records""")
def spaced_around_token(spark, d):
    """A token of several letters stays whole."""
    return records(spark, d).select("seq_id", sequences.spaced(F.col("seq"), "QU").alias("apart"))


# --- residues ------------------------------------------------------------------------------------------------------

_MASK = "CASE WHEN (p_partkey + position) % 3 = 0 THEN 0 ELSE 1 END"


def masked_mutants(spark, d):
    """Mutants as records of one label per residue, with masks."""
    bit = lambda i: F.when((F.col("p_partkey") + i) % 3 == 0, "0").otherwise("1")
    mask = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), bit), "")
    return mutants(spark, d).withColumns({"labels": sequences.residue_labels(F.col("seq")), "mask_bits": sequences.mask_bits(mask), "mask": mask})


@query(f"WITH {MUTANT_LETTERS} SELECT aa AS label, count(*) AS n FROM le WHERE {_MASK} = 1 GROUP BY 1")
def residue_label_counts(spark, d):
    return targets.exploded_residues(masked_mutants(spark, d)).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {MUTANTS} SELECT p_partkey FROM mu WHERE p_partkey % 4 = 0")
def masks_without_residues(spark, d):
    r = masked_mutants(spark, d).withColumn("mask", F.when(F.col("p_partkey") % 4 == 0, F.repeat(F.lit("0"), F.lit(50))).otherwise(F.col("mask")))
    return validate.masks_without_residues(r).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'length differs' ELSE 'not a number' END AS problem FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def validate_targets_per_residue(spark, d):
    one = F.when(F.col("p_partkey") % 3 == 0, "1;2").when(F.col("p_partkey") % 5 == 0, "1;x;3").otherwise("1;2;3.5")
    r = read(spark, d, "part").select("p_partkey", F.lit("ACD").alias("seq"), F.lit("train").alias("set"), one.alias("target"))
    return validate.bad_targets(r, True, True).select("p_partkey", "problem")


@query("SELECT 'some' AS kind, count(embedding) AS with_embedding, count(*) AS n FROM (SELECT CASE WHEN vec_id % 2 = 0 THEN embedding END AS embedding FROM embeddings)")
def validate_embeddings_all_or_none(spark, d):
    e = read(spark, d, "embeddings")
    some = e.select(F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("embedding"))
    found = validate.embeddings_all_or_none(some).withColumn("kind", F.lit("some"))
    return found.unionByName(validate.embeddings_all_or_none(e).withColumn("kind", F.lit("all"))).select("kind", "with_embedding", "n")


@query("SELECT vec_id, len(embedding) AS width, len(embedding) - vec_id % 3 AS n FROM embeddings WHERE vec_id % 3 <> 0")
def validate_residue_lengths(spark, d):
    e = read(spark, d, "embeddings").withColumn("labels", F.slice("embedding", F.lit(1), (F.size("embedding") - F.col("vec_id") % 3).cast("int")))
    return validate.other_lengths(e, "embedding", "labels").select("vec_id", F.size("embedding").cast("long").alias("width"), F.size("labels").cast("long").alias("n"))


@query(f"WITH {RECORDS} SELECT CASE WHEN seq = '' THEN seq_id ELSE sha256(seq || '_' || length(seq)::VARCHAR) END AS seq_hash, count(*) AS n FROM records GROUP BY 1 HAVING count(*) > 1")
def validate_unique_hashes(spark, d):
    return validate.duplicate_hashes(records(spark, d))


@query(f"""WITH {RECORDS} SELECT CASE WHEN seq = '' THEN seq_id ELSE sha256(seq || '_' || length(seq)::VARCHAR) END AS seq_hash, string_agg(seq_id, ';' ORDER BY seq_id) AS ids FROM records GROUP BY 1""")
def ids_by_hash(spark, d):
    return validate.ids_by_hash(records(spark, d)).select("seq_hash", F.array_join("ids", ";").alias("ids"))


# --- embeddings ----------------------------------------------------------------------------------------------------

_SCALES = {a: (float(i % 7) - 3, float(i * i % 11), float(i) / 4) for i, a in enumerate(sequences.ALPHABET) if a != "W"}
_SCALE_ROWS = ", ".join(f"('{a}', [{x[0]}, {x[1]}, {x[2]}])" for a, x in _SCALES.items())


@query(f"""WITH {MUTANT_LETTERS}, sc AS (SELECT * FROM (VALUES {_SCALE_ROWS}) t(letter, v)), z AS (SELECT p_partkey, coalesce(sc.v, (SELECT v FROM sc WHERE letter = 'X')) AS v FROM le LEFT JOIN sc ON letter = aa)
SELECT p_partkey, round(avg(v[1]), 6) AS a, round(avg(v[2]), 6) AS b, round(avg(v[3]), 6) AS c FROM z GROUP BY p_partkey""")
def residue_scales_pooled(spark, d):
    table = spark.createDataFrame([(a, list(x)) for a, x in _SCALES.items()], "letter string, values array<double>")
    found = embedders.pooled(embedders.scale_residues(mutants(spark, d), table))
    return found.select("p_partkey", *[r6(F.col("embedding")[i]).alias(c) for i, c in enumerate("abc")])


@query(f"""SELECT p_partkey, round(sum(u), 6) AS total, round(max(u), 6) AS most FROM (SELECT p_partkey, {sql_hash("'42'", 'p_partkey', 'i')} / 4294967296.0 AS u FROM (SELECT p_partkey, unnest(range(0, 128)) AS i FROM part)) GROUP BY p_partkey""")
def random_embedding(spark, d):
    e = embedders.random_vectors(read(spark, d, "part"), "p_partkey")
    return e.select("p_partkey", r6(vec.total(F.col("embedding"))).alias("total"), r6(F.array_max("embedding")).alias("most"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, length(text) AS l FROM conversations),
w AS (SELECT conv_id, 0::BIGINT AS i, -1::BIGINT AS open, 0::BIGINT AS used, 0::BIGINT AS nxt, 0::BIGINT AS batch, 0::BIGINT AS l FROM (SELECT DISTINCT conv_id FROM c)
UNION ALL SELECT w.conv_id, c.i, CASE WHEN c.l > 400 THEN w.open WHEN w.open < 0 OR w.used + c.l >= 400 THEN w.nxt ELSE w.open END,
 CASE WHEN c.l > 400 THEN w.used WHEN w.open < 0 OR w.used + c.l >= 400 THEN c.l ELSE w.used + c.l END,
 w.nxt + CASE WHEN c.l > 400 OR w.open < 0 OR w.used + c.l >= 400 THEN 1 ELSE 0 END,
 CASE WHEN c.l > 400 OR w.open < 0 OR w.used + c.l >= 400 THEN w.nxt ELSE w.open END, c.l FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1)
SELECT conv_id, batch, count(*) AS n, sum(l)::BIGINT AS total FROM w WHERE i > 0 GROUP BY ALL""")
def token_budget_batches(spark, d):
    c = read(spark, d, "conversations").withColumn("l", F.length("text"))
    return embedders.budget_batches(c, ["conv_id"], ["turn", "text"], "l", 400)


@query("""SELECT vec_id, round(list_sum(list_transform(list_filter(range(1, len(embedding) + 1), lambda i: i NOT IN (1, 2, 64) AND (i - 1) <> vec_id % 10), lambda i: embedding[i]::DOUBLE)), 4) AS total FROM embeddings""")
def special_positions_removed(spark, d):
    drop = F.array(F.lit(0), F.lit(1), F.lit(63), (F.col("vec_id") % 10).cast("int"))
    return read(spark, d, "embeddings").select("vec_id", r6(vec.total(vec.doubles(embedders.without_positions(F.col("embedding"), drop))), 4).alias("total"))


@query("SELECT vec_id, len(embedding) + 2 AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + l.quality + l.toxic, 4) AS total FROM embeddings JOIN labels l ON l.doc_id = vec_id")
def embeddings_with_values(spark, d):
    extra = read(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.array("quality", "toxic").alias("values"))
    found = vectors.append_values(read(spark, d, "embeddings"), extra, "vec_id")
    return found.select("vec_id", F.size("embedding").cast("long").alias("width"), r6(vec.total(F.col("embedding")), 4).alias("total"))


@query("""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, exp(unnest(embedding)::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, sum(e) AS t FROM x GROUP BY 1)
SELECT vec_id, arg_max(i, (e, -i))::INTEGER AS best, round(max(e / t), 6) AS top, round(min(ln(e / t)), 5) AS least FROM x JOIN s USING (vec_id) GROUP BY vec_id""")
def softmax_of_vectors(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("v"))
    return e.select("vec_id", vec.argmax(F.col("v")).alias("best"), r6(F.array_max(vec.softmax(F.col("v")))).alias("top"), r6(F.array_min(vec.log_softmax(F.col("v"))), 5).alias("least"))


@query("SELECT vec_id, len(embedding) - vec_id % 5 AS n, 64::BIGINT AS padded, true AS restored FROM embeddings")
def padded_vectors(spark, d):
    e = read(spark, d, "embeddings").withColumn("n", (F.size("embedding") - F.col("vec_id") % 5).cast("int")).withColumn("v", F.slice(vec.doubles(F.col("embedding")), F.lit(1), F.col("n")))
    p = e.withColumn("p", vec.pad(F.col("v"), 64))
    return p.select("vec_id", F.col("n").cast("long").alias("n"), F.size("p").cast("long").alias("padded"), (vec.unpad(F.col("p"), F.col("n")) == F.col("v")).alias("restored"))


# --- masked letters, codons ----------------------------------------------------------------------------------------

_U = lambda what: f"{sql_hash(repr('42' + what), 'p_partkey', 'position')} / 4294967296.0"


@query(f"""WITH {MUTANT_LETTERS}, u AS (SELECT *, {_U('d')} AS u FROM le), least AS (SELECT p_partkey, min(u) AS lo FROM u GROUP BY 1),
w AS (SELECT u.*, u < 0.15 OR (lo >= 0.15 AND u = lo) AS drawn FROM u JOIN least USING (p_partkey)),
m AS (SELECT *, CASE WHEN NOT drawn THEN aa WHEN {_U('r')} < 0.8 THEN '<mask>' WHEN {_U('r')} < 0.9 THEN substr('{LETTERS}', (floor({_U('a')} * 20) + 1)::BIGINT, 1) ELSE aa END AS said FROM w)
SELECT p_partkey, string_agg(said, '' ORDER BY position) AS masked, count(*) FILTER (drawn) AS n_drawn, sum(CASE WHEN drawn THEN instr('{sequences.ALPHABET}', aa) - 1 ELSE 0 END)::BIGINT AS targets FROM m GROUP BY p_partkey""")
def masked_letters(spark, d):
    m = embedders.masked(mutants(spark, d), "p_partkey")
    kept = F.filter("targets", lambda t: t != -100)
    return m.select("p_partkey", "masked", F.size(kept).cast("long").alias("n_drawn"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, t: a + t).alias("targets"))


_CODONS = "(VALUES " + ", ".join(f"('{a}', {c!r})" for a, c in codons.BY_LETTER.items()) + ") t(letter, codons)"
NUCLEOTIDES = MUTANT_LETTERS + f""", cd AS (SELECT p_partkey, position, codons, coalesce(product(len(codons)) OVER (PARTITION BY p_partkey ORDER BY position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS after
  FROM le JOIN {_CODONS} ON letter = aa), nu AS (SELECT p_partkey, nth, string_agg(codons[(floor(nth / after) % len(codons))::BIGINT + 1], '' ORDER BY position) AS nucleotides
  FROM cd, range(0, 5) r(nth) GROUP BY ALL)"""


def nucleotides(spark, d):
    return codons.back_translated(mutants(spark, d).select("p_partkey", "seq"), "seq", 5)


@query(f"WITH {NUCLEOTIDES} SELECT p_partkey, nth::INTEGER AS nth, nucleotides FROM nu")
def codon_expansion(spark, d):
    return nucleotides(spark, d).select("p_partkey", "nth", "nucleotides")


@query(f"""WITH {NUCLEOTIDES} SELECT p_partkey, nth::INTEGER AS nth, {', '.join(f"round((150 - length(replace(nucleotides, '{x}', ''))) / 150, 6) AS {x.lower()}" for x in codons.NUCLEOTIDES)} FROM nu""")
def nucleotide_unigrams(spark, d):
    n = nucleotides(spark, d).withColumn("u", codons.unigram_shares(F.col("nucleotides")))
    return n.select("p_partkey", "nth", *[r6(F.col("u")[i]).alias(x.lower()) for i, x in enumerate(codons.NUCLEOTIDES)])


@query(f"""WITH {NUCLEOTIDES}, t AS (SELECT p_partkey, nth, substr(nucleotides, i, 3) AS triplet FROM nu, range(1, 151, 3) r(i))
SELECT triplet, round(count(*) / (SELECT count(*) FROM nu) / 50, 6) AS share FROM t GROUP BY triplet""")
def nucleotide_triplets(spark, d):
    """The mean vector of shares, without the triplets that don't occur."""
    return codons.mean_triplet_shares(nucleotides(spark, d)).select("triplet", r6(F.col("share")).alias("share"))


# --- variant scores ------------------------------------------------------------------------------------------------

_LP = "(-5 * ({h} / 4294967296.0) - 0.1)"


@query(f"""WITH {MUTANT_LETTERS}, wt AS (SELECT i - 1 AS position, substr('{WILD_TYPE}', i, 1) AS aa FROM range(1, 51) t(i)),
w AS (SELECT sum(lp) AS pppl, exp(-avg(lp)) AS perplexity FROM (SELECT {_LP.format(h=sql_hash('position', 'aa'))} AS lp FROM wt)),
m AS (SELECT p_partkey, sum(lp) AS pppl, exp(-avg(lp)) AS perplexity FROM (SELECT p_partkey, {_LP.format(h=sql_hash('position', 'aa'))} AS lp FROM le) GROUP BY 1)
SELECT p_partkey, round(m.pppl - w.pppl, 6) AS pppl, round(m.perplexity - w.perplexity, 6) AS perplexity FROM m, w""")
def scores_against_wild_type(spark, d):
    grid = spark.range(50).select(F.col("id").cast("int").alias("position"), F.explode(F.split(F.lit(LETTERS), "")).alias("aa"))
    grid = grid.where("aa <> ''").withColumn("log_p", -5 * uniform(F.col("position"), F.col("aa")) - 0.1)
    score = lambda rows: variants.pseudo_log_likelihood(rows, F.broadcast(grid), "p_partkey", "seq")  # noqa: E731  a grid of 50 x 20
    m = mutants(spark, d).select("p_partkey", "seq")
    wild = score(spark.createDataFrame([(0, WILD_TYPE)], "p_partkey long, seq string"))
    return variants.against_wild_type(score(m), wild).select("p_partkey", r6(F.col("pppl")).alias("pppl"), r6(F.col("perplexity")).alias("perplexity"))


@query(f"""WITH {VARIANTS}, a AS (SELECT variant, max(p_partkey) AS k FROM v GROUP BY 1) SELECT variant, k / 7 AS pred, sqrt(k) AS label FROM a""")
def predicted_and_actual_variants(spark, d):
    v = variant_rows(spark, d).groupBy("variant").agg(F.max("p_partkey").alias("k"))
    return variants.matched_scores(v.select("variant", (F.col("k") / 7).alias("score")), v.select("variant", F.sqrt("k").alias("score")))


@query(f"WITH {SAMPLES} SELECT vec_id, label, role FROM s WHERE label IS NOT NULL AND vec_id % 3 <> 0")
def labelled_only(spark, d):
    """Rows whose target isn't null; raises if none is left."""
    return targets.labelled(samples(spark, d).withColumn("label", F.when(F.col("vec_id") % 3 != 0, F.col("label")))).select("vec_id", "label", "role")
