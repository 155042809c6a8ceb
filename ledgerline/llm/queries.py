"""The registered opN queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.bpe_lexicon import encode
from ledgerline.llm.chroma import align, best_match, fingerprints, melodies
from ledgerline.llm.decontaminate import contamination
from ledgerline.llm.fill_in_middle import fill_in_middle, restored
from ledgerline.llm.jaccard_join import shingle_components
from ledgerline.llm.length_histogram import encoded_lengths, length_histogram, suffix_sums
from ledgerline.llm.line_spread import remove_boilerplate
from ledgerline.llm.orchard import ROUNDS, books_digest, label_errors, vector_codes
from ledgerline.llm.pareto_mix import pareto_mix
from ledgerline.llm.preferences import preference_pairs, shortened_answers
from ledgerline.llm.pseudonyms import KINDS, pseudonymize
from ledgerline.llm.storage import written
from ledgerline.llm.token_files import read_checksums, write_token_files
from ledgerline.llm.toxicity import add_scores, is_held_out, learned


#: Key of the pseudonyms; a real run passes its own secret.
PSEUDONYM_KEY = b"ledgerline example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a recording; every twentieth asks with a noisy part of its own, all are searched.

    A report of the best match of each (the fewest errors, then the smallest id) and of how many there are; align() gives them all.
    """
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    recordings = written(fingerprints(melodies(vectors, "vec_id", "embedding"), "id"), "recordings")
    part = melodies(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", first=16, last=48, noise=0.05)
    best = best_match(align(written(fingerprints(part, "id"), "parts"), recordings, exact=True))
    summary = recordings.select(F.col("id").alias("vec_id"), "n_positions", F.crc32(F.array_join(F.col("codes").cast("array<string>"), " ").cast("binary")).alias("codes_crc32"))
    joined = summary.join(best.withColumnRenamed("query", "vec_id"), "vec_id", "left")
    return joined.select("vec_id", "n_positions", "codes_crc32", "match", "offset", "votes", "bit_errors", "n_matches")


def op3_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    network = learned(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = add_scores(docs, network)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against a version whose last answer is cut short."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = preference_pairs(turns, shortened_answers(turns))
    learned_chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.when(x["learn"], x["chars"]).otherwise(0))
    return pairs.select(
        "conv_id",
        "n_prompt_turns",
        *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
        learned_chars("chosen_mask").alias("chosen_learned"),
        learned_chars("rejected_mask").alias("rejected_learned"),
    )


def op6_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, PSEUDONYM_KEY).select("doc_id", "text", *[f"n_{k}" for k in KINDS])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_checksums(index).withColumnRenamed("id", "doc_id")


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lengths = encoded_lengths(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return suffix_sums(length_histogram(lengths))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256")
    )


def op12_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pareto_mix(docs).select("row.doc_id", "size", "source_size", "target", "taken", "copies")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    codes, books = vector_codes(vectors, keep=("vec_id", "label"))
    coded = label_errors(codes.select("row.vec_id", "row.label", "code", "error"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bpe_lexicon,
        op2_chroma_fingerprints,
        op3_shingle_components,
        op4_toxicity,
        op5_preference_pairs,
        op6_benchmark_contamination,
        op7_pseudonyms,
        op8_token_files,
        op9_length_histogram,
        op10_line_spread,
        op11_fill_in_middle,
        op12_pareto_mix,
        op13_vector_codes,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SHINGLES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS h FROM t GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, x.h AS ha, y.h AS hb FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b, ha, hb FROM links UNION SELECT b, a, hb, ha FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, coalesce(n_links, 0) AS n_links FROM w LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1) x USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(DISTINCT hb) FILTER (hb <> ha) AS n_links FROM edges GROUP BY 1) y USING (doc_id)"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_CONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM benchmark),
p AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM
  (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
o AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
f AS (SELECT doc_id, item, k, o.n FROM o JOIN p USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM f) GROUP BY 1),
g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)"""

_LINES = r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, regexp_replace(line, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g') AS body FROM l),
b AS (SELECT body, count(DISTINCT source) AS sites, min(doc_id) AS first_id FROM k WHERE len(regexp_extract_all(body, '[^\x09-\x0D ]+')) >= 5 GROUP BY 1),
j AS (SELECT doc_id, line, pos, coalesce(sites >= 6 AND first_id <> doc_id, false) AS gone FROM k LEFT JOIN b USING (body))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256 FROM j GROUP BY 1"""

_SHOW = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
_PAIRS = rf"""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
t AS (SELECT c.conv_id, turn, role, text, last, turn = last AND role = 'assistant' AS answer FROM conversations c LEFT JOIN l USING (conv_id)),
c AS (SELECT *, last IS NOT NULL AND (turn > last OR answer AND text <> '') AS differs FROM t),
s AS (SELECT conv_id, min(turn) FILTER (differs) AS split FROM c GROUP BY 1),
r AS (SELECT conv_id, turn, role, CASE WHEN answer THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM c WHERE last IS NULL OR turn <= last),
n AS (SELECT conv_id, count(*) FILTER (split IS NULL OR turn < split) AS n_prompt_turns, string_agg({_SHOW}, '' ORDER BY turn) FILTER (split IS NULL OR turn < split) AS prompt,
  string_agg({_SHOW}, '' ORDER BY turn) FILTER (turn >= split) AS chosen, sum(length(text) + 8) FILTER (turn >= split AND role = 'assistant') AS learned FROM c JOIN s USING (conv_id) GROUP BY 1),
m AS (SELECT conv_id, string_agg({_SHOW}, '' ORDER BY turn) FILTER (turn >= split) AS rejected, sum(length(text) + 8) FILTER (turn >= split AND role = 'assistant') AS learned FROM r JOIN s USING (conv_id) GROUP BY 1)
SELECT conv_id, n_prompt_turns, sha256(coalesce(prompt, '')) AS prompt_sha256, sha256(coalesce(chosen, '')) AS chosen_sha256, sha256(coalesce(rejected, '')) AS rejected_sha256,
  CAST(coalesce(n.learned, 0) AS BIGINT) AS chosen_learned, CAST(coalesce(m.learned, 0) AS BIGINT) AS rejected_learned FROM n LEFT JOIN m USING (conv_id)"""


_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, len(l) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:n], '') AS suf,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

# Sources of up to 4,096 sampled documents are one range, whose documents are taken in order while they fit, which this says.
_MIX = r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))[1:13] AS BIGINT) AS draw FROM documents),
s AS MATERIALIZED (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w FROM d GROUP BY source),
m AS (SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS level, 0 AS turn FROM s
  UNION ALL SELECT (SELECT (1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) - CAST(sum(CASE WHEN 2.0 * source_size <= m.level * w THEN 2.0 * source_size ELSE 0.0 END) AS DOUBLE))
    / CAST(sum(CASE WHEN 2.0 * source_size <= m.level * w THEN 0.0 ELSE w END) AS DOUBLE) FROM s), turn + 1 FROM m WHERE turn < 40),
t AS MATERIALIZED (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM m ORDER BY turn DESC LIMIT 1) * w) AS target FROM s),
r AS (SELECT doc_id, d.source, size, source_size, target, draw, CASE WHEN size > 0 THEN target / source_size ELSE 0.0 END AS expected FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(expected) AS BIGINT) AS certain, expected - floor(expected) AS part, (draw + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM r),
q AS (SELECT *, CASE WHEN part > 0 THEN CAST(floor(odds / (1 + odds) * 1125899906842624.0::DOUBLE) AS BIGINT) END AS rank
  FROM (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM c)),
o AS MATERIALIZED (SELECT source, rank, size, row_number() OVER (PARTITION BY source ORDER BY rank) AS place FROM (SELECT source, rank, CAST(sum(size) AS BIGINT) AS size FROM q WHERE rank IS NOT NULL GROUP BY 1, 2)),
z AS (SELECT source, least(CAST(round(max(target) - sum(certain * size)) AS BIGINT), CAST(sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) AS BIGINT)) AS rest FROM q GROUP BY 1),
f AS (SELECT source, CAST(0 AS BIGINT) AS place, rest AS words_left, CAST(NULL AS BIGINT) AS rank, false AS drawn FROM z
  UNION ALL SELECT f.source, o.place, words_left - CASE WHEN o.size <= words_left THEN o.size ELSE 0 END, o.rank, o.size <= words_left FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source AND o.place = f.place + 1)
SELECT doc_id, size, source_size, target, CAST(certain + coalesce(drawn, false)::INT AS BIGINT) * size AS taken, CAST(certain + coalesce(drawn, false)::INT AS BIGINT) AS copies
FROM q LEFT JOIN f ON q.source IS NOT DISTINCT FROM f.source AND q.rank = f.rank"""


def _codes_sql(rounds: int) -> str:
    """The codebooks' rounds one after the other; distances are of whole numbers, so sums of doubles are exact."""
    nearest = """a{r} AS MATERIALIZED (SELECT p.vec_id, p.n, p.part, p.v, min([b.v2 - 2 * list_inner_product(p.v, b.v) + p.v2, b.entry]) AS best FROM p JOIN b{r} b USING (part) GROUP BY ALL)"""
    update = """m{r} AS MATERIALIZED (SELECT part, entry, list(x ORDER BY i) AS v FROM (SELECT part, entry, i, floor(CAST(sum(x) AS DOUBLE) / count(*)) AS x
  FROM (SELECT part, best[2] AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{s} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v, list_inner_product(coalesce(m.v, b.v), coalesce(m.v, b.v)) AS v2 FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)"""
    steps = ",\n".join(f"{nearest.format(r=r)},\n{update.format(r=r, s=r + 1)}" for r in range(rounds))
    return f"""WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, n, part, v, list_inner_product(v, v) AS v2 FROM (SELECT vec_id, n, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS v FROM k, range(4) x(part))),
b0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS DOUBLE) AS entry, v, v2 FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{steps},
{nearest.format(r=rounds)},
c AS (SELECT k.vec_id, any_value(k.label) AS label, string_agg(lpad(lower(hex(CAST(best[2] AS BIGINT))), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} a JOIN k USING (n) GROUP BY k.n, k.vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against plain versions."""
    return {
        "op3_shingle_components": _SHINGLES,
        "op5_preference_pairs": _PAIRS,
        "op6_benchmark_contamination": _CONTAMINATION,
        "op10_line_spread": _LINES,
        "op11_fill_in_middle": _MIDDLE,
        "op12_pareto_mix": _MIX,
        "op13_vector_codes": _codes_sql(ROUNDS),
    }
