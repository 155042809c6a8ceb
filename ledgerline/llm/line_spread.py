"""Cross-site boilerplate lines: distinct sites per line, by HyperLogLog sketches.

DataFrame functions only. Lines meet by a 64-bit hash of the stripped text. Each task makes
one sketch of sites for each of its lines and sketches merge by aggregation, so a hot line or
site costs a row per task. Lines whose estimate is near the threshold get an exact
distinct count before they are judged. Boilerplate lines of a checked number are listed in the plan,
and documents are cleaned where they lie; more of them meet the documents by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import discard, written

#: Sketch size (log2 of registers) and the relative band around the threshold that is counted exactly.
LG_K = 12
BAND = 0.1
#: Boilerplate lines that may be listed in the plan; more are joined.
LISTED = 4096

_SPACE, _OTHER_WHITE = " ", "\t\n\x0b\x0c\r"


def stripped_line(line: Column) -> Column:
    """A line without white space (\\x09-\\x0D, space) at its ends; the general trim runs only where it isn't all spaces."""
    bare = F.trim(line)
    other = reduce(lambda a, b: a | b, [bare.startswith(c) | bare.endswith(c) for c in _OTHER_WHITE])
    return F.when(other, F.btrim(line, F.lit(_SPACE + _OTHER_WHITE))).otherwise(bare)


def has_words(line: Column, least_words: int) -> Column:
    """True for a line of that many runs of other characters; short lines are told by their length, others by their beginning."""
    if least_words < 1:
        return F.lit(True)
    white = r"\x09-\x0D "
    pattern = rf"^[{white}]*+[^{white}]++(?:[{white}]++[^{white}]++){{{least_words - 1}}}"
    return (F.octet_length(line) >= 2 * least_words - 1) & line.rlike(pattern)


def line_key(line: Column) -> Column:
    """Hash of a stripped line."""
    return F.xxhash64(stripped_line(line))


def line_sites(lines: DataFrame, least_sites: int, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """(key, n_sites, first_id) of the lines (key, site, id) that are seen at ``least_sites`` sites or more.

    n_sites is exact where the sketch's estimate is within ``band`` of the threshold or
    one site off it, and the estimate elsewhere. A null site is no site.
    """
    spread = lines.groupBy("key").agg(
        F.round(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k)))).cast("long").alias("estimate"), F.min("id").alias("first_id")
    )
    reach = max(1.0, band * least_sites)
    spread = written(spread.where(F.col("estimate") >= least_sites - reach), "spread")
    near = spread.where(F.col("estimate") <= least_sites + reach)
    # One row a line and site first, so a hot line is small before its sites are counted.
    pairs = lines.join(near.select("key"), "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("key").agg(F.count("site").alias("exact"))
    judged = spread.join(exact, "key", "left").select("key", F.coalesce("exact", "estimate").alias("n_sites"), "first_id")
    return judged.where(F.col("n_sites") >= least_sites)


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = 6, least_words: int = 5
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, plus n_lines and n_removed.

    A boilerplate line has ``least_words`` words or more and, without white space at its ends, is
    seen at ``least_sites`` different sites or more. It stays in the rows of its smallest
    id and goes from all others. Lines end at \\n. A null text stays null with no
    lines; an empty text has one empty line. A null site counts as no site; a row with a null
    id loses a line whenever another row's id is known for it. Rows that repeat
    keep or lose lines alike. Other columns pass through, whatever their names; n_lines
    and n_removed replace columns of those names.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    seen = _lines(docs, id_col, text_col, least_words, F.when(F.col(site_col).isNotNull(), F.xxhash64(site_col)).alias("site"))
    seen = written(seen, "lines")
    spread = written(line_sites(seen, least_sites), "boilerplate")
    discard(seen)
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("d"), F.split(text_col, "\n", -1).alias("lines"))
    if spread.count() <= LISTED:
        # Their number is checked. A line's pair with the id it stays with is told by one more hash.
        listed = spread.select("key", F.xxhash64("key", "first_id").alias("stays")).collect()
        gone = _listed(F.col("d")[id_col], [r["key"] for r in listed], [r["stays"] for r in listed], least_words)
    else:
        row_key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("row")
        lost = _lines(docs, id_col, text_col, least_words, row_key).join(spread, "key").where(~F.col("id").eqNullSafe(F.col("first_id")))
        lost = lost.groupBy("row").agg(F.collect_set("key").alias("keys"))
        rows = rows.withColumn("row", F.xxhash64(F.col("d")[id_col], F.col("d")[text_col])).join(lost, "row", "left").drop("row")
        gone = lambda x: F.coalesce(F.array_contains("keys", line_key(x)), F.lit(False)) & has_words(x, least_words)
    kept = rows.withColumn("kept", F.filter("lines", lambda x: ~gone(x)))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    changed = F.size("kept") < F.size("lines")
    text = F.when(changed, F.array_join("kept", "\n")).otherwise(F.col("d")[text_col])
    return kept.select(
        *[text.alias(c) if c == text_col else F.col("d")[c].alias(c) for c in names],
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(changed, n_lines - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
    )


def _lines(docs: DataFrame, id_col: str, text_col: str, least_words: int, *more: Column) -> DataFrame:
    """(id, ..., key) of every line that may be boilerplate."""
    lines = docs.select(F.col(id_col).alias("id"), *more, F.explode(F.split(text_col, "\n", -1)).alias("line"))
    return lines.where(has_words(F.col("line"), least_words)).select("id", *[c for c in lines.columns if c not in ("id", "line")], line_key(F.col("line")).alias("key"))


def _listed(own_id: Column, keys: list[int], stays: list[int], least_words: int):
    """Whether a line goes from the row with ``own_id``, as a function of the line."""

    def gone(x: Column) -> Column:
        if not keys:
            return F.lit(False)
        key = line_key(x)
        return (F.octet_length(x) >= 2 * least_words - 1) & key.isin(keys) & ~F.xxhash64(key, own_id).isin(stays)

    return gone
