"""License scans by canonical digest.

A text is brought to a canonical form and its digest is looked up among the digests of known
licences. The form ignores case, punctuation, white space, copyright lines and which of several
equivalent spellings is used. Whole texts are compared, and every line of a text as a text of its
own, because licences are often stated in one line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barworks.llm.arrow import prepared
from barworks.llm.licence_texts import EQUIVALENT, KNOWN


# Words that follow "copyright" in sentences of licences and not in the line that names a holder.
_SENTENCE = (
    "notices?|holders?|owners?|licenses?|laws?|statements?|interests?|rights?|infringements?|claims?|protections?|"
    "disclaimers?|treaty|treaties|act|and|or|the|this|that|these|those|in|on|of|to|for|is|are|was|were|as|under|with|any|all|may|shall|status|information"
)
_COPYRIGHT_LINE = (
    r"^(portions )?(copyright|c)( c)* ([0-9]{4}|yyyy|year)( |$)|^(portions )?copyright( c)+( |$)|"
    rf"^(portions )?copyright (?!c |c$|({_SENTENCE})( |$))|^all rights reserved$"
)


def canonical_line(line: Column) -> Column:
    """Words of a line in lower case with single spaces, in one spelling; a copyright line,
    with or without year, is empty."""
    plain = F.regexp_replace(F.lower(line), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‐-―‘-‟]+", " ")
    plain = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    spelled = reduce(lambda c, pair: F.replace(c, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUIVALENT, plain)
    words = F.trim(spelled)
    # The sign alone names a holder as the word does; "(c)" alone also numbers clauses.
    signed = F.trim(F.regexp_replace(F.replace(words, F.lit("\u00a9"), F.lit(" copyright c ")), " +", " "))
    signed = F.regexp_replace(signed, "^(portions )?copyright copyright ", "$1copyright ")
    return F.when(signed.rlike(_COPYRIGHT_LINE), F.lit("")).otherwise(words)


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_licences(spark) -> DataFrame:
    """(license_id, digest, size) of the known texts: as many rows as there are texts."""
    rows = spark.createDataFrame(list(KNOWN), "license_id string, body string")
    whole = F.array_join(canonical_lines(F.col("body")), " ")
    return rows.select("license_id", digest(whole).alias("digest"), F.length(whole).alias("size"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id, line_licenses, n_license_lines) per document.

    ``license_id`` is the known licence whose canonical form equals the whole text's,
    ``line_licenses`` the sorted ids of those that equal one of its lines, ``n_license_lines`` the
    number of such lines. Null, empty and wordless texts have a null digest and no licence. ``known``
    has one row per known text, (license_id, digest, size); where digests repeat, the least id
    holds. Rows are independent and repeated rows stay; an empty table gives an empty result; other
    columns are ignored. Only lines no longer than the longest known text are digested, and only
    the table of known texts is joined, so documents are not shuffled.
    """
    spark = prepared(docs.sparkSession)
    known = known_licences(spark) if known is None else known
    known = known.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("size").alias("size"))
    # One row with all known digests: its size is that of the list of known texts.
    table = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("k"), F.max("size").alias("m")).first()
    ids, longest = table.k or {}, table.m or 0
    listed = spark.createDataFrame([(d, i) for d, i in ids.items()], "digest string, license_id string")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text")).alias("lines"))
    short = F.filter("lines", lambda x: F.length(x) <= longest)
    found = lines.select("doc_id", digest(F.array_join("lines", " ")).alias("digest"), F.transform(short, lambda x: F.sha2(x, 256)).alias("line_digests"))
    wanted = F.array(*[F.lit(d) for d in ids]) if ids else F.array().cast("array<string>")
    hits = found.withColumn("hits", F.filter("line_digests", lambda d: F.array_contains(wanted, d))).drop("line_digests")
    names = F.create_map(*[F.lit(v) for pair in ids.items() for v in pair]) if ids else F.create_map().cast("map<string,string>")
    joined = hits.join(F.broadcast(listed), "digest", "left")
    return joined.select(
        "doc_id", "digest", "license_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda d: F.try_element_at(names, d)))), ",").alias("line_licenses"),
        F.size("hits").cast("long").alias("n_license_lines"),
    )
