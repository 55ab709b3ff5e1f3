"""The queries of the problems, over whole tables with production parameters, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .setjoin import similar_pairs

    return similar_pairs(table(spark, d, "postings"), "id", "top_skills", 0.6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .survivor import job_survivors

    return job_survivors(table(spark, d, "postings"), table(spark, d, "posting_sources"), table(spark, d, "posting_canonical_links"))


def p2_bundles(spark: SparkSession, d: str) -> DataFrame:
    from .survivor import job_bundles

    return job_bundles(table(spark, d, "postings"), table(spark, d, "posting_canonical_links"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .boilerplate import boilerplate_lines

    return boilerplate_lines(table(spark, d, "posting_sources"), table(spark, d, "hydrated_jds"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .residue import fit, residue

    rows = table(spark, d, "hydrated_jds")
    return residue(rows, fit(rows))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .history import rejected

    return rejected(table(spark, d, "seen_urls"), table(spark, d, "postings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .names import name_links

    return name_links(table(spark, d, "postings"), table(spark, d, "parsed_postings"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .canonical import map_postings

    return map_postings(table(spark, d, "postings"), table(spark, d, "ref_values"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from .tokens import encode

    return encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    from .tokens import decode, encode

    return decode(encode(table(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from .packing import pack_texts

    return pack_texts(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from .pii import passages

    return passages(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    from .pii import redacted

    return redacted(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_bundles, p3_found, p4_found, p5_found, p6_found, p7_found, p8_ids, p8_decoded, p9_containers, p10_found, p10_redacted)}

SQL = {
    "p1_found": """
WITH s AS (SELECT id, list_distinct(list_filter(list_transform(list_filter(top_skills, lambda x: x IS NOT NULL), lambda x: lower(trim(x))), lambda x: x <> '')) AS v FROM postings WHERE top_skills IS NOT NULL),
e AS (SELECT id, len(v) AS n, unnest(v) AS w FROM s),
c AS (SELECT a.id AS id_a, b.id AS id_b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2, 3)
SELECT id_a, id_b FROM c WHERE 10 * k >= 6 * (n - k)""",
    "p2_found": """
WITH m AS (SELECT DISTINCT canonical_id, CAST(posting_id AS BIGINT) AS posting_id FROM posting_canonical_links),
g AS (SELECT canonical_id FROM m GROUP BY canonical_id HAVING count(*) > 1),
p AS (SELECT m.canonical_id, m.posting_id, row_number() OVER (PARTITION BY m.canonical_id ORDER BY
        coalesce(length(replace(replace(replace(replace(full_jd, ' ', ''), chr(9), ''), chr(13), ''), chr(10), '')), 0) DESC, last_seen DESC NULLS LAST, m.posting_id) AS k
      FROM m JOIN g USING (canonical_id) LEFT JOIN postings ON postings.id = m.posting_id),
s AS (SELECT m.canonical_id, s.id, row_number() OVER (PARTITION BY m.canonical_id ORDER BY
        CASE WHEN lower(source) LIKE '%hydrator%' THEN 0 ELSE 1 END, source_first_seen NULLS LAST, s.id) AS k
      FROM m JOIN g USING (canonical_id) JOIN posting_sources s ON s.posting_id = m.posting_id)
SELECT p.canonical_id, p.posting_id AS best_posting_id, s.id AS best_source_id
FROM p LEFT JOIN s ON s.canonical_id = p.canonical_id AND s.k = 1 WHERE p.k = 1""",
    "p2_bundles": """
WITH m AS (SELECT DISTINCT canonical_id, CAST(posting_id AS BIGINT) AS id FROM posting_canonical_links),
k AS (SELECT id, canonical_company AS company, canonical_location AS location, coalesce(date_diff('day', DATE '1970-01-01', CAST(last_seen AS DATE)), -1000000) AS seen, coalesce(-date_diff('day', DATE '1970-01-01', CAST(first_seen AS DATE)), -1000000) AS early FROM postings),
r AS (SELECT m.canonical_id, k.* FROM m JOIN k USING (id) WHERE m.canonical_id IN (SELECT canonical_id FROM m GROUP BY 1 HAVING count(*) > 1)),
p AS (SELECT DISTINCT company, location FROM k WHERE trim(company) <> '' AND trim(location) <> ''),
f AS (SELECT canonical_id, company, max(seen) AS seen FROM r WHERE trim(company) <> '' GROUP BY 1, 2),
g AS (SELECT canonical_id, location, max(early) AS early FROM r WHERE trim(location) <> '' GROUP BY 1, 2),
x AS (SELECT f.canonical_id, f.company, g.location, f.seen, g.early, f.company NOT IN (SELECT company FROM p) OR EXISTS (SELECT 1 FROM p WHERE p.company = f.company AND p.location = g.location) AS ok FROM f JOIN g USING (canonical_id))
SELECT canonical_id, company, location FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY ok DESC, CASE WHEN ok THEN seen + early END DESC, seen DESC, company, early DESC, location) AS k FROM x) WHERE k = 1""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
