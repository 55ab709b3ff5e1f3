"""The named queries over the driver's tables, and SQL that gives the same rows.

Each query runs over its whole tables. The SQL is written from the operator's meaning, not from its plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import similarity as sim, text as tx
from ..operators import relational as rel
from ..operators.ledger import in_month
from ..operators.rules import Rule, decide
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(lambda name: table(spark, d, name))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


#: Own rules of the title filter, by tier (fixed values).
RULES = {
    "pre_deny": [Rule(r"\bintern(ship)?\b", "regex", "internship"), Rule("apprentice")],
    "deny_company": [Rule("staffing", note="agency"), Rule(r"^confidential$", "regex")],
    "allow": [Rule(r"\bdata (scientist|engineer)\b", "regex", "core role"), Rule("machine learning")],
    "deny": [Rule("administrator"), Rule(r"\b(product|insights) analyst\b", "regex", "analyst"), Rule("research")],
}
#: Categories of skills in order of display (fixed values); a match of the profile comes before all.
SKILL_ORDER = ("modeling", "forecasting", "testing", "governance")
PROFILE = ("python", "sql", "statistics")

_LINKS = "l AS (SELECT DISTINCT CAST(posting_id AS BIGINT) AS posting_id, canonical_id, merge_kind, merged_at, similarity_score FROM posting_canonical_links)"
_BOARD = r"regexp_extract(regexp_extract(lower(trim({u})), '^[a-z]+://([^/?#:]+)', 1), '([^.]+\.[^.]+)$', 1)"
_JOB = r"coalesce(nullif(regexp_extract(lower(trim({u})), '[?&]jk=([0-9a-z]+)', 1), ''), nullif(regexp_extract(lower(trim({u})), '/(?:view|o)/([0-9]+)', 1), ''), nullif(regexp_extract(lower(trim({u})), '/([0-9a-z]{{8,}})/*(?:[?#]|$)', 1), ''))"
_URL = "CASE WHEN nullif(" + _BOARD + ", '') IS NOT NULL AND " + _JOB + " IS NOT NULL THEN 'https://' || " + _BOARD + " || '/job/' || " + _JOB + " ELSE {u} END"
_LABEL = "CASE WHEN lower(source) LIKE '%jobquill%' THEN 'jobquill' WHEN lower(source) LIKE '%stellaroles%' THEN 'stellaroles' WHEN lower(source) LIKE '%werkpost%' THEN 'werkpost' ELSE 'unknown' END"


def links(t) -> DataFrame:
    """Links once each, with the posting's id as a number."""
    return t("posting_canonical_links").select(F.col("posting_id").cast("long").alias("posting_id"), "canonical_id", "merge_kind", "merged_at", "similarity_score").distinct()


def primary(t) -> DataFrame:
    """The first-linked posting of each canonical record."""
    return rel.first_per_key(links(t), "canonical_id", [F.col("merged_at").isNull(), F.col("merged_at"), F.col("posting_id")], ["posting_id"])


_PRIMARY = "f AS (SELECT canonical_id, posting_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY merged_at NULLS LAST, posting_id) AS k FROM l) WHERE k = 1)"


@query(f"""WITH {_LINKS}, g AS (SELECT canonical_id, min(first_seen) AS first_seen FROM l JOIN postings p ON p.id = l.posting_id GROUP BY 1)
SELECT canonical_id, first_seen FROM g WHERE NOT EXISTS (SELECT 1 FROM l JOIN postings p ON p.id = l.posting_id WHERE l.canonical_id = g.canonical_id AND p.hydration_status = 'failed')
AND NOT EXISTS (SELECT 1 FROM l JOIN postings p ON p.id = l.posting_id WHERE l.canonical_id = g.canonical_id AND p.fit_score = 1)""")
def main_view(t):
    """JN-01, SRT-02: jobs without any member among two removed sets, newest first."""
    p = t("postings").withColumnRenamed("id", "posting_id")
    groups = links(t).join(p.select("posting_id", "first_seen"), "posting_id").groupBy("canonical_id").agg(F.min("first_seen").alias("first_seen"))
    out = rel.suppress(groups, links(t), "canonical_id", "posting_id", p.where("hydration_status = 'failed'"), p.where("fit_score = 1"))
    return out.select("canonical_id", "first_seen").orderBy(F.desc("first_seen"), "canonical_id")


@query("""SELECT p.id, p.first_seen, EXISTS (SELECT 1 FROM posting_sources s WHERE s.posting_id = p.id AND lower(s.source) LIKE '%hydrator%') AS viewed
FROM postings p WHERE p.id NOT IN (SELECT posting_id FROM seen_urls WHERE user_id = 'default' AND posting_id IS NOT NULL)""")
def posting_view(t):
    """JN-02, JN-03, SRT-01: rows not in a set, with an existence flag, unviewed first."""
    p = t("postings").select("id", "first_seen").join(t("seen_urls").where("user_id = 'default'").select(F.col("posting_id").alias("id")), "id", "left_anti")
    keys = t("posting_sources").where(F.lower("source").contains("hydrator")).select(F.col("posting_id").alias("id"))
    return rel.flag(p, keys, "id", "viewed").orderBy("viewed", F.desc("first_seen"), "id")


@query(f"""WITH {_LINKS} SELECT canonical_id, CASE min(CASE lower(trim(hydration_status)) WHEN 'complete' THEN 1 WHEN 'partial' THEN 2 WHEN 'failed' THEN 3 END) WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' ELSE 'failed' END AS hydration_status
FROM l LEFT JOIN postings p ON p.id = l.posting_id GROUP BY 1""")
def status_rollup(t):
    """JN-04: complete over partial over failed over the members of a job."""
    rows = links(t).join(t("postings").select(F.col("id").alias("posting_id"), "hydration_status"), "posting_id", "left")
    return rel.best_status(rows, "canonical_id", "hydration_status", ["complete", "partial", "failed"])


@query(f"WITH {_LINKS}, {_PRIMARY} SELECT * FROM f")
def primary_link(t):
    """WIN-04."""
    return primary(t)


@query("SELECT p.id, coalesce(s.source, 'unknown') AS source FROM postings p LEFT JOIN (SELECT posting_id, arg_min(source, id) AS source FROM posting_sources WHERE source IS NOT NULL GROUP BY 1) s ON s.posting_id = p.id")
def first_source(t):
    """JN-08, 09, 13: each posting's first source, with a default."""
    s = rel.first_per_key(t("posting_sources").where("source is not null"), "posting_id", [F.col("id")], ["source"])
    return t("postings").select("id").join(s.withColumnRenamed("posting_id", "id"), "id", "left").withColumn("source", F.coalesce("source", F.lit("unknown")))


@query(f"""WITH {_LINKS}, k AS (SELECT canonical_id, merge_kind, min(merged_at) AS o FROM l WHERE merge_kind IS NOT NULL GROUP BY 1, 2) SELECT canonical_id, string_agg(merge_kind, '>' ORDER BY o, merge_kind) AS kinds FROM k GROUP BY 1""")
def link_kinds(t):
    """WIN-05, ARR-02: distinct kinds in order of first appearance."""
    return rel.ordered_distinct(links(t), "canonical_id", "merged_at", "merge_kind", "kinds").withColumn("kinds", F.array_join("kinds", ">"))


@query(f"""WITH r AS (SELECT posting_id, {_LABEL} AS board, id, source_url, row_number() OVER (PARTITION BY posting_id, {_LABEL} ORDER BY CASE WHEN lower(source) LIKE '%hydrator%' THEN 0 ELSE 1 END, source_first_seen NULLS LAST, id) AS k FROM posting_sources)
SELECT posting_id, board, id, source_url FROM r WHERE k = 1""")
def best_source_row(t):
    """WIN-06, JN-10: per posting and board a page's row before an e-mail's, the first of them."""
    s = t("posting_sources").withColumn("board", tx.source_label(F.col("source"))).withColumn("key", F.struct("posting_id", "board"))
    order = [~F.coalesce(F.lower("source").contains("hydrator"), F.lit(False)), F.col("source_first_seen").isNull(), F.col("source_first_seen"), F.col("id")]
    return rel.first_per_key(s, "key", order, ["id", "source_url"]).select("key.*", "id", "source_url")


@query(f"SELECT posting_id, string_agg(DISTINCT {_LABEL}, ',' ORDER BY {_LABEL}) AS boards FROM posting_sources WHERE source IS NOT NULL GROUP BY 1")
def distinct_sources(t):
    """AGG-01."""
    return rel.distinct_concat(t("posting_sources").where("source is not null").withColumn("b", tx.source_label(F.col("source"))), "posting_id", "b", "boards")


@query("SELECT url, " + _URL.format(u="url") + " AS page, " + _JOB.format(u="url") + " AS job FROM seen_urls")
def url_canonical(t):
    """STR-01..04, 16: one form of all addresses of a page."""
    return t("seen_urls").select("url", tx.canonical_url(F.col("url")).alias("page"), tx.job_id(F.col("url")).alias("job"))


@query("WITH u AS (SELECT user_id, " + _URL.format(u="url") + " AS page, posting_id, seen_at FROM seen_urls), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY seen_at NULLS LAST, posting_id) AS k FROM u) SELECT user_id, page, posting_id, seen_at FROM r WHERE k = 1")
def url_first_wins(t):
    """ER-19, SNK-01, 02: the first arrival of each user and page; the rows of later months come to those that are there."""
    u = t("seen_urls").select("user_id", tx.canonical_url(F.col("url")).alias("page"), "posting_id", "seen_at", F.col("seen_at").isNull().alias("late"))
    later = F.coalesce(F.col("seen_at") >= F.lit("2025-03-01").cast("timestamp_ntz"), F.lit(True))
    order, keys = ["late", "seen_at", "posting_id"], ["user_id", "page"]
    return rel.insert_or_ignore(rel.insert_or_ignore(u.limit(0), u.where(~later), keys, order), u.where(later), keys, order).drop("late")


@query("WITH u AS (SELECT user_id, " + _URL.format(u="url") + " AS page, posting_id, seen_at FROM seen_urls), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY seen_at DESC NULLS LAST, posting_id DESC) AS k FROM u) SELECT user_id, page, posting_id, seen_at FROM r WHERE k = 1")
def url_last_wins(t):
    """SNK-03: the last arrival replaces those before."""
    u = t("seen_urls").select("user_id", tx.canonical_url(F.col("url")).alias("page"), "posting_id", "seen_at")
    later = F.coalesce(F.col("seen_at") >= F.lit("2025-03-01").cast("timestamp_ntz"), F.lit(False))
    order, keys = ["seen_at", "posting_id"], ["user_id", "page"]
    return rel.insert_or_replace(rel.insert_or_replace(u.limit(0), u.where(~later), keys, order), u.where(later), keys, order)


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash(t):
    """ER-20, STR-25: one row per distinct text, fanned out by its hash."""
    return t("documents").where("text is not null").groupBy(tx.text_hash(F.col("text")).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"""WITH {_LINKS}, {_PRIMARY}, s AS (SELECT p.id, p.seniority_band, p.canonical_title, list_distinct(list_transform(list_filter(coalesce(top_skills, []), lambda x: x IS NOT NULL), lambda x: lower(x))) AS s FROM postings p),
x AS (SELECT l.posting_id, l.canonical_id, CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END AS skills,
CASE WHEN lower(trim(a.seniority_band)) = lower(trim(b.seniority_band)) THEN 1.0 ELSE 0.0 END AS seniority, CASE WHEN a.canonical_title = b.canonical_title THEN 1.0 ELSE 0.0 END AS title
FROM l JOIN f ON f.canonical_id = l.canonical_id JOIN s a ON a.id = l.posting_id JOIN s b ON b.id = f.posting_id WHERE l.posting_id <> f.posting_id),
y AS (SELECT *, 0.4 * title + 0.3 * skills + 0.2 * title + 0.1 * seniority AS score FROM x)
SELECT posting_id, canonical_id, round(skills, 6) AS skills, round(score, 6) AS score, CASE WHEN score < 0.75 THEN 'new' WHEN title >= 1 - 1e-6 AND skills >= 1 - 1e-6 AND seniority >= 1 - 1e-6 THEN 'merge_exact' WHEN skills >= 0.5 THEN 'merge_approved' ELSE 'new' END AS tier FROM y""")
def fused_tiers(t):
    """ER-01, 03, 05, 06, 09: each member against the first of its job; the verdict on the borderline is a rule."""
    p = t("postings").select("id", "top_skills", "seniority_band", "canonical_title")
    side = lambda n: p.select(F.col("id").alias(f"{n}_id"), F.struct("top_skills", "seniority_band", "canonical_title").alias(n))
    rows = links(t).join(primary(t).withColumnRenamed("posting_id", "b_id"), "canonical_id").where("posting_id != b_id")
    rows = rows.join(side("a"), F.col("posting_id") == F.col("a_id")).join(side("b"), "b_id")
    rows = rows.withColumn("skills", sim.jaccard(F.coalesce("a.top_skills", F.array().cast("array<string>")), F.coalesce("b.top_skills", F.array().cast("array<string>"))))
    title = F.coalesce((F.col("a.canonical_title") == F.col("b.canonical_title")).cast("double"), F.lit(0.0))
    rows = rows.withColumn("title", title).withColumn("seniority", sim.same_seniority(F.col("a.seniority_band"), F.col("b.seniority_band")))
    rows = rows.withColumn("score", sim.fuse(F.col("title"), F.col("skills"), F.col("title"), F.col("seniority")))
    return rows.select("posting_id", "canonical_id", F.round("skills", 6).alias("skills"), F.round("score", 6).alias("score"), sim.tier(F.col("score"), sim.exact(F.col("title"), F.col("skills"), F.col("seniority")), F.col("skills") >= 0.5).alias("tier"))


@query("""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS e, min(vec_id) AS first_id FROM embeddings GROUP BY 1)
SELECT vec_id, first_id, round(list_cosine_similarity(x.embedding::DOUBLE[], f.e::DOUBLE[]), 6) AS cosine FROM embeddings x JOIN f USING (label)""")
def vector_cosine(t):
    """ER-02: every vector against its label's first."""
    e = t("embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"), F.min("vec_id").alias("first_id"))
    return e.join(first, "label").select("vec_id", "first_id", F.round(sim.cosine(F.col("embedding"), F.col("e")), 6).alias("cosine"))


@query("""WITH b AS (SELECT id, user_id, canonical_company c, team_or_department d, canonical_location l FROM postings WHERE trim(canonical_company) <> '' AND trim(canonical_location) <> '')
SELECT user_id, c AS company, d AS team, l AS location, count(*) AS members, min(id) AS first_id FROM b GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def blocks(t):
    """JN-05, 06, ER-07, 08: blocks of the exact key, a null team only with a null team, blank keys in none."""
    p = t("postings").where("trim(canonical_company) != '' and trim(canonical_location) != ''")
    return p.groupBy("user_id", F.col("canonical_company").alias("company"), F.col("team_or_department").alias("team"), F.col("canonical_location").alias("location")).agg(F.count("*").alias("members"), F.min("id").alias("first_id")).where("members > 1")


_HIT = {
    "p": r"CASE WHEN regexp_matches(title, '\bintern(ship)?\b', 'i') THEN 'internship' WHEN contains(lower(title), 'apprentice') THEN 'apprentice' END",
    "c": r"CASE WHEN contains(lower(company), 'staffing') THEN 'agency' WHEN regexp_matches(company, '^confidential$', 'i') THEN '^confidential$' END",
    "a": r"CASE WHEN regexp_matches(title, '\bdata (scientist|engineer)\b', 'i') THEN 'core role' WHEN contains(lower(title), 'machine learning') THEN 'machine learning' END",
    "d": r"CASE WHEN contains(lower(title), 'administrator') THEN 'administrator' WHEN regexp_matches(title, '\b(product|insights) analyst\b', 'i') THEN 'analyst' WHEN contains(lower(title), 'research') THEN 'research' END",
}
_FILTER = f"""h AS (SELECT *, {_HIT['p']} AS hp, {_HIT['c']} AS hc, {_HIT['a']} AS ha, {_HIT['d']} AS hd FROM parsed_postings),
q AS (SELECT *, CASE WHEN coalesce(trim(title), '') = '' THEN 'pass' WHEN hp IS NOT NULL OR hc IS NOT NULL THEN 'drop' WHEN ha IS NOT NULL THEN 'pass' WHEN hd IS NOT NULL THEN 'drop' ELSE 'pass' END AS action,
CASE WHEN coalesce(trim(title), '') = '' THEN 'empty title' ELSE coalesce(hp, hc, ha, hd) END AS reason FROM h)"""


def _decided(t):
    return t("parsed_postings").withColumn("d", decide(RULES, F.col("title"), F.col("company")))


@query(f"WITH {_FILTER} SELECT gmail_message_id, job_id, title, company, action, reason FROM q")
def title_filter(t):
    """FLT-01, 02, 03."""
    return _decided(t).select("gmail_message_id", "job_id", "title", "company", "d.action", "d.reason")


@query(f"WITH {_FILTER} SELECT action, coalesce(reason, '-') AS reason, count(*) AS n FROM q GROUP BY 1, 2")
def filter_summary(t):
    """FLT-10, SRT-06."""
    return _decided(t).groupBy("d.action", F.coalesce("d.reason", F.lit("-")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query(f"""WITH {_FILTER} SELECT gmail_message_id, count(*) AS extracted, count(DISTINCT job_id) AS jobs, count(*) FILTER (action = 'drop') AS filtered, bool_and(action = 'drop') AS all_filtered,
count(*) FILTER (title IS NULL AND company IS NULL) > 0.2 * count(*) AS poor FROM q WHERE gmail_message_id IS NOT NULL GROUP BY 1""")
def email_counters(t):
    """AGG-13, SNK-07, STR-10: counters per e-mail, whether all its postings were dropped, whether too many are bare links."""
    drop = F.col("d.action") == "drop"
    return _decided(t).where("gmail_message_id is not null").groupBy("gmail_message_id").agg(F.count("*").alias("extracted"), F.countDistinct("job_id").alias("jobs"), F.count_if(drop).alias("filtered"), F.bool_and(drop).alias("all_filtered"), (F.count_if(F.col("title").isNull() & F.col("company").isNull()) > 0.2 * F.count("*")).alias("poor"))


@query("WITH u AS (SELECT " + _URL.format(u="url") + " AS page, gmail_message_id, received_at FROM parsed_postings WHERE gmail_message_id IS NOT NULL) SELECT page, gmail_message_id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY received_at NULLS LAST, gmail_message_id) AS k FROM u) WHERE k = 1 AND page IS NOT NULL")
def email_credit(t):
    """JN-18: each page is credited to the first e-mail that names it."""
    u = t("parsed_postings").where("gmail_message_id is not null").withColumn("page", tx.canonical_url(F.col("url"))).where("page is not null")
    return rel.first_per_key(u, "page", [F.col("received_at").isNull(), F.col("received_at"), F.col("gmail_message_id")], ["gmail_message_id"])


@query("SELECT DISTINCT url FROM hydrated_jds WHERE url LIKE '%jobquill.example%' AND lower(hydration_status) IN ('partial', 'failed')")
def pending_pages(t):
    """FLT-04, JN-15: distinct addresses of one board still to be fetched, in order; all of them."""
    return t("hydrated_jds").where(F.col("url").like("%jobquill.example%") & F.lower("hydration_status").isin("partial", "failed")).select("url").distinct().orderBy("url")


@query("SELECT id FROM postings WHERE full_jd IS NOT NULL AND full_jd <> '' AND (hydration_status IS NULL OR hydration_status <> 'complete')")
def pending_extraction(t):
    """FLT-05: null-aware status test."""
    return t("postings").where((F.col("full_jd") != "") & ~F.col("hydration_status").eqNullSafe("complete")).select("id").orderBy("id")


@query("SELECT p.id FROM postings p WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = p.id) AND (role_summary IS NOT NULL OR full_jd IS NOT NULL)")
def pending_embedding(t):
    """FLT-06, STM-02, 03, SET-01."""
    return t("postings").where("role_summary is not null or full_jd is not null").select("id").join(t("embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")


@query(f"SELECT {_LABEL} AS board, substr(CAST(received_at AS VARCHAR), 1, 10) AS day, CASE WHEN length(title) > 16 THEN substr(title, 1, 16) || '...' ELSE title END AS title, count(*) AS n FROM parsed_postings WHERE received_at >= TIMESTAMP '2025-03-01' AND source = 'jobquill' GROUP BY 1, 2, 3")
def report_rows(t):
    """FLT-07, 08, 09, 11, STR-21, DT-05."""
    rows = rel.optional_filter(t("parsed_postings"), "2025-03-01 00:00:00", "jobquill")
    return rows.groupBy(tx.source_label(F.col("source")).alias("board"), F.substring(F.col("received_at").cast("string"), 1, 10).alias("day"), tx.excerpt(F.col("title"), 16).alias("title")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(o_orderpriority, 'TOTAL') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def report_totals(t):
    """AGG-08: rows and their totals in one pass."""
    return t("orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("o_orderpriority", F.lit("TOTAL")).alias("priority"), "n", "total")


@query("""WITH h AS (SELECT regexp_extract(lower(url), '//([^/?#:]+)', 1) AS host, lower(coalesce(hydration_status, 'failed')) = 'complete' AS ok, failure_reason, job_id FROM (SELECT DISTINCT job_id, url, hydration_status, failure_reason FROM hydrated_jds)),
g AS (SELECT host, count(*) AS n, count(*) FILTER (NOT ok) AS failed FROM h GROUP BY 1)
SELECT host, n, failed, CASE WHEN failed::DOUBLE / n <= 0.2 THEN 'healthy' WHEN failed < n THEN 'degraded' ELSE 'failed' END AS health FROM g""")
def source_health(t):
    """AGG-10, 11, 12: share of failures per host."""
    h = t("hydrated_jds").select("job_id", "url", "hydration_status", "failure_reason").distinct().withColumn("host", tx.host(F.col("url")))
    return rel.health(h, "host", F.lower(F.coalesce("hydration_status", F.lit("failed"))) == "complete", "failure_reason", "job_id").select("host", "n", "failed", "health")


@query("SELECT event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_type(t):
    """WIN-01."""
    return rel.latest(t("events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_type", "ts", "event_id")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_ok FROM events")
def last_ok(t):
    """WIN-02, JN-14."""
    return rel.carry_forward(t("events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") != "error", F.col("ts")), "last_ok").select("event_id", "user_id", "last_ok")


@query("WITH x AS (SELECT event_id, user_id, event_type, lag(event_type, 1, 'never_run') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) SELECT * FROM x WHERE event_type = 'error' AND previous IN ('click', 'view', 'purchase', 'signup', 'never_run')")
def health_transitions(t):
    """WIN-03: only the step from good to bad."""
    return rel.transitions(t("events"), "user_id", ["ts", "event_id"], "event_type", ["error"], ["click", "view", "purchase", "signup"]).select("event_id", "user_id", "event_type", "previous")


@query(f"""WITH {_LINKS}, x AS (SELECT l.canonical_id, l.posting_id, p.first_seen, max(p.first_seen) OVER (PARTITION BY l.canonical_id ORDER BY p.first_seen, l.posting_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM l JOIN postings p ON p.id = l.posting_id WHERE p.first_seen IS NOT NULL)
SELECT canonical_id, posting_id, previous, round((epoch_us(first_seen) - epoch_us(previous)) / 86400000000.0, 6) AS days FROM x WHERE epoch_us(first_seen) - epoch_us(previous) >= 30 * 86400000000""")
def repost_gap(t):
    """WIN-09, ER-12, AGG-07, DT-03: members first seen 30 days or more after all before."""
    rows = links(t).join(t("postings").select(F.col("id").alias("posting_id"), "first_seen"), "posting_id").where("first_seen is not null")
    return rel.gaps(rows, "canonical_id", ["first_seen", "posting_id"], "first_seen", 30).select("canonical_id", "posting_id", "previous", F.round("days", 6).alias("days"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(coalesce(sum(value), 0), 6) AS total, coalesce(max(event_id), 0) AS mark FROM events WHERE event_id > 500")
def watermark_delta(t):
    """AGG-02, 04, 05, 26, STM-05."""
    return t("events").where("event_id > 500").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.coalesce(F.sum("value"), F.lit(0)), 6).alias("total"), F.coalesce(F.max("event_id"), F.lit(0)).alias("mark"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1")
def month_to_date(t):
    """AGG-03, DT-04: from the month's first to the end of a given day."""
    e = t("events").where(in_month(F.col("ts").cast("timestamp_ntz"), F.lit("2024-01-10").cast("date")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


_SCORED = f"""{_LINKS}, {_PRIMARY}, s AS (SELECT id, canonical_title AS title, hydration_status AS status FROM postings),
x AS (SELECT (a.title = b.title) AS truth, l.similarity_score AS score FROM l JOIN f ON f.canonical_id = l.canonical_id JOIN s a ON a.id = l.posting_id JOIN s b ON b.id = f.posting_id WHERE l.similarity_score IS NOT NULL AND a.title IS NOT NULL AND b.title IS NOT NULL AND l.posting_id <> f.posting_id)"""
_SWEEP = f"""{_SCORED}, t(threshold) AS (VALUES (0.7::DOUBLE), (0.75), (0.8), (0.85), (0.9), (0.95)),
c AS (SELECT threshold, count(*) FILTER (truth AND score >= threshold) AS tp, count(*) FILTER (NOT truth AND score >= threshold) AS fp, count(*) FILTER (truth AND score < threshold) AS fn, count(*) FILTER (NOT truth AND score < threshold) AS tn FROM t CROSS JOIN x GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c),
r AS (SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0::DOUBLE ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM m)"""


def _sweep(t):
    p = t("postings").select("id", "canonical_title").where("canonical_title is not null")
    rows = links(t).where("similarity_score is not null").join(primary(t).withColumnRenamed("posting_id", "first"), "canonical_id").where("posting_id != first")
    rows = rows.join(p.select(F.col("id").alias("posting_id"), F.col("canonical_title").alias("a")), "posting_id").join(p.select(F.col("id").alias("first"), F.col("canonical_title").alias("b")), "first")
    return rel.confusion(rows, F.col("a") == F.col("b"), F.col("similarity_score"), [0.7, 0.75, 0.8, 0.85, 0.9, 0.95])


@query(f'WITH {_SWEEP} SELECT threshold, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r')
def precision_recall(t):
    """AGG-14, 15, MTH-02, ER-17: one pass over the pairs for all thresholds."""
    return _sweep(t).select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f'WITH {_SWEEP} SELECT threshold, round(f1, 6) AS f1 FROM r ORDER BY ("precision" >= 0.9) DESC, r.f1 DESC, threshold LIMIT 1')
def recommended_threshold(t):
    """AGG-16."""
    return rel.recommend(_sweep(t)).select("threshold", F.round("f1", 6).alias("f1"))


_FORMS = r"v AS (SELECT unnest(top_skills) AS form FROM postings), f AS (SELECT trim(regexp_replace(lower(form), '\s+', ' ', 'g')) AS key, form, count(*) AS n FROM v WHERE form IS NOT NULL AND trim(form) <> '' GROUP BY 1, 2)"


@query(f"""WITH {_FORMS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, CASE WHEN regexp_matches(form, '^[A-Z]') THEN 1 ELSE 0 END DESC, form DESC) AS k FROM f)
SELECT key, max(form) FILTER (k = 1) AS form, count(*) AS forms, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - max(n) AS BIGINT) AS displaced FROM r GROUP BY 1""")
def skill_clusters(t):
    """AGG-17, 18, 19, STR-24, JSN-05."""
    return rel.representatives(rel.clusters(t("postings").select(F.explode("top_skills").alias("v")), "v"))


@query(f"WITH {_FORMS}, g AS (SELECT key, count(*) AS forms, sum(n) AS total, sum(n) - max(n) AS d FROM f GROUP BY 1) SELECT count(*) FILTER (forms > 1) AS several, CAST(sum(d) AS BIGINT) AS displaced, round(sum(d) / sum(total), 6) AS share FROM g")
def skill_displacement(t):
    """AGG-20, 24."""
    r = rel.representatives(rel.clusters(t("postings").select(F.explode("top_skills").alias("v")), "v"))
    return r.agg(F.count_if(F.col("forms") > 1).alias("several"), F.sum("displaced").alias("displaced"), F.round(F.sum("displaced") / F.sum("total"), 6).alias("share"))


@query(f"WITH {_FORMS} SELECT key, form, n FROM f ORDER BY n DESC, key, form LIMIT 50")
def skill_top(t):
    """AGG-18, SRT-06, 07: a top-50 report."""
    return rel.clusters(t("postings").select(F.explode("top_skills").alias("v")), "v").orderBy(F.desc("n"), "key", "form").limit(50)


@query(f"WITH {_FORMS}, m(name, member) AS (VALUES ('code', 'python'), ('code', 'sql'), ('office', 'excel'), ('office', 'git'), ('none', 'cobol')) SELECT name, count(DISTINCT f.key) AS present, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM m LEFT JOIN f ON f.key = m.member GROUP BY 1")
def skill_groups(t):
    """AGG-21: which members of named groups occur, and how often."""
    forms = rel.clusters(t("postings").select(F.explode("top_skills").alias("v")), "v")
    names = forms.sparkSession.createDataFrame([("code", "python"), ("code", "sql"), ("office", "excel"), ("office", "git"), ("none", "cobol")], "name string, member string")
    return names.join(forms, F.col("key") == F.col("member"), "left").groupBy("name").agg(F.countDistinct("key").alias("present"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


@query(f"""WITH {_LINKS} SELECT l.canonical_id, min(p.first_seen) AS first_seen, max(p.last_seen) AS last_seen, count(DISTINCT l.posting_id) AS members FROM l JOIN postings p ON p.id = l.posting_id GROUP BY 1""")
def survivorship(t):
    """ER-13, 14: the part of survivorship that doesn't depend on order."""
    p = t("postings").select(F.col("id").alias("posting_id"), "first_seen", "last_seen")
    return links(t).join(p, "posting_id").groupBy("canonical_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.countDistinct("posting_id").alias("members"))


_PAGE = "CASE WHEN nullif(" + _BOARD + ", '') IS NOT NULL AND " + _JOB + " IS NOT NULL THEN " + _BOARD + " || '/' || " + _JOB + " END"


@query("""WITH h AS (SELECT job_id, max(title) AS title, max(company) AS company, max(description) AS description FROM (SELECT DISTINCT job_id, title, company, description FROM hydrated_jds WHERE job_id IS NOT NULL) GROUP BY 1),
u AS (SELECT posting_id, min(""" + _JOB.format(u="url") + """) AS job_id FROM seen_urls GROUP BY 1)
SELECT p.id, coalesce(h.title, p.canonical_title) AS canonical_title, coalesce(h.company, p.canonical_company) AS canonical_company, length(coalesce(h.description, p.full_jd)) AS n FROM postings p LEFT JOIN u ON u.posting_id = p.id LEFT JOIN h ON h.job_id = u.job_id""")
def hydrated_update(t):
    """SNK-05, 08, 09: new values where the page gave any, old ones else."""
    h = t("hydrated_jds").where("job_id is not null").select("job_id", F.col("title").alias("canonical_title"), F.col("company").alias("canonical_company"), F.col("description").alias("full_jd")).distinct().groupBy("job_id").agg(F.max("canonical_title").alias("canonical_title"), F.max("canonical_company").alias("canonical_company"), F.max("full_jd").alias("full_jd"))
    u = t("seen_urls").groupBy(F.col("posting_id").alias("id")).agg(F.min(tx.job_id(F.col("url"))).alias("job_id"))
    news = u.join(h, "job_id").drop("job_id")
    p = t("postings").select("id", "canonical_title", "canonical_company", "full_jd")
    return rel.coalesce_update(p, news, "id", ["canonical_title", "canonical_company", "full_jd"]).select("id", "canonical_title", "canonical_company", F.length("full_jd").alias("n"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1")
def keyed_increment(t):
    """SNK-06."""
    o = t("orders")
    zero = o.select("o_custkey").distinct().select("o_custkey", F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("failed"))
    return rel.increment(zero, o, "o_custkey", F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus <> 'F')")
def stale_removal(t):
    """SNK-16, 17."""
    return rel.delete_where(t("orders"), (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "F"))[0].select("o_orderkey", "o_orderdate")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_rollup(t):
    """JSN-01, 05: malformed documents count as null."""
    return t("events").withColumn("k", F.from_json("props", "k long")["k"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("""WITH e AS (SELECT id, unnest(top_skills) AS s, generate_subscripts(top_skills, 1) AS i FROM postings), c AS (SELECT id, s, i, lower(trim(s)) AS k FROM e WHERE s IS NOT NULL AND trim(s) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN k IN ('python', 'sql', 'statistics') THEN 0 ELSE 1 END, CASE WHEN contains(k, 'modeling') THEN 0 WHEN contains(k, 'forecasting') THEN 1 WHEN contains(k, 'testing') THEN 2 WHEN contains(k, 'governance') THEN 3 ELSE 4 END, i) AS r FROM c)
SELECT id, string_agg(s, '|' ORDER BY r) FILTER (r <= 10) AS skills, count(*) FILTER (k IN ('python', 'sql', 'statistics')) AS matched, count(*) AS total FROM o GROUP BY 1""")
def skill_tiers(t):
    """SRT-03, STR-22, 23, AGG-24, ARR-01: matches first, then categories, then as given; ten at most, counted before."""
    p = t("postings").select("id", F.filter("top_skills", lambda x: x.isNotNull() & (F.trim(x) != "")).alias("a")).where("size(a) > 0")
    low = lambda s: F.lower(F.trim(s))

    def keyed(s, i):
        cat = F.lit(len(SKILL_ORDER))
        for k in range(len(SKILL_ORDER) - 1, -1, -1):
            cat = F.when(low(s).contains(SKILL_ORDER[k]), k).otherwise(cat)
        return F.struct((~low(s).isin(*PROFILE)).cast("int").alias("m"), cat.alias("c"), i.alias("i"), s.alias("s"))

    ordered = F.transform(F.slice(F.array_sort(F.transform("a", keyed)), 1, 10), lambda x: x["s"])
    return p.select("id", F.array_join(ordered, "|").alias("skills"), F.size(F.filter("a", lambda s: low(s).isin(*PROFILE))).cast("long").alias("matched"), F.size("a").cast("long").alias("total"))


@query(f"SELECT id, {_LABEL} AS board, CASE {_LABEL} WHEN 'stellaroles' THEN 1 WHEN 'werkpost' THEN 2 WHEN 'jobquill' THEN 3 ELSE 4 END AS place FROM posting_sources")
def source_order(t):
    """SRT-04, STR-19: boards by their place in a list, unknown ones last."""
    b = tx.source_label(F.col("source"))
    at = F.array_position(F.array(*[F.lit(x) for x in ("stellaroles", "werkpost", "jobquill")]), b)
    return t("posting_sources").select("id", b.alias("board"), F.when(at > 0, at).otherwise(4).cast("int").alias("place"))


@query(r"SELECT DISTINCT company, coalesce(nullif(regexp_replace(trim(company), '(?:[\s,]+(?:Inc|Incorporated|Ltd|Limited|Corp|Corporation|LLC|LLP|Co|Company|GmbH|PLC)\.?)+$', '', 'i'), ''), company) AS bare FROM parsed_postings WHERE company IS NOT NULL")
def legal_forms(t):
    """STR-18."""
    return t("parsed_postings").where("company is not null").select("company", tx.strip_legal_form(F.col("company")).alias("bare")).distinct()


@query("SELECT id, CASE WHEN trim(role_summary) <> '' THEN 'role_summary' WHEN trim(full_jd) <> '' THEN 'full_jd' END AS kind, sha256(coalesce(nullif(trim(role_summary), ''), nullif(trim(full_jd), ''))) AS text_hash FROM postings")
def text_source(t):
    """STR-25, 26, 28, ER-21: which text stands for a posting, and its hash."""
    kind = F.when(F.trim("role_summary") != "", "role_summary").when(F.trim("full_jd") != "", "full_jd")
    return t("postings").select("id", kind.alias("kind"), tx.text_hash(tx.text_choice(F.col("role_summary"), F.col("full_jd"))).alias("text_hash"))


@query("SELECT DISTINCT job_id FROM hydrated_jds WHERE contains(description, 'Just a moment') OR contains(description, 'Verify you are human') OR contains(description, 'cf-challenge') OR contains(description, 'Checking your browser') OR contains(description, 'Unusual traffic')")
def challenge_pages(t):
    """STR-29, SRC-08."""
    return t("hydrated_jds").where(tx.challenged(F.col("description"))).select("job_id").distinct()


@query("""WITH s AS (SELECT unnest([1, 2, 3, 4, 5]) AS score) SELECT s.score, count(p.id) AS n, round(count(p.id)::DOUBLE / (SELECT count(*) FROM postings WHERE fit_score IS NOT NULL), 6) AS share FROM s LEFT JOIN postings p ON p.fit_score = s.score GROUP BY 1""")
def score_histogram(t):
    """AGG-22, JN-22: counts over all of 1..5, also where there are none."""
    p = t("postings").where("fit_score is not null")
    spine = p.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("score"))
    total = p.agg(F.count("*").alias("all"))
    return spine.join(p.groupBy(F.col("fit_score").alias("score")).agg(F.count("*").alias("k")), "score", "left").crossJoin(F.broadcast(total)).select("score", F.coalesce("k", F.lit(0)).alias("n"), F.round(F.coalesce("k", F.lit(0)) / F.col("all"), 6).alias("share"))


@query(f"""WITH {_LINKS}, {_PRIMARY} SELECT l.posting_id, b.fit_score AS old_score, a.fit_score AS new_score, CASE WHEN a.fit_score > b.fit_score THEN 'UP' WHEN a.fit_score < b.fit_score THEN 'DOWN' ELSE 'SET' END AS direction
FROM l JOIN f USING (canonical_id) JOIN postings a ON a.id = l.posting_id JOIN postings b ON b.id = f.posting_id WHERE a.fit_score IS DISTINCT FROM b.fit_score""")
def changed_values(t):
    """FLT-14: null-aware change against the first member, with its direction."""
    p = t("postings").select("id", "fit_score")
    rows = links(t).select("posting_id", "canonical_id").join(primary(t).withColumnRenamed("posting_id", "first"), "canonical_id")
    rows = rows.join(p.select(F.col("id").alias("posting_id"), F.col("fit_score").alias("new_score")), "posting_id").join(p.select(F.col("id").alias("first"), F.col("fit_score").alias("old_score")), "first")
    way = F.when(F.col("new_score") > F.col("old_score"), "UP").when(F.col("new_score") < F.col("old_score"), "DOWN").otherwise("SET")
    return rows.where(~F.col("new_score").eqNullSafe(F.col("old_score"))).select("posting_id", "old_score", "new_score", way.alias("direction"))


@query("SELECT id, array_to_string(list_filter(tags, lambda x: x NOT IN ('urgent', 'part-time', 'remote', 'contract', 'full-time')), ',') AS bad FROM postings WHERE tags IS NOT NULL")
def unknown_tags(t):
    """ARR-03: list items outside their enumeration."""
    known = ("urgent", "part-time", "remote", "contract", "full-time")
    return t("postings").where("tags is not null").select("id", F.array_join(F.filter("tags", lambda x: ~x.isin(*known)), ",").alias("bad"))


@query("SELECT company AS name FROM parsed_postings WHERE company IS NOT NULL INTERSECT SELECT canonical_company FROM postings")
def shared_names(t):
    """Set operations (section 2.8)."""
    return t("parsed_postings").where("company is not null").select(F.col("company").alias("name")).intersect(t("postings").select("canonical_company"))


@query("SELECT id, user_id, first_seen FROM postings WHERE contains(lower(canonical_title), 'engineer') AND id IN (SELECT posting_id FROM seen_urls)")
def search_cards(t):
    """FLT-12, 13, JN-11, 12, 17: substring search within a semi join."""
    return t("postings").where(F.lower("canonical_title").contains("engineer")).join(t("seen_urls").select(F.col("posting_id").alias("id")), "id", "left_semi").select("id", "user_id", "first_seen")


@query()
def mail_postings(t):
    """SRC-04, 05, STR-05..09: the jobs that raw e-mails name. Python parses, so there is no SQL."""
    from ..sources.mail import postings_of, read_messages

    raw = t("parsed_postings").where("raw_body is not null and gmail_message_id is not null").select(F.col("gmail_message_id").alias("id"), F.col("raw_body").alias("body")).dropDuplicates(["id"])
    return postings_of(read_messages(raw))


@query()
def page_fields(t):
    """STR-11..15: title, text and status of every stored page, by structured data or scraping."""
    from ..sources.pages import hydrate

    return hydrate(t("posting_sources").where("raw_html is not null"), "id", "raw_html")


@query()
def greedy_resolution(t):
    """ER-07..16, 21: sequential resolution block by block; compared with a plain fold in the tests."""
    from ..operators.providers import HashEmbedder, embed_rows
    from ..operators.resolve import resolve

    p = t("postings").withColumn("text", tx.text_choice(F.col("role_summary"), F.col("full_jd")))
    vectors, _ = embed_rows(p.select("id", "text"), "id", "text", HashEmbedder(32))
    p = p.join(vectors.select("id", F.col("embedding").alias("vector")), "id", "left")
    rows = p.select(F.col("id").alias("posting_id"), "user_id", F.col("canonical_company").alias("company"), F.col("team_or_department").alias("team"), F.col("canonical_location").alias("location"), F.col("canonical_title").alias("title"), F.col("seniority_band").alias("seniority"), F.col("top_skills").alias("skills"), "vector", F.when(F.trim("role_summary") != "", "role_summary").otherwise("full_jd").alias("source_kind"), "first_seen", "last_seen", "full_jd", F.lit(None).cast("string").alias("source"))
    return resolve(rows, verdict=lambda a, b, s: s >= 0.85)


from . import records  # noqa: E402, F401 - more queries, registered by being imported
