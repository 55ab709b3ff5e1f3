"""Queries over ledgers, states, vectors, caches and runs, and their SQL; see `catalogue`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim, text as tx
from ..operators import extraction as ex, ledger as lg, relational as rel, state as st
from .catalogue import _LINKS, _PRIMARY, links, primary, query

#: Own prices a thousand tokens, in and out, of made-up models (fixed values).
PRICES = {"posting_text": (0.5, 1.5), "alert_email": (0.25, 0.75), "recruiter_note": (1.0, 2.0)}
_PRICE = "(VALUES ('posting_text', 0.5, 1.5), ('alert_email', 0.25, 0.75), ('recruiter_note', 1.0, 2.0)) AS p(model, i, o)"
_CALLS = f"""c AS (SELECT doc_id, received_at AS called, kind AS model, length(text) // 4 AS tokens_in, length(text) // 40 AS tokens_out, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM documents WHERE text IS NOT NULL),
g AS (SELECT c.*, coalesce(tokens_in / 1000.0::DOUBLE * p.i::DOUBLE + tokens_out / 1000.0::DOUBLE * p.o::DOUBLE, 0.0::DOUBLE) AS cost FROM c LEFT JOIN {_PRICE} ON p.model = c.model)"""


def _calls(t):
    n = F.length("text")
    return t("documents").where("text is not null").select(F.col("received_at").alias("at"), F.col("doc_id").alias("item"), F.col("kind").alias("model"), F.floor(n / 4).alias("tokens_in"), F.floor(n / 40).alias("tokens_out"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("success").alias("status"))


@query(f"WITH {_CALLS} SELECT CAST(doc_id AS VARCHAR) AS item, tokens_in, tokens_out, round(cost, 6) AS cost FROM g")
def token_cost(t):
    """MTH-01, SNK-13: what each call costs; an unknown model nothing."""
    return lg.entries(_calls(t), "extraction", PRICES).select("item", "tokens_in", "tokens_out", F.round("cost", 6).alias("cost"))


@query(f"WITH {_CALLS} SELECT writer, count(*) AS n, round(sum(CASE WHEN writer = 'embedding_cache_hit' THEN 0 ELSE cost END), 4) AS cost FROM g CROSS JOIN (VALUES ('extraction'), ('verdict'), ('provider'), ('embedding_cache_hit')) AS w(writer) GROUP BY 1")
def ledger_by_writer(t):
    """SNK-13: rows of all writers in one ledger."""
    all_ = None
    for w in lg.WRITERS:
        one = lg.entries(_calls(t), w, PRICES)
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("writer").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query(f"WITH {_CALLS}, m AS (SELECT coalesce(sum(cost) FILTER (status = 'success' AND called >= TIMESTAMP '2025-03-01' AND called < TIMESTAMP '2025-03-16'), 0) AS month_cost FROM g) SELECT round(month_cost, 4) AS month_cost, month_cost > 0.01 AS warn FROM m")
def cost_watchdog(t):
    """AGG-03, AGG-25."""
    return lg.watchdog(lg.entries(_calls(t), "extraction", PRICES), F.lit("2025-03-15").cast("date"), 0.01).select(F.round("month_cost", 4).alias("month_cost"), "warn")


@query(f"WITH {_CALLS} SELECT round(coalesce(sum(cost), 0), 4) AS cost, count(*) AS calls, 0 AS hits FROM g WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def batch_cost(t):
    """AGG-26: a batch's share of the ledger."""
    ids = t("documents").where("lang = 'fr'").select(F.col("doc_id").alias("item"))
    return lg.batch_totals(lg.entries(_calls(t), "extraction", PRICES), ids).select(F.round("cost", 4).alias("cost"), "calls", F.col("hits").cast("int").alias("hits"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def counts_since(t):
    """AGG-06, DT-06: rows per status from a time on."""
    return t("events").where(F.col("ts").cast("timestamp_ntz") >= F.lit("2024-01-10").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT regexp_extract(lower(url), '//([^/?#:]+)', 1) AS source, count(DISTINCT job_id) AS added, CASE WHEN avg(CASE WHEN lower(hydration_status) = 'complete' THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'healthy' ELSE 'degraded' END AS health FROM hydrated_jds GROUP BY 1) SELECT CAST(sum(added) AS BIGINT) AS new_rows, coalesce(array_to_string(list_sort(list(source) FILTER (health <> 'healthy')), ','), '') AS not_healthy FROM h")
def run_summary(t):
    """AGG-23."""
    ok = F.coalesce((F.lower("hydration_status") == "complete").cast("double"), F.lit(0.0))
    runs = t("hydrated_jds").groupBy(tx.host(F.col("url")).alias("source")).agg(F.countDistinct("job_id").alias("added"), F.when(F.avg(ok) >= 0.8, "healthy").otherwise("degraded").alias("health"))
    return lg.run_summary(runs).select("new_rows", F.array_join("not_healthy", ",").alias("not_healthy"))


@query("SELECT count(*) FILTER (fit_score IS NULL OR fit_score > 1) AS main, count(*) FILTER (fit_score = 1) AS dismissed, count(*) FILTER (hydration_status = 'failed') AS failed FROM postings")
def tab_counts(t):
    """AGG-09: three counts in one pass."""
    return t("postings").agg(F.count_if(F.col("fit_score").isNull() | (F.col("fit_score") > 1)).alias("main"), F.count_if(F.col("fit_score") == 1).alias("dismissed"), F.count_if(F.col("hydration_status") == "failed").alias("failed"))


@query("SELECT canonical_company, min(id) AS first_id, count(*) AS n FROM postings WHERE canonical_company IS NOT NULL GROUP BY 1 ORDER BY lower(canonical_company), canonical_company")
def report_sorted(t):
    """SRT-05: a report in order of names, whatever their case."""
    return t("postings").where("canonical_company is not null").groupBy("canonical_company").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).orderBy(F.lower("canonical_company"), "canonical_company")


@query(f"""WITH {_LINKS}, v AS (SELECT l.canonical_id, l.posting_id, e.embedding, CASE WHEN trim(p.role_summary) <> '' THEN 1 ELSE 0 END AS own, l.merged_at FROM l JOIN postings p ON p.id = l.posting_id JOIN embeddings e ON e.vec_id = l.posting_id WHERE l.merged_at IS NOT NULL)
SELECT canonical_id, posting_id, round(embedding[1]::DOUBLE, 6) AS v0 FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY own DESC, merged_at DESC, posting_id) AS k FROM v) WHERE k = 1""")
def canonical_vector(t):
    """JN-07: each job's newest linked vector, of summaries before other texts."""
    own = t("postings").select(F.col("id").alias("posting_id"), F.coalesce(F.trim("role_summary") != "", F.lit(False)).alias("own"))
    vectors = t("embeddings").select(F.col("vec_id").alias("posting_id"), F.col("embedding").alias("vector")).join(own, "posting_id")
    rows = links(t).where("merged_at is not null").select("canonical_id", "posting_id", "merged_at").distinct()
    return st.newest_vector(rows, vectors, "canonical_id", "posting_id", F.col("own"), "merged_at").select("canonical_id", "posting_id", F.round(F.col("vector")[0].cast("double"), 6).alias("v0"))


@query(f"WITH {_LINKS} SELECT canonical_id, min(CASE WHEN p.hydration_status = 'failed' THEN posting_id END) AS failed, min(CASE WHEN p.fit_score = 1 THEN posting_id END) AS dismissed FROM l LEFT JOIN postings p ON p.id = l.posting_id GROUP BY 1")
def canonical_state(t):
    """JN-16: which member drove each state of a job."""
    p = t("postings").withColumnRenamed("id", "posting_id")
    return st.drivers(links(t).select("canonical_id", "posting_id").distinct(), "canonical_id", "posting_id", failed=p.where("hydration_status = 'failed'"), dismissed=p.where("fit_score = 1"))


@query(f"WITH {_LINKS}, {_PRIMARY} SELECT DISTINCT l.posting_id, f.posting_id AS first, a.canonical_title AS title_a, b.canonical_title AS title_b, a.canonical_company AS company_a, b.canonical_company AS company_b FROM l JOIN f ON f.canonical_id = l.canonical_id LEFT JOIN postings a ON a.id = l.posting_id LEFT JOIN postings b ON b.id = f.posting_id WHERE l.posting_id <> f.posting_id")
def pair_enrichment(t):
    """JN-20: pairs with the fields of both ends."""
    p = t("postings")
    end = lambda k, s: p.select(F.col("id").alias(k), F.col("canonical_title").alias(f"title_{s}"), F.col("canonical_company").alias(f"company_{s}"))
    pairs = links(t).select("canonical_id", "posting_id").join(primary(t).withColumnRenamed("posting_id", "first"), "canonical_id").where("posting_id != first").select("posting_id", "first").distinct()
    return pairs.join(end("posting_id", "a"), "posting_id", "left").join(end("first", "b"), "first", "left").select("posting_id", "first", "title_a", "title_b", "company_a", "company_b")


# Vectors of titles: here those of the table, a title's being that of the least posting with it; a provider's stand in the same place.
_TITLED = f"""{_LINKS}, {_PRIMARY}, n AS (SELECT count(*) AS n FROM embeddings), q AS (SELECT canonical_title, min(id) % (SELECT n FROM n) AS vec_id FROM postings WHERE trim(canonical_title) <> '' GROUP BY 1), v AS (SELECT q.canonical_title, e.embedding::DOUBLE[] AS e FROM q JOIN embeddings e USING (vec_id)),
s AS (SELECT p.id, p.seniority_band, p.canonical_title, (SELECT n FROM n) AS n, list_distinct(list_transform(list_filter(coalesce(top_skills, []), lambda x: x IS NOT NULL), lambda x: lower(x))) AS s FROM postings p),
x AS (SELECT DISTINCT l.posting_id, f.posting_id AS first, CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END AS skills,
CASE WHEN lower(trim(a.seniority_band)) = lower(trim(b.seniority_band)) THEN 1.0 ELSE 0.0 END AS seniority, coalesce(list_cosine_similarity(va.e, vb.e), 0.0) AS title, coalesce(list_cosine_similarity(ea.embedding::DOUBLE[], eb.embedding::DOUBLE[]), 0.0) AS embedding
FROM l JOIN f ON f.canonical_id = l.canonical_id JOIN s a ON a.id = l.posting_id JOIN s b ON b.id = f.posting_id LEFT JOIN v va ON va.canonical_title = a.canonical_title LEFT JOIN v vb ON vb.canonical_title = b.canonical_title
LEFT JOIN embeddings ea ON ea.vec_id = a.id % a.n LEFT JOIN embeddings eb ON eb.vec_id = b.id % b.n WHERE l.posting_id <> f.posting_id)"""


def _fused(t):
    e = t("embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    p = t("postings").join(F.broadcast(n))  # one row
    title = p.where("trim(canonical_title) != ''").groupBy("canonical_title", "n").agg(F.min("id").alias("low")).select("canonical_title", F.pmod("low", "n").alias("vec_id")).join(e, "vec_id").select("canonical_title", F.col("embedding").alias("tv"))
    own = p.select("id", "seniority_band", "canonical_title", "top_skills", F.pmod("id", "n").alias("vec_id")).join(title, "canonical_title", "left").join(e, "vec_id", "left")
    end = lambda k, s: own.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("seniority_band", "top_skills", "tv", "embedding")])
    pairs = links(t).select("canonical_id", "posting_id").join(primary(t).withColumnRenamed("posting_id", "first"), "canonical_id").where("posting_id != first").select("posting_id", "first").distinct()
    both = pairs.join(end("posting_id", "a"), "posting_id").join(end("first", "b"), "first")
    c = lambda name: (F.col(f"{name}_a"), F.col(f"{name}_b"))
    return both.select("posting_id", "first", sim.cosine(*c("embedding")).alias("embedding"), sim.jaccard(*c("top_skills")).alias("skills"), sim.cosine(*c("tv")).alias("title"), sim.same_seniority(*c("seniority_band")).alias("seniority"))


@query(f"WITH {_TITLED} SELECT posting_id, first, round(title, 6) AS title, round(0.4 * embedding + 0.3 * skills + 0.2 * title + 0.1 * seniority, 6) AS score FROM x")
def fused_vectors(t):
    """ER-04, 05: cosine of titles and the fused score over vectors."""
    score = sim.fuse(F.col("embedding"), F.col("skills"), F.col("title"), F.col("seniority"))
    return _fused(t).select("posting_id", "first", F.round("title", 6).alias("title"), F.round(score, 6).alias("score"))


@query(f"WITH {_TITLED} SELECT posting_id, first, round(title, 6) AS title FROM x WHERE skills >= 1 - 1e-6 AND seniority >= 1 AND title < 0.9")
def title_drag(t):
    """ER-18: pairs alike in all but their titles."""
    return _fused(t).where(sim.exact(F.col("skills"), F.col("seniority")) & (F.col("title") < 0.9)).select("posting_id", "first", F.round("title", 6).alias("title"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'dismissed' WHEN 'error' THEN 'main' END AS t FROM events)
SELECT u.user_id, coalesce(w.t, 'main') AS state FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e WHERE t IS NOT NULL) w ON w.user_id = u.user_id AND w.k = 1""")
def item_states(t):
    """STM-07, SNK-16: the state each key's last move leads to; undoing leads back."""
    return st.states(t("events"), ["user_id"], "event_type", ["ts", "event_id"], {"purchase": "applied", "signup": "dismissed", "error": "main"})


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    """STM-08: sessions by gaps."""
    return st.sessions(t("events"), "user_id", "ts")


_CACHE = "c AS (SELECT sha256(text) AS text_hash, kind AS version, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)"


def _cache(t):
    return t("documents").where("text is not null").groupBy(tx.text_hash(F.col("text")).alias("text_hash"), F.col("kind").alias("version")).agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {_CACHE} SELECT text_hash, version, doc_id FROM c WHERE text_hash NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND lang = 'de')")
def cache_bust(t):
    """SNK-18: entries of some rows' texts go."""
    return ex.bust(_cache(t), t("documents").where("lang = 'de'"), "text")[0].select("text_hash", "version", "doc_id")


@query(f"WITH {_CACHE} SELECT version, count(*) AS n, count(*) FILTER (text_hash IN (SELECT text_hash FROM c WHERE version = 'posting_text')) AS hits FROM c GROUP BY 1")
def cache_versions(t):
    """STM-04, ER-21: what a cache under one version serves to others."""
    c = _cache(t)
    return rel.flag(c, c.where("version = 'posting_text'"), "text_hash", "hit").groupBy("version").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("SELECT p.id, CASE WHEN p.id IN (SELECT CAST(posting_id AS BIGINT) FROM posting_canonical_links WHERE similarity_score < 0.9) THEN 'failed' END AS extraction_status FROM postings p")
def failure_marks(t):
    """SNK-10: a status column, added where there is none."""
    bad = links(t).where("similarity_score < 0.9").select(F.col("posting_id").alias("id"))
    return ex.mark_failed(t("postings").select("id"), bad, "id").select("id", "extraction_status")


@query("SELECT id, '{\"id\":' || id || ',\"band\":\"' || CASE lower(trim(seniority_band)) WHEN 'senior' THEN 'S' WHEN 'junior' THEN 'J' ELSE '?' END || '\"}' AS doc FROM postings WHERE seniority_band IS NOT NULL")
def json_documents(t):
    """JSN-02, MAP-01: documents with a value by a map of literals."""
    bands = F.create_map(F.lit("senior"), F.lit("S"), F.lit("junior"), F.lit("J"))
    band = F.coalesce(F.try_element_at(bands, F.lower(F.trim("seniority_band"))), F.lit("?"))
    return t("postings").where("seniority_band is not null").select("id", F.to_json(F.struct("id", band.alias("band"))).alias("doc"))


@query("SELECT id, concat_ws(';', CASE WHEN trim(hydration_status) IN ('complete', 'partial', 'failed') THEN NULL WHEN hydration_status IS NULL THEN 'status: missing' ELSE 'status: ' || trim(hydration_status) END, CASE WHEN fit_score IS NOT NULL AND fit_score NOT BETWEEN 1 AND 4 THEN 'score: ' || fit_score END, CASE WHEN len(top_skills) > 8 THEN 'skills: ' || len(top_skills) END) AS bad FROM postings")
def document_errors(t):
    """JSN-03, 04: enumerations, ranges and counts of documents."""
    status, score, n = F.trim("hydration_status"), F.col("fit_score"), F.size("top_skills")
    bad = F.array_compact(F.array(F.when(status.isNull(), "status: missing").when(~status.isin("complete", "partial", "failed"), F.concat(F.lit("status: "), status)), F.when((score < 1) | (score > 4), F.concat(F.lit("score: "), score.cast("string"))), F.when(F.col("top_skills").isNotNull() & (n > 8), F.concat(F.lit("skills: "), n.cast("string")))))
    return t("postings").select("id", F.array_join(bad, ";").alias("bad"))


@query("SELECT id, strftime(first_seen, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, round((epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000.0, 2) AS days FROM postings WHERE first_seen IS NOT NULL AND last_seen IS NOT NULL")
def iso_days(t):
    """DT-01, MTH-03: times in ISO form with their zone, and days between to two places."""
    p = t("postings").where("first_seen is not null and last_seen is not null")
    days = (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86400000000
    return p.select("id", F.concat(F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"), F.round(days, 2).alias("days"))


@query("SELECT l.url, p.id, p.canonical_title FROM (SELECT DISTINCT url, posting_id FROM seen_urls) l JOIN postings p ON p.id = l.posting_id")
def keyed_lookup(t):
    """SRC-18, JN-15: lookups by key as one join."""
    return t("seen_urls").select("url", F.col("posting_id").alias("id")).distinct().join(t("postings").select("id", "canonical_title"), "id").select("url", "id", "canonical_title")


@query("SELECT p.id, s.source, p.hydration_status FROM postings p JOIN posting_sources s ON s.posting_id = p.id WHERE s.source IS NOT NULL AND p.user_id IN ('default', 'user-25', 'user-16')")
def source_rows(t):
    """JN-11, FLT-11: rows multiplied by their sources, of a list of users."""
    s = t("posting_sources").where("source is not null").select(F.col("posting_id").alias("id"), "source")
    return t("postings").where(F.col("user_id").isin("default", "user-25", "user-16")).select("id", "hydration_status").join(s, "id").select("id", "source", "hydration_status")
