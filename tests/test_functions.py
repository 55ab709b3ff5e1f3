from pyspark.sql import functions as F

from vacancia.functions import similarity as sim, text as tx


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("r")).first()[0]


def test_urls(spark):
    for u, page in (
        ("HTTPS://WWW.JOBQUILL.EXAMPLE/comm/jobs//view/1000018725/?from=mail&pos=8#top", "https://jobquill.example/job/1000018725"),
        ("http://DE.werkpost.example/rc/viewjob?JK=AF3E5AE9575FD178&trk=eml", "https://werkpost.example/job/af3e5ae9575fd178"),
        ("https://stellaroles.example/fr/o/1000023692/?", "https://stellaroles.example/job/1000023692"),
        ("https://example.org/about", "https://example.org/about"),
    ):
        assert one(spark, tx.canonical_url(F.col("u")), u=u) == page


def test_names_and_text(spark):
    assert one(spark, tx.strip_legal_form(F.col("n")), n="Acme Foods, Inc.") == "Acme Foods"
    assert one(spark, tx.strip_legal_form(F.col("n")), n="Ltd.") == "Ltd."
    assert one(spark, tx.source_label(F.col("s")), s=" WERKPOST_Email") == "werkpost"
    assert one(spark, tx.source_label(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, tx.blank_to_null(F.col("s")), s="  ") is None
    assert one(spark, tx.blank_to_null(F.col("s")), s=" a ") == " a "
    assert one(spark, tx.excerpt(F.col("s"), 3), s="abcd") == "abc..." and one(spark, tx.excerpt(F.col("s"), 4), s="abcd") == "abcd"
    assert one(spark, tx.text_choice(F.col("a"), F.col("b")), a=" ", b=" x ") == "x"
    assert one(spark, tx.indent(F.col("s")), s="a\nb") == "  a\n  b" and one(spark, tx.indent(F.col("s")), s="") == "  (none)"
    assert one(spark, tx.ratio(F.lit(1), F.lit(0))) == 0
    assert one(spark, tx.lenient_timestamp(F.lit("nonsense"))) is None


def test_jaccard_cosine(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    assert one(spark, sim.jaccard(arr("A", "b"), arr("a", "c"))) == 1 / 3
    assert one(spark, sim.jaccard(arr(), arr("a"))) == 0 and one(spark, sim.jaccard(arr(), arr())) == 0
    assert one(spark, sim.jaccard(F.lit(None).cast("array<string>"), arr("a"))) == 0
    assert one(spark, sim.cosine(arr(1.0, 0.0), arr(0.0, 0.0))) == 0
    assert abs(one(spark, sim.cosine(arr(1.0, 2.0), arr(2.0, 4.0))) - 1) < 1e-12


def test_fuse_and_tiers(spark):
    for parts, score in (((1, 1, 1, 1), 1.0), ((1, 0, 0, 0), 0.4), ((0, 0.5, 0, 1), 0.25), ((0.95, 1, 0.9, 1), 0.96), ((0.7, 0.5, 0.6, 0), 0.55)):
        assert abs(one(spark, sim.fuse(*[F.lit(float(p)) for p in parts])) - score) < 1e-9
    assert one(spark, sim.exact(F.lit(1.0), F.lit(0.99))) is False
    assert one(spark, sim.exact(F.lit(1.0), F.lit(1 - 5e-7))) is True
    t = lambda s, e, v=None: one(spark, sim.tier(F.lit(s).cast("double"), F.lit(e), None if v is None else F.lit(v)))
    assert (t(None, False), t(0.74, True), t(0.75, False), t(0.75, False, True), t(0.9, False, False), t(0.8, True)) == ("new", "new", "pending", "merge_approved", "new", "merge_exact")
    assert one(spark, sim.same_seniority(F.lit(" Senior"), F.lit("SENIOR "))) == 1 and one(spark, sim.same_seniority(F.lit(""), F.lit(""))) == 1
    assert one(spark, sim.same_seniority(F.lit(None).cast("string"), F.lit("a"))) == 0
