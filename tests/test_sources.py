import datetime as dt

from vacancia.sources import mail, pages, tables

PLAIN = b"From: =?utf-8?q?J=C3=B6rg?= <a@b.example>\nSubject: =?utf-8?b?w4k=?=\nDate: Tue, 06 May 2025 02:28:00 +0200\nContent-Type: text/plain; charset=utf-8\n\nEngineer - https://www.jobquill.example/jobs/view/1000000001?x=1\nhttps://jobquill.example/jobs/view/1000000001\nnothing http://example.org/a\n"
PAGE = b'Date: no\nContent-Type: text/html\n\n<p><a href="https://de.werkpost.example/viewjob?jk=0a1b2c3d4e5f6a7b&amp;t=1">Data Scientist</a> <span>Acme</span><span>Bern</span></p>'


def test_messages(spark, tmp_path):
    (tmp_path / "m1.eml").write_bytes(PLAIN)
    (tmp_path / "m2.eml").write_bytes(PAGE)
    m = mail.read_messages(mail.read_folder(spark, str(tmp_path)))
    r = {x["id"]: x for x in m.collect()}
    assert r["m1"]["sender"].startswith("Jörg") and r["m1"]["subject"] == "É" and r["m1"]["sent_at"] == dt.datetime(2025, 5, 6, 0, 28)
    assert r["m2"]["sent_at"] is None
    got = {x["id"]: x for x in mail.postings_of(m).collect()}
    assert len(got) == 2 and got["m1"]["url"] == "https://jobquill.example/job/1000000001" and got["m1"]["title"] == "Engineer" and got["m1"]["raw_url"].endswith("?x=1")
    assert (got["m2"]["title"], got["m2"]["company"], got["m2"]["location"], got["m2"]["job_id"]) == ("Data Scientist", "Acme", "Bern", "0a1b2c3d4e5f6a7b")


def test_html_to_text():
    assert pages.html_to_text("<p>a<br>b</p><div>c  </div>\n\n\n<p>d</p>") == "a\nb\n\nc\n\nd"
    assert pages.html_to_text(None) is None and pages.html_to_text("") == "" and pages.html_to_text("  x ") == "x"
    assert pages.html_to_text("<script>no</script><p>1 &lt; 2</p>") == "1 < 2"


def test_cascade(spark):
    ld = '<script type="application/ld+json">[{"@type":"X"},{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"O"},"jobLocation":{"address":{"addressRegion":"R"}},"description":"<p>D</p>","datePosted":"2025-01-02T03","industry":"i"}]</script>'
    df = spark.createDataFrame([(1, ld), (2, "<h1>H&amp;I</h1><main>text</main>"), (3, "<title>only</title>"), (4, ""), (5, None), (6, '<script type="application/ld+json">{bad</script>')], "id long, page string")
    r = {x["id"]: x for x in pages.hydrate(df, "id", "page").collect()}
    assert (r[1]["title"], r[1]["company"], r[1]["location"], r[1]["description"], r[1]["posted"], r[1]["status"]) == ("T", "O", "R", "D", dt.date(2025, 1, 2), "complete")
    assert (r[2]["title"], r[2]["description"], r[2]["method"]) == ("H&I", "text", "scraped")
    assert [r[k]["status"] for k in (3, 4, 5, 6)] == ["partial", "failed", "failed", "failed"]


def test_pages_by_id(spark, tmp_path):
    (tmp_path / "a.html").write_text("A")
    (tmp_path / "sample-b.html").write_text("B")
    got = {r["job_id"]: (bytes(r["page"]) if r["page"] else None, r["failure_reason"]) for r in pages.read_pages(spark, str(tmp_path), spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")).collect()}
    assert got == {"a": (b"A", None), "b": (b"B", None), "c": (None, "fixture_not_found")}


def test_tables(spark, tmp_path):
    f = tmp_path / "pairs.csv"
    f.write_text("## note\npair_id,canonical_a_id,canonical_b_id,user_label\np1,1,2, Merge \np2,x,2,new\np3,3,4,maybe\n## end\np4,5,6,new\n")
    assert sorted(map(tuple, tables.read_labelled_pairs(spark, str(f)).collect())) == [("p1", 1, 2, "merge"), ("p4", 5, 6, "new")]
    assert tables.load_settings("/nowhere") == tables.Matching() and tables.load_taxonomy(None) == {}
    (tmp_path / "s.json").write_text('{"borderline": 0.8}')
    assert tables.load_settings(str(tmp_path / "s.json")).borderline == 0.8
    (tmp_path / "t.txt").write_text("Hello {name}")
    assert tables.read_template(str(tmp_path / "t.txt"), name="A") == "Hello A"
    got = tables.resolve_redirects(spark.createDataFrame([("u",), ("v",)], "url string"), spark.createDataFrame([("u", "w")], "url string, resolved string"))
    assert sorted(map(tuple, got.collect())) == [("u", "w"), ("v", "v")]
