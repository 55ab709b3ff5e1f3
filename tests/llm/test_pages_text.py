"""Problems 3, 6 and 10."""

import numpy as np
from hypothesis import given, settings, strategies as st

from vacancia.llm import boilerplate as bp, pii, residue as rs


def best_total(scores, price):
    """By trying every labelling."""
    n, best = len(scores), None
    for bits in range(1 << n):
        lab = [bits >> k & 1 for k in range(n)]
        total = sum(s for s, v in zip(scores, lab, strict=True) if v) - price * sum(a != b for a, b in zip(lab, lab[1:], strict=False))
        best = total if best is None else max(best, total)
    return best


@given(st.lists(st.integers(-5, 5), max_size=9), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_regions_have_the_best_total(scores, price):
    lab = bp.regions(np.array(scores, float), price).tolist()
    total = sum(s for s, v in zip(scores, lab, strict=True) if v) - price * sum(a != b for a, b in zip(lab, lab[1:], strict=False))
    assert abs(total - (best_total(scores, price) if scores else 0)) < 1e-9


PAGE = "<html><head>\n<title>t</title>\n<script>var x;\nmenu</script></head>\n<body>\n<!-- a\nb -->\n<nav class=\"nav\">\n<li><a href=\"/\">Sign in</a></li>\n</nav>\n<main class=\"q\">\n<p>You will build&nbsp;pipelines.</p>\n\n</main>\n<footer>\n<span>Imprint</span>\n</footer></body>"


def test_page_lines():
    got = [(no, text, bp.told(names)) for no, text, _, names, _ in bp.page_lines(PAGE)]
    assert got == [(9, "Sign in", 0), (12, "You will build pipelines.", 1), (16, "Imprint", 0)]


def test_boilerplate(spark):
    plain = PAGE.replace('<nav class="nav">', '<div class="zz">').replace("</nav>", "</div>").replace('<main class="q">', '<div class="yy">').replace("</main>", "</div>").replace("<footer>", '<div class="xx">').replace("</footer>", "</div>")
    src = spark.createDataFrame([(k, PAGE, "a") for k in range(12)] + [(50, plain, "a"), (51, None, "a"), (52, "", "a"), (None, PAGE, "a")], "id long, raw_html string, key string")
    hyd = spark.createDataFrame([("j", "Sign in\r\n\nYou will build pipelines.\nImprint"), ("j", "Sign in\r\n\nYou will build pipelines.\nImprint"), ("k", None), ("m", ""), (None, "Imprint")], "job_id string, description string")
    got = {tuple(r) for r in bp.boilerplate_lines(src, hyd).collect()}
    assert got == {("raw_html", str(k), n) for k in [*range(12), 50] for n in (9, 16)} | {("description", "j", 1), ("description", "j", 4)}
    assert bp.boilerplate_lines(src.limit(0), hyd.limit(0)).count() == 0
    scorer = bp.learn(src.selectExpr("cast(id as string) key", "raw_html page"))
    assert {r["text"] for r in bp.main_text(src.where("id = 50"), scorer, "id", "raw_html").collect()} == {"You will build pipelines."}


def test_one_block_around_all_is_parted(spark):
    """A page whose menu, posting and footer stand in one block is decided by its words, not as a whole."""
    src = spark.createDataFrame([(k, PAGE) for k in range(30)], "id long, raw_html string")
    scorer = bp.learn(src.selectExpr("cast(id as string) key", "raw_html page"))
    words = ["Sign in", "Imprint", "Sign in", "Imprint"] * 3
    page = '<div class="all">\n' + "\n".join([f"<span>{w}</span>" for w in words] + ["<p>You will build pipelines.</p>"] * 8 + [f"<span>{w}</span>" for w in words]) + "\n</div>"
    got = bp.page_boilerplate(spark.createDataFrame([("1", page)], "key string, page string"), scorer).first()["lines"]
    assert got == [*range(2, 14), *range(22, 34)]


def test_residue(spark):
    good = "You will lead and build reports together with planners. We trace 404 responses in our services and check sign-in flows of the portal. " * 5
    rows = [(f"g{k}", good + str(k), "t", "complete", f"https://{'a' if k % 2 else 'b'}.example/{k}") for k in range(60)]
    for k, text in enumerate(["HTTP 404 Page not found\nRequest ID: 1f", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet consectetur", good + "\nReports to {{ team }}.", "Access denied\nnginx", "TODO: write description"] * 6):
        rows.append((f"b{k}", text, "t", "failed", f"https://{'a' if k // 6 % 2 else 'b'}.example/b{k}"))
    rows += [("n", None, "t", None, None), ("e", "", None, "complete", None), ("g0", good + "0", "t", "complete", "x"), (None, "Access denied", "t", "failed", "u")]
    df = spark.createDataFrame(rows, "job_id string, description string, title string, hydration_status string, url string")
    unseen = rs.residue(df.where("url like '%b.example%'"), rs.fit(df, host="b.example"))
    assert {r[0] for r in unseen.collect()} == {r[0] for r in rows if r[0] and r[0][0] == "b" and "b.example" in (r[4] or "")}
    found = [r[0] for r in rs.residue(df, rs.fit(df)).collect()]
    assert sorted(found) == sorted(f"b{k}" for k in range(36))
    assert rs.residue(df.limit(0), rs.fit(df.limit(0))).count() == 0


def spans(text):
    return [(k, text[a:b]) for k, a, b in pii.find(text)]


def test_passages():
    assert spans("Write to hazel [dot] palvoldor at derkungroup [dot] example, or careers@x.example.") == [("email", "hazel [dot] palvoldor at derkungroup [dot] example"), ("email", "careers@x.example")]
    assert spans("Call 001 306 555-0198 x611 or +44 (0)7700 900 821.") == [("phone", "001 306 555-0198 x611"), ("phone", "+44 (0)7700 900 821")]
    assert spans("(SIN 097 068 809) passport no: QQ 1145235.") == [("id_number", "097 068 809"), ("id_number", "QQ 1145235")]
    assert spans("Post papers to 194 Heron Lane, #35 (Dunwick); Büro: Lindenallee 49a, X") == [("address", "194 Heron Lane, #35"), ("address", "Lindenallee 49a")]
    assert spans("Interview with Rurgar-Nulrur, Farah next week. Gruß, Annika Lilgefir") == [("name", "Rurgar-Nulrur, Farah"), ("name", "Annika Lilgefir")]
    assert spans("Ask for D. Balrar at the desk.") == [("name", "D. Balrar")]


def test_no_passages():
    for t in ("Follow @northdesk for updates", "score@k and recall@70", "Invoice 4500 7520 3901", "Order no. 776794069 arrived", "24 Hour Road maps are reviewed weekly", "Phase 1-800 units, phase 2-1200 units", "ISO 9001:2015", "People who do well here are at ease with stakeholders.", "Updated 2025-04-16 10:40", "", None):
        assert pii.find(t) == []


def test_offsets_go_back_to_the_source():
    t = "cc: Solène Kinlil ​+1 306 555‑0198 – Jürgen Lobol"
    assert [t[a:b] for _, a, b in pii.find(t)] == ["Solène Kinlil", "+1 306 555‑0198", "Jürgen Lobol"]
    assert spans("Call five five five oh one two three four now")[0:1] in ([], [("phone", "five five five oh one two three four")])


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_redaction_keeps_the_rest(t):
    rest, last = [], 0
    for _, a, b in pii.find(t):
        assert last <= a < b <= len(t)
        rest.append(t[last:a])
        last = b
    out = pii.redact_text(t)
    assert all(x in out for x in rest)


def test_redacted_table(spark):
    df = spark.createDataFrame([(1, "x a@b.example y", "k"), (2, None, "k"), (3, "", "k"), (1, "x a@b.example y", "k")], "doc_id long, text string, kind string")
    assert sorted(map(tuple, pii.passages(df).collect())) == [(1, "email", "a@b.example")]
    assert sorted(map(tuple, pii.redacted(df.dropDuplicates(["doc_id"])).collect())) == [(1, "x [EMAIL] y"), (2, None), (3, "")]
    assert pii.passages(df.limit(0)).count() == 0


def test_given_names_outside_the_list(spark):
    assert spans("We spoke with Frau Sabine Kruger today.") == [("name", "Sabine Kruger")]
    assert spans("Mail kevin.miller@x.example so that Kevin Miller knows.") == [("email", "kevin.miller@x.example"), ("name", "Kevin Miller")]
    rows = [(1, "Interview with Stefan Holm next week."), (2, "Ms Jennifer Stone and Mr Stefan Brandt came."), (3, "Yesterday Stefan Wagner called."), (4, "Ask for Project Alpha. Ask for Project Beta. The project Project Gamma ended.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.learn(df) == ("Stefan",)
    assert (3, "name", "Stefan Wagner") in set(map(tuple, pii.passages(df).collect()))
    assert "Yesterday [NAME] called." in {r["text"] for r in pii.redacted(df).collect()}


def test_long_local_parts_are_whole():
    for n in (100, 119, 121, 130, 500, 3000):
        local = "a" * n
        assert spans(f"Mail {local}@example.com or {'b.' * (n // 2)}c@example.com now.") == [("email", f"{local}@example.com"), ("email", f"{'b.' * (n // 2)}c@example.com")]
