"""Operators that SQL doesn't tell, against plain replays, and readers of captured bytes on made files."""

import zlib

from pyspark.sql import functions as F

from tradelens.functions import markup
from tradelens.operators import profiles, requests, review, state
from tradelens.plans import catalogue, entity_queries
from tradelens.sources import captured

FOLDER = "/root/testdata/sf0.01"


def test_inflight_dedupe(spark):
    got = {r.event_id: r.joined for r in catalogue.QUERIES["inflight_dedupe"](spark, FOLDER).collect()}
    until, want = {}, {}
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("ts", "event_id").collect():
        t = r.ts.timestamp()
        want[r.event_id] = t < until.get(r.event_type, 0)
        if not want[r.event_id]:
            until[r.event_type] = t + 600 + r.event_id % 7 * 600
    assert got == want and 0 < sum(want.values()) < len(want)


def test_times_that_are_null_or_equal(spark):
    at = "timestamp '2024-01-01 00:00:0{}'"
    rows = spark.sql(" union all ".join(f"select 'k' as k, {at.format(s) if s is not None else 'cast(null as timestamp)'} as t, {i} as o" for i, s in enumerate([0, 0, 5, None, 9])))
    counts = {r.o: r.n_trailing for r in state.trailing_counts(rows, "k", "t", 5).collect()}
    assert counts == {0: 2, 1: 2, 2: 3, 3: 1, 4: 2}
    assert {r.o: r.accepted for r in state.admit(rows, "k", "t", "o", 1, 5).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True}
    assert {r.o: r.nth for r in state.daily_budget(rows.where("t is not null"), "t", "o", 2).collect()} == {0: 1, 1: 2, 2: 3, 4: 4}
    puts = rows.where("o in (0, 1)").withColumnRenamed("o", "v")
    assert {r.o: r.v for r in state.as_of(rows, puts, "k", "t", 6, ["v"]).collect()} == {0: 1, 1: 1, 2: 1, 3: None, 4: None}
    none = rows.limit(0)
    assert state.trailing_counts(none, "k", "t", 5).count() == state.admit(none, "k", "t", "o", 1, 5).count() == state.daily_budget(none, "t", "o", 2).count() == 0


def test_admit_with_idle_gaps(spark):
    rows = spark.range(400).selectExpr("id % 3 as k", "timestamp_seconds(id * id % 5000) as t", "id as o")
    got = {r.o: r.accepted for r in state.admit(rows, "k", "t", "o", 2, 20).collect()}
    logs, want = {}, {}
    for r in rows.orderBy("t", "o").collect():
        log = logs.setdefault(r.k, [])
        log[:] = [x for x in log if r.t.timestamp() - x <= 20]
        want[r.o] = len(log) < 2
        if want[r.o]:
            log.append(r.t.timestamp())
    assert got == want


def _pdf(contents: list[bytes], cmaps: dict[str, bytes] | None = None, packed: bool = True) -> bytes:
    """A file of a page a content, whose fonts have these maps; its page objects lie in an object stream."""
    import zlib

    out, n = [b"%PDF-1.5"], 10
    squeeze = lambda x: zlib.compress(x) if packed else x
    how = b"/Filter /FlateDecode" if packed else b""

    def stream(number, data, head=b""):
        raw = squeeze(data)
        out.append(b"%d 0 obj << %s %s /Length %d >> stream\n%s\nendstream endobj" % (number, how, head, len(raw), raw))

    fonts = b""
    for name, cmap in (cmaps or {}).items():
        stream(n, cmap)
        out.append(b"%d 0 obj << /Type /Font /ToUnicode %d 0 R >> endobj" % (n + 1, n))
        fonts += b"/%s %d 0 R " % (name.encode(), n + 1)
        n += 2
    kids, packs = [], []
    for c in contents:
        stream(n, c)
        packs.append((n + 1, b"<< /Type /Page /Contents %d 0 R >>" % n))
        kids.append(b"%d 0 R" % (n + 1))
        n += 2
    packs.append((2, b"<< /Type /Pages /Kids [%s] /Resources << /Font << %s >> >> >>" % (b" ".join(kids), fonts)))
    body, marks = b"", b""
    for number, data in packs:
        marks += b"%d %d " % (number, len(body))
        body += data + b" "
    stream(3, marks + body, b"/Type /ObjStm /N %d /First %d" % (len(packs), len(marks)))
    out.append(b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj")
    return b"\n".join(out)


def test_pdf_text():
    from tradelens.sources import pdf

    read = pdf.pdf_text
    assert read(_pdf([b"BT /F1 12 Tf 50 700 Td (Company \\(one\\) (two (three)) \\101) Tj 0 -20 Td [(EIK ) -250 (123)] TJ ET", b"BT (page two) Tj ET"])) == ("Company (one) (two (three)) A\nEIK  123\npage two", None)
    assert read(_pdf([b"BT (pla\\\nin) Tj ET"], packed=False)) == ("plain", None)
    one = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0428> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<0416> <0078 0079>] endbfrange endcmap"
    two = b"begincmap 1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <005A> endbfchar endcmap"
    text = b"BT /F1 9 Tf <00010002000300040006> Tj /F2 9 Tf <01> Tj /F1 9 Tf <0005> Tj ET"
    assert read(_pdf([text], {"F1": one, "F2": two})) == ("\u0428abcxyZ\u0416", None)
    assert read(b"no pdf") == (None, "not_pdf") and read(b"%PDF-1.4 junk") == ("", None)
    assert read(b"%PDF-1.4 trailer << /Encrypt 5 0 R >>") == (None, "encrypted")
    assert read(_pdf([b"BT (x) Tj ET BI /W 1 ID (((( EI BT (y) Tj ET"])) == ("x\ny", None)


def test_pdf_bound(monkeypatch):
    from tradelens.sources import pdf

    monkeypatch.setattr(pdf, "MOST_INFLATED", 3000)
    assert pdf.pdf_text(_pdf([b"BT (first) Tj ET", b"BT (" + b"x" * 9000 + b") Tj ET"])) == ("first", "inflates_too_far")
    monkeypatch.setattr(pdf, "MOST_BYTES", 10)
    assert pdf.pdf_text(_pdf([b""])) == (None, "too_large")


def test_bodies(spark):
    bodies = [("Шоп".encode("cp1251"), None), ("Шоп".encode(), "text/html"), ("é".encode("latin-1"), "text/html; charset=latin-1"), (None, None), (b"<meta charset='cp1251'>" + "Ж".encode("cp1251"), ""), (b"x", "text/html; charset=no-such")]
    rows = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(bodies)], "i int, body binary, content_type string")
    got = captured.with_text(rows).orderBy("i").collect()
    assert [r.text for r in got] == ["Шоп", "Шоп", "é", None, "<meta charset='cp1251'>Ж", "x"]
    assert [r.text_error for r in got] == [None, None, None, "no_body", None, None]


def test_sources_that_were_not_captured(spark, tmp_path):
    from tradelens.sources import tables

    df, state_ = tables.source(spark, FOLDER, "no_such_table", "a int")
    assert state_ == "unconfigured" and df.collect() == [] and tables.source(spark, FOLDER, "region", "a int")[1] == "captured"
    assert [n for n, _ in tables.configured(spark, FOLDER, ["nothing", "nation", "region"], "a int")] == ["nation", "region"]
    (tmp_path / "rules").write_text("// rules\ncom\n*.ck\n!www.ck trailing\n\nco.uk\n")
    assert {tuple(r) for r in tables.suffix_rules(spark, str(tmp_path / "rules")).collect()} == {("com", "rule"), ("ck", "wildcard"), ("www.ck", "exception"), ("co.uk", "rule")}


def test_json_answers_and_sitemaps(spark):
    rows = spark.createDataFrame([(1, 200, '{"r": [{"a": 1}]}'), (2, 200, '{"r": []}'), (3, 200, "oops"), (4, 503, '{"r": [{"a": 1}]}'), (5, None, None)], "i int, status int, body string")
    assert [r.state for r in captured.json_answers(rows, "struct<a:int>", "$.r").orderBy("i").collect()] == ["found", "not_found", "unavailable", "unavailable", "unavailable"]
    xml = spark.createDataFrame([("<loc>https://a/x</loc><loc> https://a/Terms </loc><loc>https://a/x</loc>",)], "x string")
    assert xml.select(captured.sitemap(F.col("x")).alias("a"), captured.sitemap(F.col("x"), ("terms",), 5).alias("b")).first() == (["https://a/x", "https://a/Terms"], ["https://a/Terms"])


def test_triage_verdicts(spark):
    from tradelens.operators import verbs

    page = "<p>ЕИК: 131371780</p><p>Адрес: гр. София, ул. Дълга 5</p><p>office@a.bg +359 2 9000001</p>"
    fetches = [("https://a.bg/", "https://a.bg/", 1, 200, page), ("https://a.bg/", "https://a.bg/t", 2, 200, "<p>фирма: Алфа ООД</p>"), ("https://b.bg/", "https://b.bg/", 1, 403, None), ("https://c.bg/", "https://c.bg/", 1, 500, None), ("https://d.bg/", "https://d.ro/", 1, 200, page), ("https://e.bg/", "https://e.bg/", 1, 200, "<script id='__NEXT_DATA__'></script>")]
    got = {r.domain: r for r in verbs.triage(spark.createDataFrame(fetches, "url string, final_url string, seq int, status int, html string")).collect()}
    assert {d: r.verdict for d, r in got.items()} == {"a.bg": "ok", "b.bg": "blocked", "c.bg": "unreachable", "d.bg": "out_of_scope", "e.bg": "undetermined"}
    assert got["a.bg"].company == "Алфа ООД" and got["a.bg"].pages == 2 and got["b.bg"].score is None


def test_pages_without_anything(spark):
    rows = spark.createDataFrame([(None,), ("",), ("<p>",), ("<div>EIK</div>",)], "html string")
    for r in rows.select(markup.six_fields(F.col("html")).alias("f"), markup.structured(F.col("html")).alias("s"), markup.mentions(F.col("html")).alias("m")).collect():
        assert all(v is None for v in r.f) and not r.s and not r.m


def test_json_files(spark, tmp_path):
    review.write_json(spark.range(3).selectExpr("id", "array(id) as list"), str(tmp_path / "out"))
    assert spark.read.schema("id long, list array<long>").json(str(tmp_path / "out")).count() == 3
    (tmp_path / "one.json").write_text('{"a":\n 1}')
    assert captured.json_file(spark, str(tmp_path / "one.json"), "a int").collect()[0].a == 1


def test_people_and_requests_of_no_rows(spark):
    none = spark.createDataFrame([], "request long, seq long, action string, field string")
    assert requests.request_state(none).count() == 0


def test_field_profile_fuzzy(spark):
    rows = spark.sql(entity_queries.WORDINGS, customer=spark.read.parquet(f"{FOLDER}/customer.parquet")).orderBy("seq").collect()
    leaders, want = {}, {}
    for r in rows:
        mine = leaders.setdefault(r.domain, [])
        lead = next((x for x in mine if profiles.words_agree(x, r.value) or x == r.value), None)
        if lead is None:
            mine.append(lead := r.value)
        want[r.domain, lead] = want.get((r.domain, lead), 0) + 1
    got = {(r.domain, r.leader): r.n for r in catalogue.QUERIES["field_profile_fuzzy"](spark, FOLDER).collect()}
    assert got == want and len(got) > 25


def test_every_query_has_rows(spark):
    # Every customer of these tables has orders.
    assert [n for n, f in catalogue.QUERIES.items() if f(spark, FOLDER).isEmpty()] == ["orphan_entities"]


def test_orphans(spark):
    entities, links = spark.sql("select explode(array(1, 2, null)) as eik"), spark.sql("select explode(array(2, null)) as eik")
    assert {r.eik for r in state.orphans(entities, links).collect()} == {1, None}
