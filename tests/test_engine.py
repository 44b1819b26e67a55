"""Text functions, checks, rules, resolution, rewriting, restoring and scoring."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmask.functions import checks
from quillmask.functions import text as T
from quillmask.functions.ordinal import with_ordinal
from quillmask.operators import detect, resolve, restore, rewrite, rules, scan, score
from quillmask.plans.redact import redact
from quillmask.sources import readers


def values(spark, f, rows):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(got)]


def test_tables_are_complete():
    assert (len(rules.DIRECT), len(rules.LABELS), len(rules.HAN), len(rules.HAN_LABELS)) == (147, 62, 19, 20)


def test_text_functions(spark):
    assert values(spark, T.clean_value, [" (a  b), ", "&amp;x", "", None, "　q　"]) == ["a b", "&x", "", None, "q"]
    assert values(spark, T.dedupe_norm, ["Dr. Ann Lee’s", "ANN  lee"]) == ["ann lee", "ann lee"]
    assert values(spark, T.visible_line, ["**Ann** <b>Lee</b>\\ ", "`x_y`"]) == ["Ann Lee", "xy"]
    assert values(spark, T.recipient_name, ["Ann Lee (Acme LLP) <a@x.example>", "a@x.example"]) == ["Ann Lee", ""]
    assert values(spark, T.recipient_shape, ["Ann Lee", "Lee, Ann", "some words"]) == [True, True, False]
    assert values(spark, T.strip_anchors, ["[Intro [1](#_Toc1)](#_Toc1) [x](#_Toc2)"]) == ["Intro 1 x"]


def test_checksums(spark):
    assert values(spark, checks.is_valid_iban, ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", None]) == [True, False, False]
    assert values(spark, checks.is_valid_isin, ["US0378331005", "US0378331006", "x", None]) == [True, False, False, False]
    assert values(spark, checks.is_valid_prc_id, ["11010519491231002X", "110105194912310021", "11010519490231002X", None]) == [True, False, False, False]
    assert values(spark, checks.is_valid_uscc, ["91350100M000100Y43", "91350100M000100Y44", None]) == [True, False, False]


# A positive and a negative text for rules of each family.
CASES = [
    ("EMAIL", "write a.b@x.example now", "a.b@x.example", "write a.b at x"), ("PHONE", "call 415-555-0134 now", "415-555-0134", "code 12-34"), ("NATIONAL_ID", "no 123-45-6789", "123-45-6789", "no 123-456-789"),
    ("DATE", "on 12 March 2024", "12 March 2024", "on March"), ("AMOUNT", "paid US$ 1,200.50", "US$ 1,200.50", "paid much"), ("CASE_REF", "Case No. 12-cv-3", "Case No. 12-cv-3", "Case closed"),
    ("BUSINESS_ID", "Invoice No: AB-77", "Invoice No: AB-77", "Invoice No: pending"), ("BANK_ACCOUNT", "card ending in 1234", "1234", "card ending soon"), ("POSTCODE", "at SW1A 2AA", "SW1A 2AA", "at SWAA"),
    ("EXHIBIT_REF", "see C-12", "C-12", "see X-12"), ("URL", "at https://a.example/x)", "https://a.example/x", "at a.example"), ("ADDRESS", "at 12 Baker Street", "12 Baker Street", "at Baker Street"),
    ("DATE", "于2020年3月5日签署", "2020年3月5日", "三月"), ("CASE_REF", "案号：（2021）京01民终123号", "（2021）京01民终123号", "案号：无"), ("PHONE", "电话：13800138000", "13800138000", "电话：无"),
    ("ORG", "signed by Acme Trading Limited today", "Acme Trading Limited", "acme trading limited"), ("PERSON", "Dear Sir, Dr. Ann Lee came", "Dr. Ann Lee", "the doctor came"), ("PERSON_OR_ORG", "Client: Blue Sky", "Blue Sky", "the client is blue"),
]


@pytest.mark.parametrize(("kind", "text", "value", "other"), CASES)
def test_rules(kind, text, value, other):
    found = {(f[0], scan.clean(f[3]) if kind != "CASE_REF" else f[3]) for _, f in scan.all_found(text)}
    assert (kind, value) in found
    assert not any(f[0] == kind for _, f in scan.all_found(other))


def test_native_and_arrow_rules_agree(spark):
    texts = [c[1] for c in CASES] + [c[3] for c in CASES] + [None, ""]
    docs = detect.sample_pack(spark, texts)
    some = [r for r in rules.DIRECT if r.kind in ("EMAIL", "EXHIBIT_REF", "BUNDLE_REF", "URL", "NATIONAL_ID")]
    native = {(r.doc_ord, r.kind, r.reason, r.value, r.pos) for r in detect.detect_rules(docs, some).collect()}
    arrow = {(r.doc_ord, r.kind, r.reason, r.value, r.pos) for r in scan.detect(docs).filter("detector = 0").collect()}
    assert native == {r for r in arrow if r[1] in ("EMAIL", "EXHIBIT_REF", "BUNDLE_REF", "URL", "NATIONAL_ID")} and native


def test_redaction_and_restore(spark):
    texts = ["Contact: Mara Quill, mara.quill@example.org (415) 555-0134\nSSN 123-45-6789", "Dr. John Smith wrote. Dear Smith, mail mara.quill@example.org.", None, ""]
    docs = detect.sample_pack(spark, texts)
    review = redact(docs)
    out = {r.doc_ord: r for r in review.documents.collect()}
    assert "example.org" not in out[0].sanitized + out[1].sanitized and "123-45" not in out[0].sanitized and "Smith" not in out[1].sanitized
    assert out[2].sanitized == out[3].sanitized == ""
    assert {r.doc_id: r.text for r in score.reconstruct(review.documents).collect()} == {f"d{i}": t or "" for i, t in enumerate(texts)}
    key = restore.restore_key(review.counted())
    mail = key.filter("kind = 'EMAIL'").collect()
    assert len(mail) == 1 and mail[0]["count"] == 2 and mail[0].safe and not mail[0].ambiguous
    drafts = review.documents.select("pack_id", F.col("doc_id").alias("draft_id"), F.col("sanitized").alias("text"))
    restored = {r.draft_id: r for r in restore.restore_text(drafts, key).collect()}
    assert "mara.quill@example.org" in restored["d0"].restored and "123-45-6789" in restored["d0"].restored
    for r in restored.values():
        assert all(r.restored[o.start : o.end] == o.value for o in r.occurrences)
    assert "# Sanitized Document Pack" in review.markdown().first().markdown
    again = redact(docs.repartition(3)).documents.collect()
    assert {r.doc_ord: r.sanitized for r in again} == {i: r.sanitized for i, r in out.items()}


def test_levels_are_monotone(spark):
    docs = detect.sample_pack(spark, ["On 12 March 2024 Blue Sky met. Blue Sky ate. Blue Sky slept. a@b.example"])
    used = [{r.id for r in redact(docs, level).counted().filter("match_count > 0").collect()} for level in (1, 2, 3)]
    assert used[0] < used[1] < used[2]


def test_user_edits(spark):
    schema = "pack_id string, id string, value string, replacement string, kind string, level int, reason string, sources array<string>, manual boolean, match_case boolean, pos int"
    row = lambda i, v, r, m=False: ("p", i, v, r, "EMAIL", 1, "x", ["s"], m, False, 0)
    base = spark.createDataFrame([row("a", "A@x", "EMAIL_001"), row("b", "B@x", "EMAIL_002"), row("c", "C@x", "EMAIL_003")], schema)
    user = spark.createDataFrame([row("a", "A@x", "NEW"), row("m", "b@X", "CUSTOM_001", True), row("z", "zz", "Z", True)], schema)
    out = resolve.merge_entries(base, user, spark.createDataFrame([("p", "c"), ("p", "z")], "pack_id string, id string"))
    assert {(r.id, r.replacement) for r in out.collect()} == {("a", "NEW"), ("m", "CUSTOM_001")}


def test_spans_do_not_overlap():
    text = "Ann Lee met Ann. ANN LEE"
    spans, counts = rewrite.choose_spans(text, [("Ann", False, False, "PERSON"), ("Ann Lee", False, False, "PERSON"), ("Lee", True, True, "CUSTOM")])
    assert counts == [3, 2, 1]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert (4, 7, 2) in spans and (17, 24, 1) in spans
    assert not rewrite.matcher("Ann", False).search("Annex")


def test_tokens_keep_their_digits(spark):
    got = spark.range(998, 1002).select(resolve.token(F.lit("X"), F.col("id")).alias("t")).collect()
    assert [r.t for r in got] == ["X_998", "X_999", "X_1000", "X_1001"]


def test_scores(spark):
    gold = spark.createDataFrame([("d", "1", "redact", "A", "high", 0, 10), ("d", "2", "redact", "B", "low", 20, 30), ("d", "3", "keep", "A", "none", 40, 45), ("e", "4", "redact", "A", "low", 0, 5)], "doc_id string, id string, action string, label string, severity string, start long, `end` long")
    spans = spark.createDataFrame([("d", 0, 5), ("d", 3, 9), ("d", 24, 26), ("d", 41, 42), ("d", 60, 70)], "doc_id string, start long, `end` long")
    got = {r.doc_id: r.asDict() for r in score.score_document(gold, spans).collect()}
    d = got["d"]
    assert (d["spans"], d["covered"], d["partial"], d["missed"], d["covered_chars"], d["keep_violations"], d["unsupported"]) == (2, 1, 1, 0, 11, 1, 1)
    assert got["e"]["missed"] == 1
    total = score.summarize(score.score_document(gold, spans)).first()
    assert total.span_recall == pytest.approx(1 / 3) and total.keep_clean == 0
    pairs = score.consensus(gold.filter("doc_id = 'd'"), spans.select("doc_id", F.col("start").cast("string").alias("id"), F.lit("redact").alias("action"), F.lit("A").alias("label"), "start", "end"))
    assert [(r.a_id, r.b_id) for r in pairs.collect()] == [("1", "3")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "b.log").write_text("no")
    assert [r.text for r in readers.read_text_files(spark, str(tmp_path)).collect()] == ["# A\nx"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p></w:body></w:document>')
    assert readers.docx_text(data.getvalue()) == "# Head\n\nText"
    items = [("d", 1, 0, "Hello", 10.0, 700.0, 30.0, 12.0), ("d", 1, 1, "world", 45.0, 700.0, 30.0, 12.0), ("d", 1, 2, "Next", 10.0, 680.0, 25.0, 12.0)]
    rows = spark.createDataFrame(items, "doc_id string, page int, item_ord int, str string, x double, y double, width double, height double")
    assert readers.reconstruct_pdf(rows).first().text == "## Page 1\n\nHello world\nNext"
    assert [r.n for r in with_ordinal(spark.range(50), ["id"], "n").orderBy("id").collect()] == list(range(1, 51))


def test_stream(spark, tmp_path):
    from quillmask.streaming.ingest import redact_stream

    docs = detect.sample_pack(spark, ["mail a@b.example"])
    docs.write.parquet(f"{tmp_path}/in")
    q = redact_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(180)
    assert [r.sanitized for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["mail EMAIL_001"]


def test_contextual_detectors_fire_on_their_letters():
    from quillmask.queries import _LETTERS

    found = {}
    for t in _LETTERS:
        for _, f in scan.all_found(t) if t else ():
            found.setdefault(f[2], set()).add(f[3])
    want = {
        "email recipient display name": {"Ann Lee", "Bo Chen"}, "label continuation value": {"Mara Quill"}, "address continuation": {"Suite 5, Tower Block"}, "patent inventor name": {"Ann Lee", "Bo Chen", "Carl Diaz"},
        "patent inventor/assignee residence": {"Springfield", "Leeds", "Lyon"}, "caption party name": {"MARA QUILL", "CARL DIAZ"}, "caption-block continuation": {"Bo Chen"}, "all-caps table person": {"JOHN SMITH"},
        "contract preamble party": {"Ann Lee"}, "signature block name": {"Ann Lee", "Bo Chen"}, "address-tail ZIP": {"02110"}, "Chinese honorific-suffixed name": {"李女士"}, "Chinese court signature name": {"王建国"},
        "Chinese agreement party heading": {"王小明", "赵强"}, "product-candidate code": {"AB-123"}, "project codename alias": {"Falcon"},
    }
    assert {k: found.get(k) for k in want} == want
    assert "London" in found["common location"]


def test_aliases_and_canonical_names(spark):
    docs = detect.sample_pack(spark, ["Dr. Mara Ida Quill came. Quill said yes. Mara Quill left.", "Dear Quill, sent to Mara today. Lee said no."])
    got = {(r.reason, r.value) for r in resolve.person_aliases(resolve.merge(detect.add_candidates(scan.detect(docs))), docs).collect()}
    assert {("bare surname in witness sentence", "Quill"), ("surname in salutation", "Quill"), ("first and last name alias", "Mara Quill"), ("given alias in communication context", "Mara")} <= got
    assert not any(v == "Lee" for _, v in got)
    rows = [("p", "PERSON", v, 1, i) for i, v in enumerate(("Mara Quill", "Ms Quill", "Quill", "Ann Lee", "Bo Lee", "Lee"))]
    mapped = {r.value: r.canonical for r in resolve.canonical_person(spark.createDataFrame(rows, "pack_id string, kind string, value string, level int, pos int")).collect()}
    assert mapped == {"Mara Quill": "Mara Quill", "Ms Quill": "Mara Quill", "Quill": "Mara Quill", "Ann Lee": "Ann Lee", "Bo Lee": "Bo Lee", "Lee": "Lee"}


@pytest.mark.parametrize("label", ["To", "Cc", "Attention", "Client"])
def test_labels_of_long_lines(label):
    names = [f"Ann{chr(97 + i % 26)} Lee{chr(97 + i // 26)}" for i in range(400)]
    line = f"{label}: {'; '.join(names)}"
    assert len(line) > 2000
    assert [f[3] for f in scan.labels(scan.lines_of(line))] == names


def test_cities_beside_a_dotted_capital_i(spark):
    text = "Offices in \u0130zmir, london and New York."
    found = [(f[3], f[4]) for f in scan.other(text) if f[2] == "common location"]
    assert sorted(found) == [("New York", text.index("New York")), ("london", text.index("london"))]
    sanitized = redact(detect.sample_pack(spark, [text]), level=2).documents.select("sanitized").first()[0]
    assert "london" not in sanitized and "New York" not in sanitized


def test_notes(spark):
    from quillmask.operators import notes
    from quillmask.queries import _NOTES

    parsed = notes.note_parse(spark.createDataFrame(_NOTES, "note_id long, source string"))
    rows = {r.note_id: r for r in parsed.collect()}
    assert [rows[i].problem for i in range(1, 6)] == [None, "front matter", "title", "front matter", None]
    assert rows[1].title == "T: x" and rows[5].datetime == "2024-05-01" and rows[5].blocks == []
    assert [b.type for b in rows[1].blocks] == ["heading", "paragraph", "list", "list", "blockquote", "image", "image", "paragraph"]
    html = {r.note_id: r.html for r in notes.note_render(parsed).collect()}
    assert html.keys() == {1, 5}
    assert html[1] == (
        '<article class="field-note-article"><h2>Head *x* &lt;b&gt;</h2><p>A <code>c&lt;</code> and <mark>m</mark> <strong>s</strong> <em>e</em> &amp; &quot;q&quot; next</p><ul><li>one</li><li><em>two</em></li></ul>'
        '<ol><li>a</li><li>b</li></ol><blockquote>q1<br>q2</blockquote><figure class="field-note-figure"><img src="p.png" alt="al" loading="lazy" /><figcaption>cap</figcaption></figure>'
        '<figure class="field-note-figure"><img src="q.png" alt="" loading="lazy" /></figure><p>- no list</p></article>'
    )


def test_configured_terms(spark):
    docs = detect.sample_pack(spark, ["Acme X met acme xs. acme\nx; London Stock Exchange in london, London.", "FALCON falcons \\E a.b axb", None])
    terms = [("p1", "organization", 1, "Acme X"), ("p1", "location", 1, "London"), ("p1", "matter", 1, "Falcon"), ("p1", "matter", 2, "a.b"), ("p1", "matter", 3, "\\E a"), ("p1", "other", 1, "met"), ("p2", "matter", 1, "met"), ("p1", "matter", 4, "the")]
    got = detect.detect_configured(docs, spark.createDataFrame(terms, "pack_id string, term_type string, ord int, term string")).collect()
    assert sorted((r.doc_ord, r.kind, r.value, r.pos) for r in got) == [
        (0, "LOCATION", "London", 61), (0, "LOCATION", "london", 53), (0, "ORG", "Acme X", 0), (1, "PROJECT_OR_ISSUE", "FALCON", 0), (1, "PROJECT_OR_ISSUE", "\\E a", 15), (1, "PROJECT_OR_ISSUE", "a.b", 18), (1, "PROJECT_OR_ISSUE", "falcon", 7)
    ]
    review = redact(docs, lexicon=spark.createDataFrame(terms, "pack_id string, term_type string, ord int, term string")).documents.collect()
    assert not any("FALCON" in r.sanitized for r in review)


def test_person_vetoes():
    for v in ("Governing Law", "Card Activity Interface", "Company Secretary", "Securities Act", "Bank Details", "Common Stock", "The Administrative Agent", "Drug Administration", "Use Of Proceeds", "ANN Lee", "Ann"):
        assert not scan.looks_like_person(v), v
    for v in ("Ann Lee", "Dr. Mara Quill", "Jordan Price", "Patrick Cash", "Mara Ida Quill's"):
        assert scan.looks_like_person(v), v


def test_candidates_of_one_place_and_value_are_numbered_by_document(spark):
    rows = [(pack, doc, "a@b.example", 7, 1, "EMAIL") for pack in ("s", None) for doc in range(40, 0, -1)]
    found = resolve.sort_candidates(spark.createDataFrame(rows, "pack_id string, doc_ord long, value string, pos int, level int, kind string").repartition(5))
    assert [(r["pack_id"], r["doc_ord"]) for r in found.orderBy("ord").collect()] == [(pack, doc) for pack in ("s", None) for doc in range(1, 41)]


def test_phrases_beside_other_letters():
    text = "ÉAB CD. ÀAB CD. AB CDÉ. AB CD EÉ, AB CD EÉ, AB CD EÉ; AB Cñ"
    assert [(f[3], f[4]) for f in scan.other(text) if f[0] == "PROPER_NOUN"] == [("AB CD", 1)]


def test_entries_meet_the_texts_they_match_and_few_others(spark):
    values = [
        "ann.12@mail3.x.example", "bo@y.example", "+1 (248) 555-6359", "(248) 555-6359", "Jürgen Weiß Ltd", "x@y", "a+b", "张伟", "kiss.me@site.example", "Anna Lee", "é", "o'n+e", "++", "m_n.op-qr+st", "q\"rs tu.vw,xy\" z",
    ]
    texts = [
        "ANN.12@MAIL3.X.EXAMPLE", "joann.12@mail3.x.examples", "bobo@y.example.org +1\n(248)\t555-63590 or (248) 555-6359.", "jürgen  weiß ltda; xx@yy", "aa+bb 见张伟了", "Kiſſ.me@ſİte.example",
        "anna lee, ANNA LEE's", "É O'N+E +++ M_N.OP-QR+STU", "qq\"RS\n\ntu.vw,xy\" \n zz", "other@mail3.x.example +1 (249) 555-6359", "", None,
    ]
    docs = detect.sample_pack(spark, texts, "p").select("pack_id", "doc_ord", F.coalesce("text", F.lit("")).alias("text"))
    rows = [("p", f"E{i}", v, f"T{i}", "CUSTOM", 1, False, False, i) for i, v in enumerate(values)]
    entries = spark.createDataFrame(rows, "pack_id string, id string, value string, replacement string, kind string, level int, manual boolean, match_case boolean, pos int")
    met = {(r.doc_ord, e.value) for r in rewrite.entries_of_documents(docs, entries).collect() for e in r.entries or ()}
    matched = {(i, v) for i, t in enumerate(texts) for v in values if t and rewrite.matcher(v, False).search(t)}
    assert len(matched) > 15 and {v for _, v in matched} == set(values)
    assert matched <= met
    # mail addresses of one host and numbers of one exchange: each text meets its own, not all of the pack
    n = 300
    talk = detect.sample_pack(spark, [f"Write to name{i}.{i}@mail.example.com or call +1 ({100 + i}) 555-{1000 + 7 * i}." for i in range(n)], "p").select("pack_id", "doc_ord", "text")
    rows = [("p", f"{k}{i}", v, f"{k}_{i}", k, 1, False, False, i) for i in range(n) for k, v in (("E", f"name{i}.{i}@mail.example.com"), ("F", f"+1 ({100 + i}) 555-{1000 + 7 * i}"))]
    met = rewrite.entries_of_documents(talk, spark.createDataFrame(rows, entries.schema)).select(F.sum(F.size("entries"))).first()[0]
    assert 2 * n <= met <= 4 * n
