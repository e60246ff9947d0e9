"""Tags, pages and structured data on hand-made rows."""

from __future__ import annotations

from firmlens.operators import text as X


def test_tags_sections_and_negation(spark):
    docs = spark.createDataFrame([(1, "Item 4 We use private credit funds. Item 8 We do not use options."), (2, "We do not use options. Never options."), (3, None), (4, "")], "doc_id int, text string")
    got = {(r.doc, r.tag): r for r in X.tag_documents(docs, [("credit", ["private credit funds"]), ("options", ["options"])]).collect()}
    assert set(got) == {(1, "credit"), (1, "options"), (2, "options")}
    assert (got[1, "credit"].confidence, got[1, "credit"].section, got[1, "credit"].negated) == (0.97, 4, 0)
    assert (got[2, "options"].hits, got[2, "options"].negated, got[2, "options"].confidence) == (2, 2, round((0.5 + 0.04) * 0.6, 4))
    assert spark.createDataFrame([("aaaa",)], "t string").select(X.phrase_count(X.F.col("t"), "aa")).first()[0] == 3


def test_page_contacts(spark):
    code = bytes([7, *(b ^ 7 for b in b"cy@x.com")]).hex()
    html = f'<a href="mailto:Ann@x.com">Ann</a> <p>bob [at] x [dot] com</p> <p>dan@x.com</p><i data-cfemail="{code}"></i><img src="a@2x.png"><script>eve@y.com</script> Fax: 212-555-0100 <a href="tel:212-555-0199">call</a> Direct: (212) 555-0123'
    pages = spark.createDataFrame([(1, "https://www.x.com/a", html), (2, "https://z.com", None)], "page_id int, url string, html string")
    got = {r.email: (r.method, r.confidence) for r in X.page_emails(pages).collect()}
    assert got == {"ann@x.com": ("mailto", 85), "bob@x.com": ("obfuscated", 50), "dan@x.com": ("plain", 70), "cy@x.com": ("encoded", 85)}
    assert {r.phone: r.label for r in X.page_phones(pages).collect()} == {"2125550199": "office", "2125550123": "direct"}


def test_jsonld_cards_roles(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Person","name":"Ann Ray","jobTitle":"CFO","email":"mailto:A@x.com"},{"@type":"Thing","name":"t"}]}</script><script type="application/ld+json">not json</script><ul><li class="c"><a href="/1">Ann</a></li><li class="c">Bob</li><li class="c">Cy</li></ul><h3>Portfolio Manager</h3><a>Meet our advisor</a>'
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")
    assert [tuple(r) for r in X.page_jsonld(pages).collect()] == [(1, "Person", "Ann Ray", "CFO", "a@x.com", None)]
    assert {(r.text, r.href) for r in X.page_cards(pages).collect()} == {("Ann", "/1"), ("Bob", None), ("Cy", None)}
    assert [r.title for r in X.page_roles(pages).collect()] == ["Portfolio Manager"]
