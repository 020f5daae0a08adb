"""Extraction from literal HTML pages."""
from hearth.operators import extract

HTML = ('<html><head><title>T1</title></head><body><div class="ad">Yerevan, Kentron</div>'
        '<h1>Street 5, 12</h1><ul>'
        '<li><a href="Floors">9</a></li><li><a href="Floor Area">85 sq.m.</a></li>'
        '<li><a href="Elevator">Available</a></li><li><a href="Balcony">Open balcony</a></li>'
        '<li><a href="Floors">10</a></li>'
        + "".join(f'<li><a href="k{i}">v{i}</a></li>' for i in range(12))
        + '</ul></body></html>')


def test_page_fields_and_details(spark):
    pages = spark.createDataFrame([(1, "u", HTML)], "page_id long, url string, html string")
    f = extract.page_fields(pages).first()
    assert (f.title, f.heading, f.province) == ("T1", "Street 5, 12", "Yerevan")
    long = extract.page_details_long(pages).collect()
    d = {r.label: r.value for r in long}
    assert d["Floors"] == "10"            # later label wins
    assert d["Floor Area"] == "85"        # unit stripped
    assert len(long) == len(d)            # unique labels
    assert len(d) == 16 and d["k11"] == "v11"   # no marked lists: all details of the page
    wide = extract.page_details_wide(pages, ["Floors", "Nope"], ["floors", "nope"]).first()
    assert wide.floors == "10" and wide.nope is None


def test_append_sources_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "page_id long, province string")
    b = spark.createDataFrame([("y", "$1")], "province string, price string")
    out = extract.append_sources(a, b).collect()
    assert len(out) == 2 and out[1].page_id is None and out[0].price is None


def _list(name, pairs):
    return f'<ul class="{name}">' + "".join(f'<li><a href="{k}">{v}</a></li>' for k, v in pairs) + "</ul>"


def test_two_marked_groups(spark):
    """First 4 of the building's, first 8 of the apartment's; the later label wins."""
    html = (_list("other", [("x", "y")]) + _list("building", [(f"b{i}", i) for i in range(3)] + [("Floors", 9), ("b9", 9)])
            + "\n" + _list("apartment", [("Floors", 10), ("Floor Area", "85 sq.m.")] + [(f"a{i}", i) for i in range(9)]))
    pages = spark.createDataFrame([(1, html), (2, _list("apartment", [("k", "v")])), (3, None), (4, "<p>none</p>"), (5, "")], "page_id long, html string")
    got = {r.page_id: r.details for r in extract.page_details_map(pages).collect()}
    assert got[1] == {**{f"b{i}": str(i) for i in range(3)}, "Floors": "10", "Floor Area": "85", **{f"a{i}": str(i) for i in range(6)}}
    assert got[2] == {"k": "v"} and got[3] == got[4] == got[5] == {}
    order = [r.label for r in extract.page_details_long(pages).where("page_id = 1").collect()]
    assert order == ["b0", "b1", "b2", "Floors", "Floor Area", *[f"a{i}" for i in range(6)]]


def test_absent_fields_are_null_and_the_page_wins(spark):
    html = "<title>T</title><h1>H</h1>" + "".join(f'<li><a href="{k}">{v}</a></li>' for k, v in (("title", "over"), ("new", "n")))
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    f = extract.page_fields(pages).first()
    assert (f.title, f.heading, f.ad_text, f.province) == ("T", "H", None, None)
    assert extract.merged_page_fields(pages).first().fields == {"title": "over", "heading": "H", "new": "n"}


def test_regexes_run_once_per_page(spark):
    pages = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    plan = extract.page_details_long(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 6   # labels and values of three blocks
