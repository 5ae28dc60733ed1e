"""Markup functions against plain scanners, over nested, unclosed and broken markup."""

import random
import re

from pyspark.sql import functions as F

from lexmill.functions import markup
from lexmill.sources import portal

PARTS = ["<div>", "</div>", "<DIV class='x'>", "<p>", "</p>", "<br/>", "<div/>", "<!-- a <div> > b -->", "<script>if (a<b) '<div>'</script>", "<script>", "</script >", "<style>x</style>", "<head>", "</head>",
         "words here ", "a < b > c ", "&amp;&lt;", "\n\n", "  ", "é", "<divider>", "</ div>", "<section\n>", "12. ", "[7] ", "<unclosed "]


def pages(n=400):
    r = random.Random(6)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 30))) for _ in range(n)] + ["", "<", ">", "<div", "<head>x", None]


def plain_text(html):
    out, i, skip = [], 0, None
    while i < len(html):
        if html[i] != "<":
            if skip is None:
                out.append(html[i])
            i += 1
            continue
        end = html.find(">", i)
        if end < 0:
            break
        tag = html[i + 1 : end].strip()
        name = re.split(r"[\s/]", tag.lstrip("/"), maxsplit=1)[0].lower()
        if skip is not None:
            skip = None if tag.startswith("/") and name == skip else skip
        elif not tag.startswith("/") and name in markup.SKIPPED:
            skip = name
        elif name in markup.BLOCKS:
            out.append("\n\n")
        i = end + 1
    return "".join(out)


def plain_stretches(html, name):
    out, depth, start, deepest, last, first = [], 0, 0, 0, None, None
    for m in re.finditer(rf"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?){name}(?![\w-])[^>]*>", html):
        if m[2] is None or m[0].endswith("/>") and not m[2]:
            continue
        if m[2]:
            last = m.end()
            if depth:
                depth -= 1
                if not depth:
                    out.append((start, m.end(), deepest, True))
        else:
            first = m.start() if first is None else first
            start, deepest = (m.start(), 0) if not depth else (start, deepest)
            depth += 1
            deepest = max(deepest, depth)
    return out + [(start, len(html), deepest, False)] * (depth > 0), first, last


def test_text_of_broken_markup(spark):
    rows = spark.createDataFrame([(h,) for h in pages()], "h string").select("h", markup.strip_markup(F.col("h")).alias("t")).collect()
    assert all(r.t is None if r.h is None else r.t == plain_text(r.h) for r in rows)


def test_stretches_of_nested_and_unclosed_elements(spark):
    for name in ("div", "p"):
        rows = spark.createDataFrame([(h,) for h in pages()], "h string").select("h", markup.element_scan(F.col("h"), name).alias("s")).collect()
        deep = 0
        for r in rows:
            if r.h is None:
                assert r.s is None
                continue
            found, _, last = plain_stretches(r.h, name)
            assert [tuple(x) for x in r.s.stretches] == found and r.s.last_close == last
            assert r.s.first_open == (found[0][0] if found else None)
            deep = max([deep, *(x[2] for x in found)])
        assert deep >= (3 if name == "div" else 2)


def test_bodies_and_plans(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    legal = f"<la-akoma-ntoso><akn-p>{words(20)}</akn-p><la-akoma-ntoso>{words(25)}</la-akoma-ntoso><i>x</i></la-akoma-ntoso>"
    box = lambda n, end: f'<div>a</div><div class="content content__html"><div>{words(n)}</div></div>{end} after <a href="/x/source.pdf">f</a>'
    cases = [
        (f"<p>{legal}</p>", "html", legal, None),
        (f"<la-akoma-ntoso>few</la-akoma-ntoso>{box(50, '<la-gutter>')}", "html", box(50, "").split("<div>a</div>")[1].split(" after")[0], None),
        (box(50, "</article>"), "html", box(50, "").split("<div>a</div>")[1].split(" after")[0], None),
        (box(30, "<la-gutter>"), "pdf", None, "https://h.org/x/source.pdf"),
        (legal + '<b data-display-type="pdf">' + '<a HREF = "source.pdf">', "none", None, None),
        (legal + "content__pdf" + '<a href="sub/source.pdf">', "pdf", None, "https://h.org/a/sub/source.pdf"),
        ("nothing", "none", None, None),
        (None, None, None, None),
    ]
    rows = spark.createDataFrame([(i, c[0], "https://h.org/a/b") for i, c in enumerate(cases)], "i int, html string, url string")
    got = {r.i: r.p for r in rows.select("i", markup.body_plan(F.col("html"), F.col("url")).alias("p")).collect()}
    for i, (_, plan, body, address) in enumerate(cases):
        assert (got[i] is None) if plan is None else (tuple(got[i]) == (plan, body, address)), i
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(markup.legal_blocks(F.lit("<akn-p x='1'>a<akn-ref>b</akn-ref></AKN-P><akn-pre>"))) == "<div>a<akn-ref>b</akn-ref></div><akn-pre>"
    assert one(markup.merged(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("c")))) == ["a", "a", "b", "c"]
    assert one(markup.merged(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))) == []


def test_portal_pages(spark):
    body = "<la-akoma-ntoso><akn-p>1. " + "word " * 40 + "</akn-p><akn-p>see <akn-ref>[1995] ZACC 3</akn-ref> again</akn-p></la-akoma-ntoso>"
    title = '<meta property="og:title" content="A (Pty) Ltd v B (CCT 12/20) [2020] ZACC 7; 2020 (3) SA 1 (CC) (17 July 2020) (Judgment)">'
    rows = [(1, f'<html data-work-frbr-uri="/akn/za/judgment/zacc/2020/7">{title}{body}', "https://h.org/x"), (2, f"<h1>X v Y (Appeal 5)</h1>{body}", "https://h.org/akn/ke/judgment/kehc/2021/9/eng"), (3, body, "https://h.org/x"), (4, None, "https://h.org/x")]
    found = portal.with_citations(portal.portal_pages(spark.createDataFrame(rows, "id int, html string, url string")))
    got = {r.id: r for r in found.collect()}
    assert (got[1].plan, got[1].court, got[1].title, got[1].date, got[1].decision_type) == ("html", "ZACC", "A (Pty) Ltd v B", "2020-07-17", "Judgment")
    assert (got[1].neutral_citation, got[1].reported, got[1].case_numbers) == ("[2020] ZACC 7", ["2020 (3) SA 1 (CC)"], ["CCT 12/20"])
    assert [(p.number, p.text.split()[0]) for p in got[1].paragraphs] == [("1", "word"), (None, "see")]
    assert (got[2].neutral_citation, got[2].title, got[2].case_numbers) == ("[2021] KEHC 9", "X v Y", [])
    assert got[3].plan == "no path" and got[4].plan is None
    held = spark.createDataFrame([(1, "?", "old", None, None, ["r"], ["CCT 12/20", "n"])], "id int, court string, title string, date string, neutral_citation string, reported array<string>, case_numbers array<string>")
    laid = portal.overlaid(held, found).first()
    assert (laid.court, laid.title, laid.date, laid.reported, laid.case_numbers) == ("ZACC", "A (Pty) Ltd v B", "2020-07-17", ["r", "2020 (3) SA 1 (CC)"], ["CCT 12/20", "n"])
