"""Places where an operator once did less than the whole job."""

from collections import Counter

from test_dedup import shingles
from agewise.llm import decontaminate, html_extract, jaccard_join


def test_unwanted_elements_end_as_others_do():
    main = html_extract.main_text
    assert main("<ul><li class='share'>x<li>y</ul><p>The article, whole.") == "y The article, whole."
    assert main("<p class='ad'>x<p>The article, whole.<p>More") == "The article, whole. More"
    assert main("<div><span class='ad'>x</div><p>The article, whole.") == "The article, whole."
    assert main("<ul><li class='share'><p>x<li>y</ul><p>The article.") == "y The article."
    assert main("<head><title>t</title><meta charset='utf-8'><body><p>The article.") == "The article."
    assert main("<nav><div>menu</nav><p>The article.") == "The article."
    assert main("<table><tr><td class='ad'>x<td>y<tr><td>z</table><p>The article.") == "y z The article."
    assert main("<div class='ad'><div>x</div>y</div><p>The article.") == "The article."


def test_text_lists_and_tables_beside_the_best_container():
    body = "<div>" + "".join(f"<p>Paragraph {i}, with commas, many, of them, here.</p>" for i in range(9)) + "</div>"
    out = html_extract.main_text(f"<div>Bare <b>text</b> first{body}<h4>Sub</h4><ul><li>one<li>two</ul><table><tr><td>cell</table>"
                                 "<ul><li><a href=x>link</a><li><a href=y>other</a></ul><a href=z>gone</a></div>")
    assert out.startswith("Bare text first Paragraph 0, ") and out.endswith(" here. Sub one two cell")


def test_one_of_each_class_keeps_repeated_rows_once(spark, odd_documents):
    out = Counter(r.doc_id for r in jaccard_join.one_of_each_class(odd_documents).select("doc_id").collect())
    texts = Counter((r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect())
    assert texts[None, odd_documents.where("doc_id is null").first().text] == 2 and out[None] == 1
    assert out[5] == 1 and out[6] <= 2 and all(n == 1 for i, n in out.items() if i != 6)
    rows = [(1, "a b c d e f", s) for s in "zyxzyx"] + [(2, None, "z"), (2, None, "y")]
    got = [(r.doc_id, r.text, r.source) for r in jaccard_join.one_of_each_class(
        spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()]
    assert sorted(got, key=str) == [(1, "a b c d e f", "x"), (2, None, "y")]


def test_jaccard_links_are_counted(spark, monkeypatch):
    """Every pair of rows that links, not only those that connect a component."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:20 + i % 9], f"own{i // 2}", *words[20 + i % 9:50 + i % 4]])) for i in range(40)]
    rows += [(100 + i, rows[3][1].upper()) for i in range(3)] + [(3, rows[3][1]), (200, None), (201, ""), (202, "alone"), (None, "ALONE")]
    sets = [(i, shingles(t or "")) for i, t in rows]
    want = sorted((-1 if i is None else i, sum(100 * len(a & b) >= 80 * len(a | b) for j, (_, b) in enumerate(sets) if j != k and a))
                  for k, (i, a) in enumerate(sets))
    out = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect()
    assert sorted((max(-1, r.id), r.n_links) for r in out) == want and max(n for _, n in want) > 5


def test_excerpts_and_short_items_contaminate(spark):
    words = [f"w{i}" for i in range(500)]
    middle = [*words[:10], *(f"x{i}" for i in range(30)), *words[40:50]]
    docs = [(1, "before " + " ".join(words[100:129]) + " after"), (2, " ".join(["a", *middle, "z"])), (3, "say two words here"),
            (4, " ".join(words[200:212])), (5, "two of the words"), (6, " ".join(words[:249]))]
    items = [(10, " ".join(words[:60])), (11, " ".join(words)), (12, "Two words"), (13, "")]
    got = {(r.id, r.item) for r in decontaminate.contaminations(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 11), (2, 10), (2, 11), (3, 12), (6, 10), (6, 11)}
