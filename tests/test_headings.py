"""Headings of rows: titles across pages, pairs of languages, paths."""

import random

import pytest

from corpusloom.operators import corpus as C, headings as H

KIND = "doc int, page int, row_index int, kind string, en_text string, ar_text string"


def heads(spark, rows):
    headings, odd = H.heading_rows(spark.createDataFrame([(1, *r) for r in rows], KIND))
    found = [(r["page"], r["row_index"], r["rank"], r["en"], r["ar"]) for r in headings.orderBy("pos", "k").collect()]
    return found, sorted((r["page"], r["row_index"], r["anomaly"]) for r in odd.collect())


def test_a_keyword_takes_its_title_from_the_next_page(spark):
    rows = [
        (46, 6, "article", "Article 349", "مادة ٣٤٩"), (46, 7, "heading", "Section II", "الفصل الثاني"), (47, 0, "heading", "Methods of Extinction", "انقضاء الالتزام"),
        (47, 1, "heading", "1. Giving in Payment", "١ -الوفاء بمقابل"), (47, 2, "article", "Article 350", "مادة ٣٥٠"),
    ]
    found, odd = heads(spark, rows)
    assert found == [(46, 7, 4, "Section II Methods of Extinction", "الفصل الثاني انقضاء الالتزام"), (47, 1, 5, "1. Giving in Payment", "١ -الوفاء بمقابل")] and odd == []
    typed = spark.createDataFrame([(1, *r[:2], r[3], r[4], r[2] == "heading", None) for r in rows], "doc int, page int, row_index int, en_text string, ar_text string, en_all_bold boolean, ar_all_bold boolean")
    paths = {r["article_number"]: r["heading_path"] for r in C.assemble(C.classify(typed))[0].collect()}
    assert paths == {349: [], 350: ["Section II Methods of Extinction", "1. Giving in Payment"]}


def test_a_title_only_on_another_page(spark):
    found, odd = heads(spark, [(1, 0, "heading", "PART I", "القسم الأول"), (1, 1, "heading", "General", "عام"), (2, 0, "article", "Article 1", "")])
    assert [f[3] for f in found] == ["PART I", "General"] and odd == [(1, 0, "untitled_heading")]


def test_numbers_in_one_language(spark):
    found, odd = heads(spark, [(7, 2, "heading", "Associations", "٣ -الجمعيات"), (7, 3, "heading", "1. A\n2. B", "واحد")])
    assert [f[2] for f in found] == [5, 5, 6] and odd == [(7, 2, "numbering_mismatch"), (7, 3, "heading_alignment"), (7, 3, "numbering_mismatch")]


def plain(rows):
    """The rule of waiting, row by row."""
    out, odd, pending, page = [], [], None, None
    for p, i, kind, en, _ in rows:
        new, page = p != page, p
        if pending is not None and not (kind == "heading" and new):
            odd.append((*pending, "untitled_heading"))
            pending = None
        if kind != "heading":
            continue
        units = en.split("\n")
        if pending is not None:
            out[-1] = f"{out[-1]} {units.pop(0)}"
        pending = None
        out += units
        if units and units[-1].startswith("PART"):
            pending = (p, i)
    return out, sorted(odd)


@pytest.mark.parametrize("seed", range(3))
def test_waiting_headings_against_row_by_row(spark, seed):
    rng = random.Random(seed)
    rows, page, at = [], 1, 0
    for _ in range(120):
        if rng.random() < 0.6:
            page, at = page + 1, 0
        kind = rng.choice(["heading"] * 5 + ["article"])
        rows.append((page, at, kind, rng.choice(["PART I", "PART I", "1. a", "1. a\nPART I"]) if kind == "heading" else "Article 1", ""))
        at += 1
    found, odd = heads(spark, rows)
    want, problems = plain(rows)
    assert [f[3] for f in found] == want and odd == problems
