"""Glossary terms against a plain pass over the spans in reading order."""

import random

from tidemark.operators import glossary as G

SPAN = "doc_id long, page int, ord int, text string, font string, size double, x0 double, y0 double, width double"
FONTS = [("SUIT-ExtraBold", 14.0), ("DIN-Bold", 13.0), ("KoPubDotum", 9.2), ("KoPubDotum", 10.5), ("Batang", 10.5), ("Batang", 10.5), ("NanumSquare", 9.0), ("Dinlig", 9.0), ("Batang", 7.0), ("DIN-Bold", 9.0)]
WORDS = ["자산", "Alpha", "Beta", "(ABC)", "연관검색어", "갑, 을,갑", "ㄱ", "a b", " ", "값 "]


def made(seed: int, n: int = 400) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        font, size = r.choice(FONTS)
        rows.append((r.randrange(2), r.randrange(1, 6), i, r.choice(WORDS), font, size, float(r.choice([50, 80, 300, 330])), r.choice([10.0, 11.0, 13.0, 14.5, 16.0, 40.0, 60.0, 61.0]), 500.0))
    return rows


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc, page, raw title, definition, related) by one pass."""
    title = lambda s: s[5] >= 12 and ("ExtraBold" in s[4] or "DIN-Bold" in s[4])
    rel = lambda s: "Dotum" in s[4] and 8.7 <= s[5] <= 9.6
    kept = [s for s in rows if s[3].strip() and s[5] >= 7.5 and "NanumSquare" not in s[4] and "Dinlig" not in s[4] and s[3].strip() != "ㄱ"]
    kept.sort(key=lambda s: (s[0], s[1], 0 if title(s) or s[6] < s[8] / 2 else 1, round(s[7] / 2), s[6], s[2]))
    out: list[dict] = []
    before = None
    for s in kept:
        if title(s):
            if before and before[0][:2] == s[:2] and abs(before[0][7] - s[7]) < 5:
                before.append(s)
            else:
                before = [s]
                out.append({"at": s[:2], "t": before, "d": [], "r": None})
            continue
        before = None
        if not out or out[-1]["at"][0] != s[0]:
            continue
        term, word = out[-1], s[3].strip()
        if rel(s) and word == "연관검색어":
            term["r"] = term["r"] or []
        elif term["r"] is None:
            term["d"].append(word)
        elif rel(s):
            term["r"] += [x.strip() for x in word.split(",") if x.strip()]
    found = []
    for t in out:
        name = ""
        for s in sorted(t["t"], key=lambda s: s[6]):
            name += (" " if "DIN-Bold" in s[4] and name[-1:].isalpha() else "") + s[3].strip()
        if t["d"]:
            found.append((*t["at"], name, " ".join(" ".join(t["d"]).split()), sorted(set(t["r"] or []))))
    return sorted(found)


def test_islands_equal_a_plain_pass(spark):
    for seed in range(3):
        rows = made(seed)
        got = G.glossary_terms(spark.createDataFrame(rows, SPAN)).collect()
        want = plain(rows)
        assert len(want) > 10
        assert sorted((r.doc_id, r.page, r.definition, sorted(r.related_terms)) for r in got) == sorted((d, p, x, y) for d, p, _, x, y in want)
        names = sorted((r.doc_id, r.page, r.pos, r.text) for r in G.title_lines(G.ordered_spans(spark.createDataFrame(rows, SPAN))).collect())
        assert {n for _, _, n, _, _ in want} <= {n for *_, n in names}


def test_names_aliases_and_pages(spark):
    def term(doc, page, y, name, latin, definition, related=None):
        rows = [(doc, page, 0, name, "SUIT-ExtraBold", 14.0, 50.0, y, 500.0)]
        rows += [(doc, page, 1, latin, "DIN-Bold", 14.0, 120.0, y + 1, 500.0)] if latin else []
        rows += [(doc, page, 2 + i, d, "Batang", 10.5, 50.0, y + 20 + 15 * i, 500.0) for i, d in enumerate(definition)]
        if related:
            rows += [(doc, page, 8, "연관검색어", "KoPubDotum", 9.0, 50.0, y + 60, 500.0), (doc, page, 9, related, "KoPubDotum", 9.5, 90.0, y + 60, 500.0)]
        return rows

    rows = term(1, 19, 10.0, "개인소득", "(PDI; Personal Income)", ["뜻은 ①", "하나"], "소득, 가계 , 소득")
    rows += term(1, 20, 10.0, "직접/간접", None, ["직접(Direct Way)은 이렇다"]) + term(1, 21, 10.0, "빈것", None, []) + term(1, 22, 10.0, "HDRI", "(HDRI)", ["값"]) + term(1, 23, 10.0, "나머지", "(다른 Word)", ["나머지(RST) 뜻"])
    lines = "목차\n개인 소득 ······ 3\n간접....4\n(이음 ..... 5\nlower ..... 6\n개인소득 ..... 9\n무점 7"
    listed = G.contents(spark.createDataFrame([(1, 1, lines), (2, 1, None)], "doc_id long, page int, text string"))
    assert sorted((r.key, r.printed_page) for r in listed.collect()) == [("간접", 4), ("개인소득", 3)]
    got = {r.term: r for r in G.glossary_terms(spark.createDataFrame(rows, SPAN), listed, 18).collect()}
    assert set(got) == {"개인소득", "직접/간접", "HDRI", "나머지"}
    a, b, c, e = (got[k] for k in ("개인소득", "직접/간접", "HDRI", "나머지"))
    assert (a.english_name, a.aliases, a.related_terms, a.definition, a.source_page) == ("Personal Income", ["PDI"], ["소득", "가계"], "뜻은 ① 하나", 3)
    assert a.search_text == "개인소득 personal income pdi 뜻은 1. 하나"
    assert (b.english_name, b.aliases, b.source_page) == ("Direct Way", ["직접", "간접"], 4)
    assert (c.english_name, c.aliases, c.source_page) == (None, ["HDRI"], 4) and (e.english_name, e.aliases) == (None, ["RST"])


def test_awkward_spans(spark):
    nulls = [(None,) * 9, (1, 1, 0, None, None, None, None, None, None), (1, 1, 1, "x" * 100000, "Batang", 10.0, 1.0, 1.0, 9.0)]
    assert G.glossary_terms(spark.createDataFrame(nulls, SPAN)).count() == 0
    assert G.glossary_terms(spark.createDataFrame([], SPAN), G.contents(spark.createDataFrame([], "doc_id long, page int, text string"))).count() == 0
    clash = spark.createDataFrame([(*r, "z") for r in made(1)], SPAN + ", title string")
    assert G.glossary_terms(clash).count() == len(plain(made(1)))
