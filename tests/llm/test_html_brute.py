"""Template deduction against a plain version: occurrence vectors written out by page, slots found for each block by a scan of all marks."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from strandline.llm import html_extract
from strandline.llm.html_extract import Page


def host_template(pages):
    """(frame, inner, own) of one host's parsed pages: frame has the ordered tokens of each class."""
    seen, place, size, article = defaultdict(dict), defaultdict(dict), {}, {}
    tags, inside, counted = set(), set(), 0
    for i, p in enumerate(pages):
        article[i] = sum(len(b[2]) for b in p.blocks if b[5] and not b[4])
        found = list(p.tags) + [(b[0], b[1]) for b in p.blocks if b[0]]
        counted += bool(found)
        tags |= {t for t, _ in p.tags}
        inside |= {b[0] for b in p.blocks if b[5]}
        size |= {b[0]: len(b[2]) for b in p.blocks}
        for t, n in Counter(t for t, _ in found).items():
            seen[t][i] = n
            place[t][i] = next(at for x, at in found if x == t) / max(p.place, 1)
    classes = defaultdict(list)
    for t, v in seen.items():
        if len(v) >= 3 and 20 * len(v) >= counted:
            classes[tuple(sorted(v.items()))].append(t)
    valid = {}
    for v, members in classes.items():
        single, support = [t for t in members if set(dict(v).values()) == {1}], len(v)
        texts = [t for t in members if t not in tags]
        if len(members) == 1 and (10 * support < 9 * counted if texts else not single or 4 * support < counted):
            continue
        share = sum(article[i] for i in dict(v))
        mine = sum(size[t] * support for t in texts if t in inside)
        valid[v] = mine / share if share else 0.0
    together = sum(part for v, part in valid.items() if 2 * len(v) >= counted)
    frame, inner, own = [], set(), set()
    for v, part in valid.items():
        support, single = len(v), set(dict(v).values()) == {1}
        data = part >= 0.5 or (together >= 0.5 and 10 * support < 9 * counted)
        marks = sorted((sum(place[t].values()) / support, t) for t in classes[v] if t in tags)
        if single and 4 * support >= counted:
            frame.append([t for _, t in marks])
        else:
            inner |= {t for _, t in marks}
        if 2 * support >= counted:
            own |= {t for t in classes[v] if t not in tags and (t not in inside or not data)}
    return frame, inner, own


def in_order(found, order):
    """The longest part of a page's tokens that stands in the template's order, by trying all parts from the longest on."""
    rank = {t: i for i, t in enumerate(order)}
    found = [(at, t) for at, t in found if t in rank]
    for n in range(len(found), 0, -1):
        fit = [c for c in combinations(found, n) if all(rank[a[1]] < rank[b[1]] for a, b in zip(c, c[1:], strict=False))]
        if fit:
            assert len(fit) == 1, "the fixture leaves a choice"
            return list(fit[0])
    return []


def main_texts(rows):
    """{page id: text} of (id, host, html) rows."""
    parsed = {i: Page(source or "") for i, _, source in rows}
    hosts = defaultdict(list)
    for i, host, source in rows:
        if host and source is not None:
            hosts[host].append(parsed[i])
    shapes = {h: host_template(pages) for h, pages in hosts.items()}
    open_blocks, stats = {}, defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for i, host, _ in rows:
        p = parsed[i]
        frame, inner, own = shapes.get(host, ([], set(), set()))
        outer = [x for order in frame for x in in_order([(at, t) for t, at in p.tags], order)]
        blocks, met = [], set()
        for tok, place, text, links, closed, article in p.blocks:
            before = [x for x in outer if x[0] <= place]
            at, slot = max(before) if before else (-1, 0)
            parts = [(a, t) for t, a in p.tags if t in inner and at <= a <= place]
            if not closed and tok not in own:
                blocks.append((slot, max(parts)[1] if parts else 0, slot not in met, text, links, article))
                met.add(slot)
        layout = any(b[5] for b in blocks)
        open_blocks[i] = (host, layout, [b for b in blocks if b[5] or not layout])
        for slot, part, new, text, links, _ in open_blocks[i][2]:
            s = stats[host, layout][slot, part]
            s[0], s[1], s[2] = s[0] + len(text), s[1] + links, s[2] + new
    out = {}
    for i, (host, layout, blocks) in open_blocks.items():
        here, slots = stats[host, layout], defaultdict(list)
        for (slot, part), s in here.items():
            slots[slot].append((part, *s))
        mean = {slot: sum(p[1] for p in parts) / max(sum(p[3] for p in parts), 1) for slot, parts in slots.items()}
        good = set()
        for slot, parts in slots.items():
            if layout or mean[slot] * 10 >= max(mean.values()):
                nameless = slot == 0 and len(parts) == 1
                good |= {(slot, p[0]) for p in parts if p[2] * 2 <= p[1] or (layout and nameless)}
        kept = [b for b in blocks if b[:2] in good] or blocks
        out[i] = "\n".join(b[3] for b in kept)
    return out


def site(prose, r, host, n, article):
    """Pages of one host: two layouts, notices on some pages, link lists, now and then a repeated or missing part."""
    rows = []
    for i in range(n):
        said = lambda k, m=12: prose(r.randint(0, 10**6), m)
        body = "".join(f"<p>{said(j)}</p>" for j in range(r.randint(1, 4)))
        notice = "<div><p>Sign up for our letters today</p></div>" if r.random() < 0.7 else ""
        links = "<div id=more>" + "".join(f"<p><a href=/{j}>{said(j, 3)}</a></p>" for j in range(r.randint(0, 3))) + "</div>"
        aside = f"<section><h2>{said(1, 2)}</h2><p>{said(2, 4)}</p></section>" * r.randint(0, 2)
        main = f"<article><h1>{said(0, 3)}</h1>{notice}{body}{links}</article>" if article else f"<div id=a><h1>{said(0, 3)}</h1>{notice}{body}</div>{links}"
        wide = f"<table><tr><td>{said(5, 3)}</td></tr></table>" if i % 2 else "<hr>"
        rows.append((host, f"<html><body><div id=top>{host} news</div><nav><a href=/>Home</a></nav>{main}{aside}{wide}<div id=end><p>All rights reserved</p></div></body></html>"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_main_text_equals_the_plain_version(spark, prose, seed):
    r = random.Random(seed)
    rows = site(prose, r, "one.example", 14, True) + site(prose, r, "two.example", 15, False) + site(prose, r, "few.example", 2, False) + site(prose, r, "both.example", 8, True) + site(prose, r, "both.example", 7, False)
    rows += [("one.example", None), ("two.example", ""), ("two.example", "plain words only"), ("", "<p>no host <b>here</b>"), ("few.example", rows[0][1])]
    rows = [(i, host, source) for i, (host, source) in enumerate(rows)]
    pages = spark.createDataFrame([(i, f"https://www.{h}/{i}" if h else None, s) for i, h, s in rows], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html_extract.op8(pages).collect()}
    want = main_texts(rows)
    assert {i: t for i, t in got.items() if t != want[i]} == {} and len(got) == len(rows)
    assert all("All rights reserved" not in got[i] and "Home" not in got[i] for i, h, s in rows if h in ("one.example", "two.example"))


def test_longest_part_in_order():
    r = random.Random(3)
    for _ in range(200):
        order = [r.randint(0, 6) for _ in range(r.randint(0, 7))]
        got = html_extract.increasing(order)
        rising = [c for n in range(len(order) + 1) for c in combinations(range(len(order)), n) if all(order[a] < order[b] for a, b in zip(c, c[1:], strict=False))]
        assert tuple(got) in rising and len(got) == max(map(len, rising))
